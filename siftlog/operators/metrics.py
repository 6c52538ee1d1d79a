"""Confusion counts and the metrics that follow from their nine cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.schema import LABELS

MISS_COSTS = (2, 5, 10)


def cells(truth: str = "truth", pred: str = "pred", weight: Column | None = None) -> list[Column]:
    """Nine sums t0p0 to t2p2, for one aggregation over any groups."""
    weight = weight if weight is not None else F.lit(1)
    return [F.coalesce(F.sum(F.when((F.col(truth) == t) & (F.col(pred) == p), weight)), F.lit(0)).alias(f"t{i}p{j}") for i, t in enumerate(LABELS) for j, p in enumerate(LABELS)]


def _share(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def metric_columns(present_only: bool = True) -> dict[str, Column]:
    """Metrics of the nine cells. Macro-F1 is over the labels in the truth, or else over all three."""
    c = [[F.col(f"t{i}p{j}").cast("double") for j in range(3)] for i in range(3)]
    total = sum((x for row in c for x in row), F.lit(0.0))
    hit = c[0][0] + c[1][1] + c[2][2]
    out: dict[str, Column] = {"items": total, "accuracy": _share(hit, total)}
    f1s, supports = [], []
    for i, label in enumerate(LABELS):
        support, predicted = c[i][0] + c[i][1] + c[i][2], c[0][i] + c[1][i] + c[2][i]
        precision, recall = _share(c[i][i], predicted), _share(c[i][i], support)
        f1 = _share(2 * precision * recall, precision + recall)
        out |= {f"precision_{label}": precision, f"recall_{label}": recall, f"f1_{label}": f1}
        f1s.append(f1)
        supports.append(support)
    n = sum(((s > 0).cast("double") for s in supports), F.lit(0.0)) if present_only else F.lit(3.0)
    out["macro_f1"] = _share(sum((F.when(s > 0, f).otherwise(0.0) if present_only else f for f, s in zip(f1s, supports, strict=True)), F.lit(0.0)), n)
    out["weighted_f1"] = _share(sum((f * s for f, s in zip(f1s, supports, strict=True)), F.lit(0.0)), total)
    benign_misses = c[0][1] + c[0][2]
    misses, swaps = c[1][0] + c[2][0], c[1][2] + c[2][1]
    caught = c[1][1] + c[1][2] + c[2][1] + c[2][2]
    recall, precision = _share(caught, caught + misses), _share(caught, caught + benign_misses)
    out |= {
        "benign_misses": benign_misses,
        "errors": total - hit,
        "cost": 10 * benign_misses + (total - hit - benign_misses),
        "threat_misses": misses,
        "false_alarms": benign_misses,
        "swaps": swaps,
        "threat_recall": recall,
        "threat_precision": precision,
        "threat_f1": _share(2 * recall * precision, recall + precision),
        "partial_accuracy": _share(hit + 0.5 * swaps, total),
    }
    return out | {f"cost_m{m}": m * misses + benign_misses + 0.5 * swaps for m in MISS_COSTS}


def evaluate(df: DataFrame, groups: tuple[str, ...] = (), weight: Column | None = None, present_only: bool = True) -> DataFrame:
    """One row of metrics for each group; partial sums before the shuffle, so groups may be of any size."""
    sums = df.groupBy(*groups).agg(*cells(weight=weight))
    return sums.select(*groups, *[F.round(v, 6).alias(k) for k, v in metric_columns(present_only).items()])


def report(df: DataFrame) -> DataFrame:
    """A row for each label: precision, recall, F1 and support."""
    m = df.agg(*cells()).select("*", *[v.alias(k) for k, v in metric_columns().items()])
    rows = [F.struct(F.lit(label).alias("label"), *[F.round(F.col(f"{k}_{label}"), 6).alias(k) for k in ("precision", "recall", "f1")], (F.col(f"t{i}p0") + F.col(f"t{i}p1") + F.col(f"t{i}p2")).cast("long").alias("support")) for i, label in enumerate(LABELS)]
    return m.select(F.inline(F.array(*rows)))


def macro_auc(df: DataFrame, truth: str = "truth") -> DataFrame:
    """Macro one-versus-rest area under the curve; null unless all labels occur. Ties count half.

    Rows are summed for each distinct score first. The sums of all smaller scores come from ranges of the score, each
    summed on its own, so that no task sees more than one range.
    """
    ranges = 256
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"p_{label}").alias("score"), (F.col(truth) == label).cast("long").alias("hit")) for label in LABELS])).alias("r")).select("r.*")
    each = rows.groupBy("label", "score").agg(F.sum("hit").alias("pos"), (F.count(F.lit(1)) - F.sum("hit")).alias("neg"))
    each = each.withColumn("part", F.least(F.floor(F.col("score") * ranges), F.lit(ranges - 1)))
    inside = Window.partitionBy("label", "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy("label", "part").agg(F.sum("neg").alias("n"))
    below = parts.select("label", "part", F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    won = each.select("label", "part", "pos", "neg", F.coalesce(F.sum("neg").over(inside), F.lit(0)).alias("under")).join(F.broadcast(below), ["label", "part"])
    auc = won.groupBy("label").agg((F.sum(F.col("pos") * (F.col("below") + F.col("under") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    return auc.agg(F.when(F.count("auc") == 3, F.round(F.avg("auc"), 6)).alias("macro_auc"))


def diagnostics(run: DataFrame) -> DataFrame:
    """What routing changed in each source: ``run`` has source, truth, clf, final and routed."""
    clf, final, truth = F.col("clf"), F.col("final"), F.col("truth")
    benign = F.lit(LABELS[0])
    counts = {
        "routed": F.col("routed"),
        "changed": clf != final,
        "vetoed": (clf != benign) & (final == benign),
        "raised": (clf == benign) & (final != benign),
        "retyped": (clf != final) & (clf != benign) & (final != benign),
        "fixed": (clf != truth) & (final == truth),
        "broken": (clf == truth) & (final != truth),
    }
    return run.groupBy("source").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def validation(submission: DataFrame, expected: DataFrame, most: int = 5) -> DataFrame:
    """One row: how many ids are duplicate, missing or extra and labels invalid, with some of each, and whether all is well."""
    ids = expected.select("event_id").distinct()
    sub = submission.select("event_id", "pred_label")
    some = lambda df, c, n: df.agg(F.count(F.lit(1)).alias(n)).join(F.broadcast(df.orderBy(c).limit(most).agg(F.array_join(F.sort_array(F.collect_list(F.col(c).cast("string"))), ",").alias(f"{n}_ids"))))
    parts = [
        some(sub.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "event_id", "duplicate"),
        some(ids.join(sub, "event_id", "left_anti"), "event_id", "missing"),
        some(sub.select("event_id").distinct().join(ids, "event_id", "left_anti"), "event_id", "extra"),
        some(sub.where(F.col("pred_label").isNull() | ~F.col("pred_label").isin(*LABELS)), "event_id", "invalid"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out.withColumn("valid", (F.col("duplicate") + F.col("missing") + F.col("extra") + F.col("invalid")) == 0)


def check_submission(submission: DataFrame, expected: DataFrame) -> None:
    """Raise one error that names everything that is wrong."""
    if set(submission.columns) != {"event_id", "pred_label"}:
        raise ValueError(f"columns are {submission.columns}; event_id and pred_label are expected")
    row = validation(submission, expected).first()
    if not row["valid"]:
        raise ValueError("; ".join(f"{n} {row[n]} ({row[n + '_ids']})" for n in ("duplicate", "missing", "extra", "invalid") if row[n]))
