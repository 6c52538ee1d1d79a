"""Policy grids: every configuration over every holdout, as aggregations.

Documents are summed into cells first (holdout, truth, what each configuration can tell apart); only these counts
meet the grid, so its size never multiplies that of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.functions.text import bound
from siftlog.operators import decide, metrics
from siftlog.schema import LABELS

MISSES = (2.0, 5.0, 10.0)
KINDS = ("cl5", "loso", "loco")
PRIOR_OOD = 0.01
CONFIDENCE_EDGES = (0.7, 0.9, 0.95, 0.99)


def training_cells(plan: DataFrame, docs: DataFrame) -> DataFrame:
    """kind, holdout, source and label that training has inside each holdout: all cells but those of held-out documents only.

    ``plan``: kind, holdout, doc_id. Counts of each cell in and outside a holdout, not lists of documents.
    """
    cells = docs.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    out = plan.join(docs.select("doc_id", "source", "label"), "doc_id").groupBy("kind", "holdout", "source", "label").agg(F.count(F.lit(1)).alias("held"))
    full = out.join(cells, ["source", "label"]).where(F.col("held") == F.col("n")).select("kind", "holdout", "source", "label")
    every = out.select("kind", "holdout").distinct().join(F.broadcast(cells.select("source", "label")))
    return every.join(full, ["kind", "holdout", "source", "label"], "left_anti")


def band(conf: Column, edges: tuple[float, ...] = CONFIDENCE_EDGES) -> Column:
    return sum(((conf >= e).cast("int") for e in edges), F.lit(0))


def weighted_costs(docs: DataFrame, weights: list[float]) -> DataFrame:
    """For each benign-first weight, kind and holdout the nine confusion counts."""
    p = decide.probabilities()
    long = docs.select("kind", "holdout", F.col("label").alias("truth"), F.inline(F.array(*[F.struct(F.lit(float(w)).alias("w"), decide.benign_first(p, w).alias("pred")) for w in weights])))
    return long.groupBy("w", "kind", "holdout").agg(*metrics.cells())


def decision_cells(docs: DataFrame, misses: tuple[float, ...], rules: list[tuple[str, float]], novelties: list[float], doubts: list[float]) -> DataFrame:
    """Counts of what a routing grid can tell apart.

    ``docs``: kind, holdout, label, probabilities, maxsim, answered, q_* (the reply's probabilities), known_pair_<label>.
    For each miss cost m a row has the decision, its band and place among the doubts and novelties, and each rule's label.
    """
    p, q = decide.probabilities(), decide.probabilities("q_")

    def of_miss(m: float) -> Column:
        decided = F.struct(decide.min_cost(p, m).alias("clf"), decide.cost_confidence(p, m).alias("conf"))

        def cell(d: Column) -> Column:
            clf, conf = d["clf"], d["conf"]
            return F.struct(
                F.lit(float(m)).alias("m"),
                clf.alias("clf"),
                band(conf).alias("band"),
                sum(((conf >= t).cast("int") for t in doubts), F.lit(0)).alias("doubt"),
                sum(((F.col("maxsim") >= s).cast("int") for s in novelties), F.lit(0)).alias("novelty"),
                F.element_at(F.col("known_pairs"), clf).alias("known_pair"),
                *[decide.fuse_by_cost(rule, param, clf, p, q, m).alias(f"f{i}") for i, (rule, param) in enumerate(rules)],
            )

        return bound(decided, cell)

    keys = ["kind", "holdout", "truth", "answered", "m", "clf", "band", "doubt", "novelty", "known_pair", *[f"f{i}" for i in range(len(rules))]]
    long = docs.select("kind", "holdout", F.col("label").alias("truth"), "answered", F.inline(F.array(*map(of_miss, misses))))
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def routing_grid(cells: DataFrame, grid: DataFrame, n_rules: int, stage=lambda df: df) -> DataFrame:
    """For each configuration, kind and holdout the nine (estimated) counts and the share routed.

    ``grid``: config, m, t (how many doubts from the list a routed document must miss; its place), s, pair, unseen, rule.
    A routed document without a reply is estimated: outside cl5 the answered ones of its holdout are scaled up; else
    by how replies changed cl5 documents of its truth, decision and band, else of all bands, else of its truth.
    ``stage`` writes and rereads the summed rows, which several of the steps use.
    """
    fused = F.element_at(F.array(F.col("clf"), *[F.col(f"f{i}") for i in range(n_rules)]), F.col("rule") + 2)
    routed = (F.col("doubt") <= F.col("t")) & (F.col("t") >= 0) | (F.col("novelty") <= F.col("s")) & (F.col("s") >= 0) | F.col("unseen") & (F.col("kind") == "loso") | F.col("pair") & ~F.col("known_pair")
    crossed = cells.join(F.broadcast(grid), "m").select(*ROUTED, "n", "answered", routed.alias("routed"), fused.alias("fused"))
    return estimated(stage(crossed.groupBy(*ROUTED, "answered", "routed", "fused").agg(F.sum("n").cast("double").alias("n"))))


ROUTED = ["config", "kind", "holdout", "truth", "clf", "band"]


def cumulative_grid(cells: DataFrame, n_rules: int, doubts: int, novelties: int, stage=lambda df: df) -> DataFrame:
    """As ``routing_grid`` for every combination of miss cost, doubt, novelty, pair, unseen and rule, without a join with
    the configurations: what a threshold leaves unrouted is a sum over all cells beyond it.

    Cells are laid out by doubt and novelty and summed from the far end by two windows, once for each rule; what is
    routed is the rest of the group's total. Where nothing can be routed only the classifier's own decision (rule -1)
    is a configuration, and it is one only there. config is m|t|s|pair|unseen|rule.
    """
    spark = cells.sparkSession
    group = ["m", "kind", "holdout", "truth", "clf", "band", "answered", "known_pair", "rule", "fused"]
    fused = F.array(*[F.struct(F.lit(i).alias("rule"), (F.col(f"f{i}") if i >= 0 else F.col("clf")).alias("fused")) for i in range(-1, n_rules)])
    each = cells.withColumn("known_pair", F.coalesce("known_pair", F.lit(False))).select(*group[:-2], "doubt", "novelty", "n", F.inline(fused)).groupBy(*group, "doubt", "novelty").agg(F.sum("n").cast("double").alias("n"))
    # Numbers of doubts and novelties, of which there is one more than of the thresholds.
    places = spark.range(doubts + 1).select(F.col("id").cast("int").alias("doubt")).join(F.broadcast(spark.range(novelties + 1).select(F.col("id").cast("int").alias("novelty"))))
    dense = each.select(*group).distinct().join(F.broadcast(places)).join(each, [*group, "doubt", "novelty"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    beyond = lambda c, *by: F.sum(c).over(Window.partitionBy(*group, by[0]).orderBy(F.desc(by[1])).rowsBetween(Window.unboundedPreceding, 0))
    summed = dense.withColumn("n", beyond("n", "doubt", "novelty")).withColumn("n", beyond("n", "novelty", "doubt"))
    # The sum from a place on is what the threshold before it leaves; all of it, before the first.
    left = summed.withColumn("total", F.max("n").over(Window.partitionBy(*group))).withColumns({"t": F.col("doubt") - 1, "s": F.col("novelty") - 1})
    flags = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(u).alias("unseen")) for p in (False, True) for u in (False, True)])
    combined = left.select(*group, "t", "s", "n", "total", F.inline(flags))
    forced = F.col("unseen") & (F.col("kind") == "loso") | F.col("pair") & ~F.col("known_pair")
    kept = F.when(forced, 0.0).otherwise(F.col("n"))
    nothing = (F.col("t") < 0) & (F.col("s") < 0) & ~F.col("pair") & ~F.col("unseen")
    config = F.concat_ws("|", "m", "t", "s", "pair", "unseen", "rule").alias("config")
    sides = F.array(F.struct(F.lit(False).alias("routed"), kept.alias("n")), F.struct(F.lit(True).alias("routed"), (F.col("total") - kept).alias("n")))
    rows = combined.where(nothing == (F.col("rule") == -1)).select(config, *ROUTED[1:], "answered", "fused", F.inline(sides)).where("n > 0")
    return estimated(stage(rows.groupBy(*ROUTED, "answered", "routed", "fused").agg(F.sum("n").alias("n"))))


def estimated(rows: DataFrame) -> DataFrame:
    """The nine (estimated) counts and the share routed of each configuration, kind and holdout, from its counts ``rows``
    (config, kind, holdout, truth, clf, band, answered, routed, fused, n)."""
    keys = ROUTED
    known = F.col("routed") & F.col("answered")
    sums = rows.groupBy("config", "kind", "holdout").agg(F.sum(F.when(F.col("routed"), F.col("n")).otherwise(0.0)).alias("n_routed"), F.sum(F.when(known, F.col("n")).otherwise(0.0)).alias("n_known"), F.sum("n").alias("docs"))
    told = rows.join(sums, ["config", "kind", "holdout"])
    ood = F.col("kind") != "cl5"
    direct = told.where(~F.col("routed") | F.col("answered")).select(
        *keys, F.when(F.col("routed"), F.col("fused")).otherwise(F.col("clf")).alias("pred"), F.when(known & ood, F.col("n") * F.col("n_routed") / F.col("n_known")).otherwise(F.col("n")).alias("n")
    )
    asked = told.where(F.col("routed") & ~F.col("answered") & (~ood | (F.col("n_known") == 0))).groupBy(*keys).agg(F.sum("n").alias("n"))
    seen = rows.where(known)
    shares = []
    for level, (by, where) in enumerate(((["truth", "clf", "band"], F.col("kind") == "cl5"), (["truth", "clf"], F.col("kind") == "cl5"), (["truth"], F.lit(True)))):
        s = seen.where(where).groupBy("config", *by).agg(*[F.sum(F.when(F.col("fused") == x, F.col("n")).otherwise(0.0)).alias(f"d{level}_{i}") for i, x in enumerate(LABELS)])
        shares.append((by, s))
    for by, s in shares:
        asked = asked.join(s, ["config", *by], "left")

    def share(i: int) -> Column:
        out = (F.col("clf") == LABELS[i]).cast("double")
        for level in (2, 1, 0):
            d = [F.col(f"d{level}_{j}") for j in range(3)]
            total = d[0] + d[1] + d[2]
            out = F.when(total > 0, d[i] / total).otherwise(out)
        return out

    guessed = asked.select(*keys, F.inline(F.array(*[F.struct(F.lit(x).alias("pred"), (F.col("n") * share(i)).alias("n")) for i, x in enumerate(LABELS)])))
    counts = direct.unionByName(guessed).groupBy("config", "kind", "holdout").agg(*metrics.cells(weight=F.col("n")))
    return counts.join(sums.select("config", "kind", "holdout", "docs", "n_routed"), ["config", "kind", "holdout"])


def routing_costs(docs: DataFrame, weight: float, doubt: float, novelty: float, rule: str, reply_weight: float = 10.0) -> DataFrame:
    """Errors and benign misses of one benign-first policy for each holdout; unanswered routed documents by ratio.

    In distribution (kind ud5) they err as the answered ones of all holdouts do, elsewhere as those of their holdout.
    """
    p, q = decide.probabilities(), decide.probabilities("q_")
    clf = decide.benign_first(p, weight)
    conf = decide.decision_confidence(p, weight)
    known_pair = F.element_at("known_pairs", F.col("clf"))
    decided = docs.withColumns({"clf": clf, "conf": conf}).withColumn("fused", decide.fuse_by_label(rule, F.col("clf"), p, F.col("reply"), q, reply_weight))
    routed = (F.col("conf") < doubt) | (F.col("maxsim") < novelty) | (F.col("kind") == "loso") | ~F.coalesce(known_pair, F.lit(False))
    wrong = lambda pred: F.col("label") != F.col(pred)
    missed = lambda pred: (F.col("label") == LABELS[0]) & (F.col(pred) != LABELS[0])
    rows = decided.withColumn("routed", routed).withColumn("known", F.col("routed") & F.col("reply").isNotNull())
    count = lambda c, name: F.count_if(c).cast("double").alias(name)
    sums = rows.groupBy("kind", "holdout").agg(
        F.count(F.lit(1)).alias("docs"),
        count(F.col("routed"), "n_routed"),
        count(F.col("known"), "n_known"),
        *[count(~F.col("routed") & f("clf"), f"kept_{n}") for n, f in (("err", wrong), ("bm", missed))],
        *[count(F.col("known") & f("fused"), f"known_{n}") for n, f in (("err", wrong), ("bm", missed))],
        *[count(f("clf"), f"clf_{n}") for n, f in (("err", wrong), ("bm", missed))],
    )
    pooled = sums.agg(*[(F.sum(f"known_{n}") / F.greatest(F.sum("n_known"), F.lit(1.0))).alias(f"rate_{n}") for n in ("err", "bm")])
    both = sums.join(F.broadcast(pooled))

    def estimate(n: str) -> Column:
        rest = F.col("n_routed") - F.col("n_known")
        inside = F.col(f"known_{n}") + rest * F.col(f"rate_{n}")
        outside = F.when(F.col("n_known") > 0, F.col(f"known_{n}") * F.col("n_routed") / F.col("n_known")).otherwise(F.col("n_routed") * F.col(f"rate_{n}"))
        return F.col(f"kept_{n}") + F.when(F.col("kind") == "ud5", inside).otherwise(outside)

    out = both.withColumns({"errors": estimate("err"), "benign_misses": estimate("bm")})
    return out.select("kind", "holdout", "docs", F.col("n_routed").alias("routed"), *[F.round(c, 6).alias(c) for c in ("errors", "benign_misses")], F.round(9 * F.col("benign_misses") + F.col("errors"), 6).alias("cost"), (9 * F.col("clf_bm") + F.col("clf_err")).alias("clf_cost"))


def cost_of(m: float) -> Column:
    """The cost of nine cells at miss weight m."""
    return F.lit(float(m)) * (F.col("t1p0") + F.col("t2p0")) + F.col("t0p1") + F.col("t0p2") + decide.SWAP_COST * (F.col("t1p2") + F.col("t2p1"))


def objectives(counts: DataFrame, config: str, misses: tuple[float, ...] = MISSES, prior_ood: float = PRIOR_OOD, min_docs: int = 30) -> DataFrame:
    """For each configuration and miss cost: pooled, macro, macro over larger holdouts and root-weighted costs, and objectives."""
    docs = sum((F.col(f"t{i}p{j}") for i in range(3) for j in range(3)), F.lit(0.0)).cast("double")
    rows = counts.select(config, "kind", docs.alias("d"), F.inline(F.array(*[F.struct(F.lit(float(m)).alias("miss"), cost_of(m).cast("double").alias("c")) for m in misses])))
    aggregates = []
    for kind in KINDS:
        of = lambda c, kind=kind: F.when(F.col("kind") == kind, c)
        big = lambda c, kind=kind: F.when((F.col("kind") == kind) & (F.col("d") >= min_docs), c)
        rate, root = F.col("c") / F.col("d"), F.sqrt("d")
        aggregates += [
            (F.sum(of(F.col("c"))) / F.sum(of(F.col("d")))).alias(f"{kind}_pooled"),
            F.avg(of(rate)).alias(f"{kind}_macro"),
            F.avg(big(rate)).alias(f"{kind}_macro_large"),
            (F.sum(of(rate * root)) / F.sum(of(root))).alias(f"{kind}_root"),
        ]
    sums = rows.groupBy(config, "miss").agg(*aggregates)
    blend = lambda a: (1 - prior_ood) * F.col("cl5_pooled") + prior_ood * (F.col(f"loso_{a}") + F.col(f"loco_{a}")) / 2
    return sums.select("*", *[blend(a).alias(f"objective_{a}") for a in ("macro", "pooled", "macro_large", "root")])


def regrets(table: DataFrame, config: str, objectives_: tuple[str, ...] = ("objective_macro", "objective_pooled")) -> DataFrame:
    """The largest ratio of a configuration's objective to the best one, over miss costs and aggregations."""
    best = table.groupBy("miss").agg(*[F.min(o).alias(f"best_{o}") for o in objectives_])  # a row for each miss cost
    ratios = table.join(F.broadcast(best), "miss").select(config, "miss", F.array_max(F.array(*[F.col(o) / F.col(f"best_{o}") for o in objectives_])).alias("r"))
    return ratios.groupBy(config).agg(F.max("r").alias("regret"))
