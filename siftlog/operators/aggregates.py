"""Aggregations: unique documents, label rules and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.schema import LABELS


class RuleError(ValueError):
    """A rule that the training rows don't support."""


def unique_documents(df: DataFrame, keys: tuple[str, ...] = ("doc", "label"), key: str = "event_id", first: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row for each distinct document: its rows, the smallest identifier and that row's other columns."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias(key), *[F.min_by(c, key).alias(c) for c in first])


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """label and count in the order of LABELS, zeros included."""
    sums = df.agg(*[F.count_if(F.col(label) == x).alias(x) for x in LABELS])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("count"), F.lit(i).alias("place")) for i, x in enumerate(LABELS)])))


def source_mask(df: DataFrame, source: str, label: str, min_rows: int) -> DataFrame:
    """The labels that each source with at least ``min_rows`` rows was seen with."""
    sums = df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set(label)).alias("labels"))
    return sums.where(F.col("rows") >= min_rows)


def verdict_rule(df: DataFrame, state: Column, verdict: Column, label: str, min_rows: int = 1000, min_purity: float = 0.999) -> dict:
    """The majority label of rows without vendor that were blocked; raises unless there are enough and they agree."""
    sums = {r[label]: r["count"] for r in df.where((state == "missing") & (verdict == "block")).groupBy(label).count().collect()}
    support = sum(sums.values())
    if support < min_rows:
        raise RuleError(f"{support} rows support the rule; {min_rows} are needed")
    top = min(sums, key=lambda k: (-sums[k], k))
    if sums[top] / support < min_purity:
        raise RuleError(f"purity {sums[top] / support:.4f} is below {min_purity}")
    return {"label": top, "support": support, "purity": sums[top] / support, "counts": sums}


def date_rule(df: DataFrame, time: str, label: str) -> float:
    """The time before which all rows are malicious: that of the earliest other row."""
    cut = df.agg(F.min(F.when(F.col(label) != LABELS[2], F.col(time))).alias("t")).first()["t"]
    early = df.where(F.col(time) < cut).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) != LABELS[2]).alias("bad")).first() if cut is not None else None
    if early is None or not early["n"] or early["bad"]:
        raise RuleError("no rows before the cut, or not all malicious")
    return cut


def column_purity(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """For each column how well its value alone tells the label: the majority's share over all values, and their number."""
    long = df.select(label, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])))
    counts = long.groupBy("column", "value", label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column", "value").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return best.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"), F.round(F.sum("top") / F.sum("n"), 6).alias("purity"))


def keyword_labels(df: DataFrame, message: str, label: str, keywords: list[str]) -> DataFrame:
    """How often rows of each label hold each keyword; one pass, a row is counted once for each of its keywords."""
    found = F.filter(F.array(*[F.when(F.contains(F.lower(message), F.lit(k)), F.lit(k)) for k in keywords]), lambda k: k.isNotNull())
    return df.select(label, F.explode(found).alias("keyword")).groupBy("keyword", label).agg(F.count(F.lit(1)).alias("n"))


def mutual_information(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Mutual information of each column and the target, as a share of the target's entropy."""
    long = df.select(F.col(target).alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("x")) for c in columns])))
    joint = long.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    # x log x of joint, row and column counts; the totals are one row for each column.
    xlx = lambda c: c * F.ln(c)
    rows = joint.groupBy("column", "x").agg(F.sum("n").alias("nx"), F.sum(xlx(F.col("n"))).alias("jj"))
    x = rows.groupBy("column").agg(F.sum(xlx(F.col("nx"))).alias("xx"), F.sum("jj").alias("jj"), F.sum("nx").alias("n"))
    y = joint.groupBy("column", "y").agg(F.sum("n").alias("ny")).groupBy("column").agg(F.sum(xlx(F.col("ny"))).alias("yy"))
    n = F.col("n")
    mi = (F.col("jj") - F.col("xx") - F.col("yy")) / n + F.ln(n)
    entropy = F.ln(n) - F.col("yy") / n
    return x.join(y, "column").select("column", F.when(entropy > 1e-12, F.round(F.greatest(mi / entropy, F.lit(0.0)), 6)).otherwise(0.0).alias("norm_mi"))


def value_rates(df: DataFrame, value: str, positive: Column, host: str, other: DataFrame, min_count: int, n: int) -> DataFrame:
    """The values with the highest positive rate: count, rate, hosts and whether ``other`` has them."""
    sums = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(positive.cast("double")), 6).alias("rate"), F.count_distinct(host).alias("hosts")).where(F.col("n") >= min_count)
    seen = other.select(value).distinct().withColumn("seen", F.lit(True))
    return sums.join(seen, value, "left").withColumn("seen", F.coalesce("seen", F.lit(False))).orderBy(F.desc("rate"), F.desc("n"), value).limit(n)


def crosstab(df: DataFrame, row: str, column: str, values: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts, and the share of each value in its row."""
    sums = df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total"))
    return sums.select("*", *[F.round(F.col(v) / F.col("total"), 6).alias(f"share_{v}") for v in values])


def time_audit(df: DataFrame, label: str, day: Column, hour: Column) -> DataFrame:
    """For each label rows, first and last day, days, share of its most frequent day and hour."""
    counts = df.select(F.col(label).alias("label"), day.alias("day"), hour.alias("hour")).groupBy("label", "day", "hour").agg(F.count(F.lit(1)).alias("n"))
    days = counts.groupBy("label", "day").agg(F.sum("n").alias("n")).groupBy("label").agg(F.sum("n").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("day").alias("days"), F.max("n").alias("top_day"))
    hours = counts.groupBy("label", "hour").agg(F.sum("n").alias("n")).groupBy("label").agg(F.max("n").alias("top_hour"))
    both = days.join(hours, "label")
    return both.select("label", "rows", "first_day", "last_day", "days", F.round(F.col("top_day") / F.col("rows"), 6).alias("top_day_share"), F.round(F.col("top_hour") / F.col("rows"), 6).alias("top_hour_share"))


def share_change(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The share of each value in two tables."""
    shares = [t.groupBy(column).agg(F.count(F.lit(1)).alias(n)) for t, n in ((a, "n_a"), (b, "n_b"))]
    both = shares[0].join(shares[1], column, "full").select(column, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_a", "n_b")])
    totals = both.agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))
    return both.join(F.broadcast(totals)).select(column, "n_a", "n_b", F.round(F.col("n_a") / F.col("t_a"), 6).alias("share_a"), F.round(F.col("n_b") / F.col("t_b"), 6).alias("share_b"))


def training_weights(unique: DataFrame, scheme: str) -> DataFrame:
    """``unique`` with ``weight``: by document, by the logarithm of its rows or by its rows; classes even, mean 1."""
    base = {"doc": F.lit(1.0), "log": F.log1p(F.col("rows").cast("double")), "rows": F.col("rows").cast("double")}[scheme]
    based = unique.withColumn("_base", base)
    sums = based.groupBy("label").agg(F.sum("_base").alias("_sum"), F.count(F.lit(1)).alias("_n"))  # one row for each label
    total = sums.agg(F.sum("_n").alias("_docs"), F.count(F.lit(1)).alias("_k"))
    known = sums.join(F.broadcast(total))
    # Every class sums to docs / k, so the mean is 1.
    return based.join(F.broadcast(known.select("label", "_sum", "_docs", "_k")), "label").withColumn("weight", F.col("_base") * F.col("_docs") / (F.col("_k") * F.col("_sum"))).drop("_base", "_sum", "_docs", "_k")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (k * n of the class) for each class."""
    sums = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return sums.join(F.broadcast(total)).select(label, "n", F.round(F.col("t") / (F.col("k") * F.col("n")), 6).alias("weight"))


def top_by(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rn") <= n)
