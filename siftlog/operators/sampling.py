"""Exact samples, folds and holdouts. Order comes from a portable hash of the identifier, so results repeat anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.schema import LABELS


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hash_share(order: Column) -> Column:
    """The hash as a number from 0 to 1: its first eight digits."""
    return F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / 2.0**32


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many rows of each label an exact stratified sample of ``most`` rows has, at least one of each.

    The label with the largest remainder takes what is left over, then the next when its rows are used up.
    """
    total = sum(counts.values())
    if most >= total:
        return dict(counts)
    share = {k: most * n / total for k, n in counts.items()}
    got = {k: min(counts[k], max(1, int(share[k]))) for k in counts}
    by_rest = sorted(counts, key=lambda k: (-(share[k] - int(share[k])), k))
    for k in by_rest:
        got[k] += min(max(most - sum(got.values()), 0), counts[k] - got[k])
    while sum(got.values()) > most:
        largest = max((k for k in got if got[k] > 1), key=lambda k: (got[k], k), default=None)
        if largest is None:
            break
        got[largest] -= 1
    return got


def ranked(df: DataFrame, groups: list[str], key: str, seed: int, keep: Column | None = None) -> DataFrame:
    """``df`` with ``rn``, the place of each row in its group by hash; rows that ``keep`` excludes are dropped before the sort."""
    rows = df.withColumn("_order", hash_order(key, seed))
    if keep is not None:
        rows = rows.where(keep)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*groups).orderBy("_order", key)))


def ranked_in_parts(df: DataFrame, group: str, key: str, seed: int, rows_in_part: int = 1_000_000) -> DataFrame:
    """As ``ranked``, with ``n`` as well, the group's rows.

    Ranges of the hash are ranked apart and shifted by the counts of those before them, so no task sorts a whole group.
    """
    parts = max(16, -(-df.count() // rows_in_part))
    rows = df.withColumn("_order", hash_order(key, seed)).withColumn("_part", F.floor(hash_share(F.col("_order")) * parts).cast("int"))
    sizes = rows.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_size"))  # a row for each label and range
    label = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_size").over(label.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("_g", "_p", before.alias("_before"), F.sum("_size").over(label).alias("n"))
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy(group, "_part").orderBy("_order", key)))
    joined = inside.join(places, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("rn", F.col("_in") + F.col("_before")).drop("_order", "_part", "_g", "_p", "_in", "_before")


def stratified_sample(df: DataFrame, label: str, key: str, most: int, seed: int) -> DataFrame:
    """Exactly min(most, rows) rows; only hashes that can be among the quota reach the sort."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row for each label
    quota = quotas(counts, most)
    # Six standard deviations over the quota's share; where rows below that are fewer all the same, as with repeated keys, it is doubled.
    share = {k: min(1.0, (n + 6 * n**0.5 + 20) / counts[k]) for k, n in quota.items()}
    hashed = hash_share(hash_order(key, seed))
    while True:
        bound, place = F.lit(0.0), F.lit(0)
        for k, n in quota.items():
            same = F.col(label).eqNullSafe(F.lit(k))
            bound, place = F.when(same, F.lit(share[k])).otherwise(bound), F.when(same, F.lit(n)).otherwise(place)
        got = {r[label]: r["count"] for r in df.where(hashed <= bound).groupBy(label).count().collect()}
        short = [k for k, n in quota.items() if got.get(k, 0) < n and share[k] < 1]
        if not short:
            break
        share |= {k: min(1.0, 2 * share[k]) for k in short}
    rows = ranked(df, [label], key, seed, hash_share(F.col("_order")) <= bound)
    return rows.where(F.col("rn") <= place).drop("rn", "_order")


def cap_cells(df: DataFrame, groups: list[str], cap: int, key: str, seed: int) -> DataFrame:
    """At most ``cap`` rows of each group. Groups are cut in hash ranges first, so that no task sorts a whole hot group."""
    parts = 64
    rows = df.withColumn("_order", hash_order(key, seed)).withColumn("_part", F.floor(hash_share(F.col("_order")) * parts))
    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy("_order", key))).where(F.col("_n") <= cap)
    return inside.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("_order", key))).where(F.col("_n") <= cap).drop("_order", "_part", "_n")


def uniform_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key).limit(n)


def holdout_split(df: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``part``: the first ceil(share * n) rows of each label by hash are the holdout, one at least stays."""
    rows = ranked_in_parts(df, label, key, seed)
    quota = F.least(F.ceil(F.col("n") * share), F.col("n") - 1)
    return rows.withColumn("part", F.when(F.col("rn") <= quota, "holdout").otherwise("train")).drop("rn", "n")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    return ranked_in_parts(df, label, key, seed).withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn", "n")


def group_folds(df: DataFrame, group: str, k: int, label: str | None = None) -> DataFrame:
    """``df`` with ``fold``; a group is in one fold.

    The heaviest groups (as many as ten to a fold) are dealt to the lightest fold, by label if there is one; all
    others by a hash. Only the heavy ones' counts come to the driver.
    """
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *([F.count_if(F.col(label) == x).alias(x) for x in LABELS] if label else []))
    heavy = counted.orderBy(F.desc("n"), group).limit(30 * k).collect()
    names = LABELS if label else ("n",)
    sums = [dict.fromkeys(names, 0) for _ in range(k)]
    dealt = []
    for row in heavy:
        def cost(i: int, row=row) -> tuple:
            after = [{x: s[x] + row[x] * (j == i) for x in names} for j, s in enumerate(sums)]
            return (sum(max(a[x] for a in after) - min(a[x] for a in after) for x in names), sum(sums[i].values()), i)

        best = min(range(k), key=cost)
        for x in names:
            sums[best][x] += row[x]
        dealt.append((row[group], best))
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame(dealt, f"`{group}` {kind}, _fold int") if dealt else None
    tail = F.pmod(F.xxhash64(group), F.lit(k)).cast("int")
    if table is None:
        return df.withColumn("fold", tail)
    return df.join(F.broadcast(table), group, "left").withColumn("fold", F.coalesce("_fold", tail)).drop("_fold")


def order_statistics(df: DataFrame, value: str, wanted, group: Column | None = None, bins: int = 1024) -> dict:
    """The values at some places (from 0) of each group's order, exactly; nulls don't count.

    ``wanted``: from a group's number of values to the places asked for. Each pass counts the values of the ranges that
    still hold a wanted place in bins and narrows these, so neither a task nor the driver holds all values. Returns
    (group, place) to value. Groups must be few.
    """
    rows = df.select((group if group is not None else F.lit(0)).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    ends = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    open_ = {(r["g"], k): (r["lo"], r["hi"], 0) for r in ends for k in wanted(r["n"])}
    found = {}
    kind = rows.schema["g"].dataType.simpleString()
    while open_:
        found |= {t: lo for t, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {t: r for t, r in open_.items() if r[0] < r[1]}
        if not open_:
            break
        ranges = df.sparkSession.createDataFrame(sorted({(g, lo, hi) for (g, _), (lo, hi, _) in open_.items()}, key=str), f"rg {kind}, lo double, hi double")
        inside = rows.join(F.broadcast(ranges), F.col("g").eqNullSafe(F.col("rg")) & F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counted: dict = {}
        for r in inside.groupBy("g", "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect():
            counted.setdefault((r["g"], r["lo"], r["hi"]), []).append((r["bin"], r["n"], r["least"], r["most"]))
        for (g, k), (lo, hi, below) in open_.items():
            for _, n, least, most in sorted(counted[g, lo, hi]):
                if k < below + n:
                    open_[g, k] = (least, most, below)
                    break
                below += n
    return found


def percentiles(df: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """``group`` (few values) and q, the interpolated percentiles of its values."""
    sizes: dict = {}

    def wanted(n: int) -> list[int]:
        return sorted({k for p in shares for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))})

    kind = df.schema[group].dataType.simpleString()
    for r in df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r[group]] = r["n"]
    at = order_statistics(df, value, wanted, F.col(group))
    rows = []
    for g, n in sizes.items():
        q = []
        for p in shares:
            place = p * (n - 1)
            low = at[g, int(place)]
            q.append(low + (place - int(place)) * (at[g, min(int(place) + 1, n - 1)] - low))
        rows.append((g, q))
    return df.sparkSession.createDataFrame(rows, f"`{group}` {kind}, q array<double>")


def time_split(df: DataFrame, time: str, key: str, share: float = 0.8) -> DataFrame:
    """``df`` with ``part``: the earliest rows, exactly floor(share * n), are train; ties in time go by identifier."""
    quota = int(share * df.count())
    last = order_statistics(df, time, lambda n: [min(quota, n) - 1] if quota > 0 else [])
    if not last:
        return df.withColumn("part", F.lit("test"))
    cut = next(iter(last.values()))
    below = df.where(F.col(time) < cut).count()
    tied = df.where(F.col(time) == cut).select(key).orderBy(key).limit(max(quota - below, 0)).withColumn("_in", F.lit(True))
    joined = df.join(tied, key, "left")
    return joined.withColumn("part", F.when((F.col(time) < cut) | F.col("_in"), "train").otherwise("test")).drop("_in")


def holdouts(df: DataFrame, source: str = "source", label: str = "label") -> DataFrame:
    """kind and holdout of each row's holdouts: leave its source out, and its (source, label) cell if the source has others."""
    several = df.groupBy(source).agg(F.count_distinct(label).alias("n_labels"))
    rows = df.join(several, source)
    names = F.array(F.struct(F.lit("loso").alias("kind"), F.col(source).alias("holdout")), F.when(F.col("n_labels") > 1, F.struct(F.lit("loco").alias("kind"), F.concat_ws("|", source, label).alias("holdout"))))
    return rows.select(*df.columns, F.inline(F.filter(names, lambda x: x.isNotNull())))


def rounds(sizes: DataFrame, size: str, n: int, points: int = 32) -> int:
    """The least number of rounds in which groups of these sizes give ``n`` rows (all rounds, if they have fewer)."""
    most, total = sizes.agg(F.max(size), F.sum(size)).first()
    if not total or total <= n:
        return most or 0
    low, high = 0, most  # low rounds give fewer than n, high ones enough
    while high - low > 1:
        asked = sorted({low + max(1, (high - low) * i // points) for i in range(1, points)} | {low + 1})
        given = sizes.agg(*[F.sum(F.least(F.col(size), F.lit(d))).alias(f"d{d}") for d in asked]).first()
        low, high = max([low, *(d for d in asked if given[f"d{d}"] < n)]), min([high, *(d for d in asked if given[f"d{d}"] >= n)])
    return high


def round_robin(df: DataFrame, group: str, key: str, n: int, parts: int = 64) -> DataFrame:
    """``n`` rows: the first of each group by key, then the second ones, and so on; the last round goes by group.

    How many rounds it takes comes from the groups' sizes. Groups are cut to so many rows in parts, then whole, so no
    task sorts a large group; rows of the last round compete by group only.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    last = rounds(sizes, "_size", n)
    if n <= 0 or last == 0:
        return df.limit(0)
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(key))
    cut = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("_rn", first(group, "_part")).where(F.col("_rn") <= last)
    rows = cut.withColumn("_rn", first(group)).where(F.col("_rn") <= last)
    before = sizes.agg(F.sum(F.least("_size", F.lit(last - 1)))).first()[0]
    tail = rows.where(F.col("_rn") == last).orderBy(group).limit(n - before)
    return rows.where(F.col("_rn") < last).unionByName(tail).drop("_part", "_rn")


def first_of_templates(df: DataFrame, cell: list[str], template: str, message: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each cell with distinct messages: one of each template first, then others by hash.

    Of each message and of each template only the first rows stay before cells are ranked: a template's first row, and
    of the others no more than n a cell, each in parts of the hash first.
    """
    order = [hash_order(key, seed), F.col(key)]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    part = F.floor(hash_share(hash_order(key, seed)) * 64)

    def first(rows: DataFrame, most: int, *by: str) -> DataFrame:
        cut = rows.withColumn("_part", part).withColumn("_rn", place(*by, "_part")).where(F.col("_rn") <= most)
        return cut.withColumn("_rn", place(*by)).where(F.col("_rn") <= most).drop("_part", "_rn")

    once = first(df, 1, *cell, message)
    leads = first(once, 1, *cell, template).withColumn("_t", F.lit(0))
    named = [*cell, template, message]
    same = [once[c].eqNullSafe(leads[c]) for c in named]
    others = first(once.join(leads.select(*named), same, "left_anti"), n, *cell).withColumn("_t", F.lit(1))
    both = first(leads, n, *cell).unionByName(others)
    ranked_ = both.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy("_t", *order)))
    return ranked_.where(F.col("_n") <= n).drop("_t", "_n")


def band_samples(df: DataFrame, value: str, edges: list[float], n: int, key: str, seed: int) -> DataFrame:
    """n rows of each band of ``value``: below the first edge, between edges, and from the last on."""
    band = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        band = F.when(F.col(value) < e, i).otherwise(band)
    return ranked(df.withColumn("band", band), ["band"], key, seed).where(F.col("rn") <= n).drop("rn", "_order")
