"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

1. Shingles are runs of five words, hashed. A shingle weighs ``(1 + ln tf) * idf`` with
   ``idf = 1 + ln(1 + N / df) / ln(1 + N)``; df is counted over all documents in 2^18 hashed features, so the table
   that is broadcast has a fixed size.
2. Every text gets 100 samples by improved consistent weighted sampling (Ioffe 2010), in 20 bands of 5. A sample's
   random numbers r, c and beta are drawn for each shingle from its hash (see ``Sampler``).
3. Equal texts are one node. Texts that share a band are candidates. Each candidate pair is verified by its exact
   weighted Jaccard similarity; linked nodes form classes (connected components by the smallest label).

Large groups need no pair for each two members. Each band has a leader, the text whose bands most others share, such
as the original of edited copies. Texts are tried with the leader they share most bands with, then, where classes still
differ, with their other leaders and with the next text by weight. What is left is decided by differences from a
reference (the leader, with what most of its group has otherwise put right): with H the reference and c(X) the weight
that X shares with it, X and Y share ``c(X) + c(Y) - w(H)`` and what their differences from H have in common. So texts
whose differences have nothing in common need no test beyond that of the text nearest to the reference, and all others
meet by prefix filtering over their differences, which loses no pair: first with one text of each such bucket, then all
whose classes still differ. Two texts of which one weighs less than 0.8 times the other can't be similar and aren't
paired. A pair in one class already needs no test, as it changes nothing.

Edge cases: a null text is a class of its own row; texts without words are alike only if equal; texts of one to four
words have one shingle, all their words; repeated rows are in one class. ``class_id`` is the smallest doc_id of the
class (null if it has none). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches, fresh, staged, word_hashes

FEATURES = 1 << 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEP = 1024  # shingles at once
CAP = 2.0  # the weight at which a sample's values are drawn; shingles that occur once weigh no more
FIRST = 6.0  # values up to this share of the expected least one are looked at first
SPLIT = 1000  # texts of a band that are joined in one part
MANY = 8  # members of a group whose reference is put right by their majority


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 5
    seed: int = 7


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(v: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` neighbours in ``v``."""
    k = len(v) - n + 1
    acc = v[:k].copy()
    for i in range(1, n):
        acc *= GOLDEN
        acc += v[i : i + k]
    return mix(acc)


def shingles(batch_column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row of word hashes its shingles (with repeats); an empty array if it has no words."""
    offsets = batch_column.offsets.to_numpy()
    flat = batch_column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    rolled = rolling(flat, n) if len(flat) >= n else flat[:0]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            yield rolled[a : b - n + 1]
        elif b > a:
            yield rolling(flat[a:b], int(b - a))
        else:
            yield flat[:0]


def document_frequencies(docs: DataFrame, params: MinHashParams) -> tuple[int, np.ndarray]:
    """The number of documents with words, and of those with each hashed feature: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            seen = []
            for s in shingles(batch.column(0), params.shingle):
                if len(s):
                    n += 1
                    seen.append(np.unique(s.astype(np.int64) & (FEATURES - 1)))
            if seen:
                df += np.bincount(np.concatenate(seen), minlength=FEATURES)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["feature", "n"])

    rows = docs.select(word_hashes(F.col("text")).alias("w")).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = rows["feature"].to_numpy(), rows["n"].to_numpy()
    table = np.zeros(FEATURES, np.int64)
    table[feature[feature >= 0]] = n[feature >= 0]
    return int(n[feature < 0].sum()), table


def inverse_frequencies(n: int, df: np.ndarray) -> np.ndarray:
    n = max(n, 1)
    return (1 + np.log1p(n / np.maximum(df, 1)) / np.log1p(n)).astype(np.float32)


def weights(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and their weights."""
    distinct, tf = np.unique(hashes, return_counts=True)
    return distinct, (1 + np.log(tf)) * idf[distinct.astype(np.int64) & (FEATURES - 1)]


class Sampler:
    """Improved consistent weighted sampling.

    A sample's value for a shingle of weight S is ``c / z``, where z is the first point above S of a grid of logarithms
    with the random step r and offset beta. At the weight ``CAP`` it is exponentially distributed, say A, and with two
    more exponential numbers E and u it gives the rest: ``c = A * CAP + E``, the grid's points around ln CAP lie u below
    and ``ln(c / (A * CAP))`` above it, and r is their sum. That is the distribution of r, c and beta of the method; all
    three numbers come from the hash of shingle and sample. As a value doesn't grow with the weight, a shingle that weighs
    ``CAP`` at most can't have the least value if its A is larger than another's value. So only small A are looked at
    first, and a sample without a small one is taken from all shingles.
    """

    def __init__(self, params: MinHashParams):
        self.k, self.bands, self.rows = params.bands * params.rows, params.bands, params.rows
        rng = np.random.Generator(np.random.PCG64(params.seed))
        self.salt = rng.integers(0, 1 << 32, self.k, dtype=np.uint32)
        self.long_salt = rng.integers(0, 1 << 63, self.k).astype(np.uint64)

    def _uniform(self, low: np.ndarray, samples: np.ndarray | slice) -> np.ndarray:
        """32 random bits for each of ``samples`` and each shingle."""
        v = low[None, :] ^ self.salt[samples][:, None]
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0xC2B2AE35)
        return v

    def _values(self, j: np.ndarray, shingle: np.ndarray, log_w: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the values of samples ``j`` of shingles, and the levels of the grid's points below their weights."""
        x = mix(shingle ^ self.long_salt[j])
        u = -np.log(((x >> np.uint64(32)).astype(float) + 0.5) * 2.0**-32)
        e = -np.log(((x & np.uint64(0xFFFFFFFF)).astype(float) + 0.5) * 2.0**-32)
        a = -np.log1p(-(bits.astype(float) + 0.5) * 2.0**-32)
        log_c = np.log(a + e)
        r = u + log_c - np.log(a)
        base = np.log(CAP) - u
        level = np.floor((log_w - base) / r)
        return log_c - base - (level + 1) * r, level

    def samples(self, distinct: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each of the k hash functions a 64-bit value of the sampled shingle and its level."""
        best, found = np.full(self.k, np.inf), np.zeros(self.k, np.uint64)
        log_w = np.log(weight)
        low = (mix(distinct) >> np.uint64(32)).astype(np.uint32)

        def take(j: np.ndarray, i: np.ndarray, bits: np.ndarray) -> None:
            """The least value of each sample; ``j`` is in order, and of equal ones the smallest hash comes first."""
            if not len(j):
                return
            value, level = self._values(j, distinct[i], log_w[i], bits)
            begin = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
            least = np.minimum.reduceat(value, begin)
            at = np.flatnonzero(value == np.repeat(least, np.diff(np.append(begin, len(j)))))
            at = at[np.append(True, j[at][1:] != j[at][:-1])]
            at = at[value[at] < best[j[at]]]
            best[j[at]] = value[at]
            found[j[at]] = mix(distinct[i[at]] + GOLDEN * level[at].astype(np.int64).view(np.uint64))

        limit = FIRST / weight.sum()
        top = np.uint32(min(2.0**32 - 1, -np.expm1(-CAP * limit) * 2.0**32))
        heavy = weight > CAP
        for at in range(0, len(distinct), STEP):
            bits = self._uniform(low[at : at + STEP], slice(None))
            chosen = bits <= top
            if (h := heavy[at : at + STEP]).any():
                chosen[:, h] = True
            flat = np.flatnonzero(chosen)
            j, i = np.divmod(flat, bits.shape[1])
            take(j, i + at, bits.ravel()[flat])
        rest = np.flatnonzero(best > np.log(limit))
        for at in range(0, len(distinct) if len(rest) else 0, STEP):
            bits = self._uniform(low[at : at + STEP], rest)
            n = bits.shape[1]
            take(np.repeat(rest, n), np.tile(np.arange(at, at + n), len(rest)), bits.ravel())
        return found

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        acc = np.arange(1, self.bands + 1, dtype=np.uint64) * GOLDEN
        for row in samples.reshape(self.bands, self.rows).T:
            acc = mix(acc ^ row)
        return acc.view(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray, params: MinHashParams) -> DataFrame:
    """doc_id, node (a digest of the text), total weight and band keys of each document that has words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(params)
        for batch in batches:
            total, keys = np.zeros(batch.num_rows, np.float32), [None] * batch.num_rows
            for i, s in enumerate(shingles(batch.column(2), params.shingle)):
                if len(s):
                    distinct, weight = weights(s, shared.value)
                    total[i] = weight.sum()
                    keys[i] = sampler.band_keys(sampler.samples(distinct, weight))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "weight", "bands"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of().alias("node"), word_hashes(F.col("text")).alias("w"))
    return columns.mapInArrow(sign, "doc_id long, node binary, weight float, bands array<long>")


def node_of():
    """Equal texts are one node: 128 bits of digest."""
    return F.unhex(F.md5("text"))


def _sets(docs: DataFrame, nodes: DataFrame, params: MinHashParams) -> DataFrame:
    """node and its sorted shingles (32 bits, with repeats), for those of ``nodes`` (doc_id, node)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of().alias("node"), "text")
    wanted = nodes.select(F.col("doc_id").alias("d"), F.col("node").alias("m"))
    chosen = texts.join(wanted, texts["node"].eqNullSafe(wanted["m"]) & texts["doc_id"].eqNullSafe(wanted["d"]), "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.sort(s.astype(np.uint32)).view(np.int32) for s in shingles(batch.column(1), params.shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["node", "sh"])

    return chosen.select("node", word_hashes(F.col("text")).alias("w")).mapInArrow(cut, "node binary, sh array<int>")


def jaccard(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """The weighted Jaccard similarity of two arrays of sorted 32-bit shingles with repeats."""
    x, n = np.unique(a.view(np.uint32), return_counts=True)
    y, m = np.unique(b.view(np.uint32), return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    wx = (1 + np.log(n)) * idf[x & (FEATURES - 1)]
    wy = (1 + np.log(m)) * idf[y & (FEATURES - 1)]
    least = np.minimum(wx[i], wy[j]).sum()
    return float(least / max(wx.sum() + wy.sum() - least, 1e-12))


def _verified(pairs: DataFrame, sets: DataFrame, idf: np.ndarray, params: MinHashParams) -> DataFrame:
    """Those of ``pairs`` (a, b) whose similarity reaches the threshold."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("sh").alias("sb")), "b").select("a", "b", "sa", "sb")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = []
            for c in (batch.column(2), batch.column(3)):
                o, v = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
                views.append([v[i:j] for i, j in zip(o[:-1], o[1:], strict=True)])
            good = pa.array([jaccard(x, y, shared.value) >= params.threshold for x, y in zip(*views, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    return both.mapInArrow(test, "a binary, b binary")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node and label, the smallest node that it is linked with, directly or not. ``labels``: those of earlier links."""
    if labels is not None and links.isEmpty():
        return labels
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    nodes = both.select(F.col("a").alias("node"))
    if labels is not None:
        nodes = nodes.union(labels.select("node"))
    now = nodes.distinct().select("node", F.col("node").alias("label"))
    if labels is not None:
        now = now.join(labels.withColumnRenamed("label", "old"), "node", "left").select("node", F.coalesce("old", "label").alias("label"))
    now = staged(now, "labels")
    while True:
        # The least label among a node's neighbours, then the label of that label's own group.
        beside = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        known = now.join(beside, "node", "left").select("node", "label", F.least("label", F.coalesce("seen", "label")).alias("least"))
        # A group follows the least label that any of its nodes has seen.
        group = known.groupBy("label").agg(F.min("least").alias("to"))
        moved = staged(known.join(group, "label").select("node", "label", "to"), "labels")
        jump = moved.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = staged(moved.join(jump, "to", "left").select("node", "label", F.coalesce("further", "to").alias("next")), "labels")
        changed = after.where(F.col("label") != F.col("next")).limit(1).count()
        now = after.select("node", F.col("next").alias("label"))
        if not changed:
            return now


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """doc_id and class_id of every document."""
    return _classes(docs, params).select("doc_id", "class_id")


def _classes(docs: DataFrame, params: MinHashParams) -> DataFrame:
    """doc_id, node and class_id of every document, and whether its text is the one that stands for its class."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    n, df = document_frequencies(docs, params)
    idf = inverse_frequencies(n, df)
    signed = staged(signatures(docs, idf, params), "signatures")
    some = signed.where(F.col("bands").isNotNull())
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    banded = nodes.select("node", "doc_id", "weight", F.explode("bands").alias("key"))
    shared_keys = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only bands that two texts or more share: from here on the tables are small beside the input.
    bucket = staged(banded.join(shared_keys, "key"), "bands")
    sets = staged(_sets(docs, bucket.select("doc_id", "node").distinct(), params).dropDuplicates(["node"]), "sets")

    # A band's leader is the text whose bands most others share. Bands of many texts are joined in parts.
    rank = bucket.groupBy("node").agg(F.sum("n").alias("rank"))
    lead = bucket.join(rank, "node").groupBy("key").agg(F.max(F.struct("rank", "node", "weight")).alias("l"), F.max("n").alias("n"))
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    leaders = lead.select("key", F.col("l.node").alias("ref"), F.col("l.weight").alias("wr"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    member = staged(bucket.withColumn("part", F.pmod(F.hash("node"), parts)).join(leaders, ["key", "part"]).select("key", "part", "ref", "wr", "node", "weight"), "members")
    led = member.where((F.col("node") != F.col("ref")) & _fits("weight", "wr", params)).groupBy(F.col("ref").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    led = staged(led, "led")

    # Each text with the leader that it shares most bands with.
    most = led.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    labels = components(staged(_verified(most, sets, idf, params), "links"))

    # With its other leaders and with the next text by weight, where the classes still differ.
    place = Window.partitionBy("key", "part").orderBy("weight", "node")
    beside = member.select(F.col("node").alias("b"), F.col("weight").alias("wb"), F.lag(F.struct("node", "weight")).over(place).alias("p")).where(F.col("p").isNotNull())
    chain = beside.where(_fits("wb", "p.weight", params)).select(F.col("p.node").alias("a"), "b")
    tried = led.select("a", "b").union(chain).distinct()
    labels = components(staged(_verified(_apart(tried, labels), sets, idf, params), "links"), labels)

    # By differences from the leader, in bands whose texts are still in different classes.
    groups = _open(member, ["key"], labels).select("ref", "node").distinct()
    rows, near = _differences(staged(groups, "groups"), sets, idf, params)
    labels = components(staged(_verified(_apart(near, labels), sets, idf, params), "links"), labels)
    for pairs in (_with_one, _with_all):
        found = pairs(_open(rows, ["ref", "atom"], labels), params)
        labels = components(staged(_verified(_apart(found, labels), sets, idf, params), "links"), labels)

    # Every document gets its node's class; equal texts without words are a class, null texts are alone.
    firsts = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first")).join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    least = firsts.groupBy("label").agg(F.min(F.struct(F.col("first").isNull(), "first", "node")).alias("m"))
    classes = firsts.join(least, "label").select("node", F.col("m.first").alias("class_id"), (F.col("node") == F.col("m.node")).alias("stands"))
    return signed.select("doc_id", "node").join(classes, "node", "left").select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("stands", F.lit(True)).alias("stands"))


def _fits(x: str, y: str, params: MinHashParams):
    return F.least(x, y) >= F.lit(params.threshold - 1e-4) * F.greatest(x, y)


def _open(rows: DataFrame, key: list[str], labels: DataFrame) -> DataFrame:
    """``rows`` with the labels of their nodes, where a key has two or more."""
    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*key)
    return named.join(several, key)


def _differences(groups: DataFrame, sets: DataFrame, idf: np.ndarray, params: MinHashParams) -> tuple[DataFrame, DataFrame]:
    """What texts of a group (ref, node) have otherwise than its reference, and the pairs (a, b) that need no such row.

    A row is one shingle of a text's difference: one that the reference lacks (an even ``atom``), or has (odd). Of a
    difference only those rows are left after which a pair's differences can still have enough in common.
    """
    t = params.threshold - 1e-4
    plain = staged(_compared(groups, None, sets, idf), "compared")
    size = groups.groupBy("ref").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= MANY)
    other = plain.join(size, "ref").select("ref", "members", F.explode(F.arrays_zip("atoms", "times")).alias("x"))
    usual = other.groupBy("ref", F.shiftright("x.atoms", 1).cast("int").alias("s"), F.col("x.times").alias("times")).agg(F.count(F.lit(1)).alias("n"), F.max("members").alias("members"))
    fixes = staged(usual.where("2 * n > members").groupBy("ref").agg(F.collect_list(F.struct("s", "times")).alias("fix")), "fixes")
    if not fixes.isEmpty():
        kept = plain.join(fixes.select("ref"), "ref", "left_anti")
        plain = staged(kept.union(_compared(groups.join(fixes.select("ref"), "ref", "left_semi"), fixes, sets, idf)), "compared")
    # f(X) + f(Y) reaches the reference's weight if what both share with it is enough.
    known = plain.withColumn("f", F.col("common") - t / (1 + t) * F.col("weight"))
    best = known.groupBy("ref").agg(F.max(F.struct("f", "node")).alias("best")).select("ref", F.col("best.f").alias("most"), F.col("best.node").alias("nearest"))
    known = known.join(best, "ref")
    inner = F.col("f") + F.col("most") >= F.col("whole") - 1e-6
    near = known.where(inner & (F.col("nearest") != F.col("node"))).select(F.col("nearest").alias("a"), F.col("node").alias("b"))
    need = F.when(inner, F.col("most") - F.col("f")).otherwise(F.col("whole") - F.col("f") - F.col("most")) - 1e-6
    # Texts whose differences share nothing outside the reference share no more than either does with the reference.
    within = F.col("common") >= t * F.col("weight") - 1e-6
    kept = F.filter(F.arrays_zip("atoms", "rests"), lambda x: (x["rests"] >= F.col("need")) & (F.col("within") | (x["atoms"] % 2 == 0)))
    size = F.floor(F.log("weight") / F.lit(float(-np.log(t)))).cast("int")
    rows = known.withColumn("need", need).withColumn("within", within).select("ref", "node", "weight", "common", "whole", "f", size.alias("size"), F.explode(kept).alias("x"))
    return staged(rows.select("ref", "node", "weight", "common", "whole", "f", "size", F.col("x.atoms").alias("atom"), F.col("x.rests").alias("rest")), "differences"), near


def _compared(groups: DataFrame, fixes: DataFrame | None, sets: DataFrame, idf: np.ndarray) -> DataFrame:
    """Weights of node, of its reference and of what they share, and the difference's shingles: new ones first, the rarest first.

    ``times``: how often the node has the shingle. ``rests``: the weight of the difference from there on.
    """
    shared = groups.sparkSession.sparkContext.broadcast(idf)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ours, theirs, fix in zip(*[_slices(batch.column(i)) for i in (2, 3)], batch.column(4).to_pylist(), strict=True):
                x, n = np.unique(ours.view(np.uint32), return_counts=True)
                y, m = np.unique(theirs.view(np.uint32), return_counts=True)
                right = np.array([f["s"] for f in fix or ()], np.int64).astype(np.uint32)
                every = np.unique(np.concatenate([x, y, right]))
                tx, ty = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
                tx[np.searchsorted(every, x)], ty[np.searchsorted(every, y)] = n, m
                ty[np.searchsorted(every, right)] = [f["times"] for f in fix or ()]
                rarity = shared.value[every & (FEATURES - 1)].astype(float)
                wx, wy = (np.where(k > 0, 1 + np.log(np.maximum(k, 1)), 0) * rarity for k in (tx, ty))
                own = np.flatnonzero(tx != ty)
                gone = wx[own] < wy[own]
                own = own[np.lexsort((every[own], -rarity[own], gone))]
                atoms = every[own].view(np.int32).astype(np.int64) * 2 + (wx[own] < wy[own])
                rows.append((wx.sum(), np.minimum(wx, wy).sum(), wy.sum(), atoms, np.cumsum(np.abs(wx - wy)[own][::-1])[::-1], tx[own]))
            types = [pa.float64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
            columns = [pa.array([r[i] for r in rows], ty) for i, ty in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["ref", "node", "weight", "common", "whole", "atoms", "rests", "times"])

    given = groups.join(sets.select("node", F.col("sh").alias("ours")), "node").join(sets.select(F.col("node").alias("ref"), F.col("sh").alias("theirs")), "ref")
    given = given.join(fixes, "ref") if fixes is not None else given.withColumn("fix", F.lit(None).cast("array<struct<s:int,times:bigint>>"))
    columns = given.select("ref", "node", "ours", "theirs", "fix")
    return columns.mapInArrow(compare, "ref binary, node binary, weight double, common double, whole double, atoms array<long>, rests array<double>, times array<long>")


def _slices(column: pa.Array) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _can(params: MinHashParams):
    """Whether two rows of one shingle, of which the second's columns end in 2, may belong to similar texts."""
    t = params.threshold - 1e-4
    need = F.col("whole") - F.col("f") - F.col("f2") - 1e-6
    both = F.least("common", "common2") >= t / (1 + t) * (F.col("weight") + F.col("weight2")) - 1e-6
    return (F.col("label") != F.col("label2")) & (F.least("rest", "rest2") >= need) & _fits("weight", "weight2", params) & (both | (F.col("atom") % 2 == 0))


def _with_one(rows: DataFrame, params: MinHashParams) -> DataFrame:
    """Pairs (a, b) of texts with that of their bucket which is nearest to the reference."""
    columns = ["f", "node", "label", "weight", "common", "rest"]
    first = rows.groupBy("ref", "atom", "size").agg(F.max(F.struct(*columns)).alias("m")).select("ref", "atom", "size", *[F.col(f"m.{c}").alias(f"{c}2") for c in columns])
    return rows.join(first, ["ref", "atom", "size"]).where(_can(params)).select(F.col("node2").alias("a"), F.col("node").alias("b")).distinct()


def _with_all(rows: DataFrame, params: MinHashParams) -> DataFrame:
    """Pairs (a, b) of all texts of a bucket and of those next to it by weight that may be similar."""
    columns = ["f", "node", "label", "weight", "common", "rest"]
    near = F.array(F.col("size"), F.col("size") + 1, F.col("size") - 1)
    other = rows.select("ref", "atom", F.explode(near).alias("size"), *[F.col(c).alias(f"{c}2") for c in columns])
    return rows.join(other, ["ref", "atom", "size"]).where((F.col("node") < F.col("node2")) & _can(params)).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose texts are in different classes."""
    x = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    y = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def keep_one(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """One document of each class stays: that whose doc_id is the class's, or of several such texts the one of least
    digest; of its repeated rows one, too.

    Of rows whose identifier is null, those with equal texts are one, if any of them is a class of its own.
    """
    key, kept, number = fresh(docs, "row_key", "kept_key", "number")
    keep = _classes(docs, params).where(F.col("stands") & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(_row_key(F.col("doc_id"), F.hex("node")).alias(kept)).distinct()
    # One key, never null, for the join and the window, so that whole documents are dealt out once.
    keyed = docs.withColumn(key, _row_key(docs["doc_id"].cast("long"), F.md5(docs["text"])))
    stays = keyed.join(keep, keyed[key] == keep[kept], "left_semi")
    # Rows with one identifier are few; of equal texts among them one stays. Rows without a text all stay.
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))
    return stays.withColumn(number, order).where((F.col(number) == 1) | F.col("text").isNull()).drop(key, number)


def _row_key(doc_id, digest):
    """A row's identifier and the digest of its text as one string, also where either is null."""
    return F.concat(F.coalesce(F.lower(digest), F.lit("")), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
