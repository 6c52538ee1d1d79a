"""Ranked lexical search: exact, over posting lists in blocks of similar documents.

A document's impact for a term is the integer that the term adds to a score; a score sums impacts by the item's terms.

1. ``_vectors``: one pass turns each text into its length and the terms that items have, with their counts. Numbers of
   documents and terms and the lists' lengths come from that table.
2. ``_impacts``: impacts, and 16 signs of random projections of them, by which the table is range-partitioned and
   sorted, so that similar documents lie together. Of documents that are equal in all that counts, no more than the k
   with the smallest doc_id can be in a result; others go (before the shuffle, where Spark limits ranks).
3. Seeds: the documents of an item's rarest lists are scored; the k-th best score is the item's bar. Lists whose greatest
   impacts together stay below the bar can't bring a document over it; all others are needed for that item.
4. ``_blocks``: each needed list is cut into cells of similar documents, by as many of the signs as make about
   ``block_docs`` postings a cell. A block's summary has the greatest impact of its documents for each term that shares an
   item with the list's term. Summaries are made by task, then merged by list, cell and term, and written.
5. An item's sum over a block's summary bounds the scores of all its documents. Blocks under the bar are skipped; the
   documents of the others, each once for an item, are scored exactly and ranked.

Nothing is lost: a bar is the k-th best of some documents, a document that reaches it has a needed list, and its block's
bound is no less than its score. Items are a stated query set: they are taken in blocks of ``block_chars`` characters,
whose terms are broadcast; what is collected (lists' lengths, greatest impacts, bars) has a row for each of their terms
or items.

Edge cases: null and empty texts have no terms and match nothing, and an item without terms has no rows; terms that no
document has add nothing; each row is a document of its own, so repeated rows follow each other in the ranks, null doc_ids
first; repeated equal items count once; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches, staged
from siftlog.llm.minhash import mix

#: What is no part of a term becomes a space, capitals A to Z become small.
PLAIN = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))
SIGNS = 16
CHUNK_POSTINGS = 1_000_000  # postings that a task holds while it makes blocks
RESULT = "item_id long, rank int, doc_id long, score long"


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    block_docs: int = 16
    seed_postings: int = 512
    block_chars: int = 8_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


@dataclass(frozen=True)
class Items:
    ids: list[int]
    terms: list[np.ndarray]  # distinct, ascending
    times: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]]) -> "Items":
        vocabulary: dict[bytes, int] = {}
        ids, terms, times = [], [], []
        for item_id, text in rows:
            counts = sorted((vocabulary.setdefault(t, len(vocabulary)), n) for t, n in Counter(terms_of(text)).items())
            if counts:
                ids.append(item_id)
                terms.append(np.array([t for t, _ in counts], np.int64))
                times.append(np.array([n for _, n in counts], np.int64))
        return cls(ids, terms, times, vocabulary)


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1))) if having else 0


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's values begin (and the last one's end), and all values."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def _vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n, terms (numbers, ascending) and tfs of every document with a term, and a digest of these three."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    names = ["doc_id", "n", "terms", "tfs", "node"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if words := terms_of(text.as_py()):
                    found = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                    own = np.array(found, np.int32).reshape(-1, 2)
                    rows.append((doc_id, len(words), own[:, 0], own[:, 1], hashlib.blake2b(own.tobytes() + len(words).to_bytes(8, "little"), digest_size=16).digest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    text = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return staged(text.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>, node binary"), "search-vectors")


def _impacts(vectors: DataFrame, items: Items, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """doc_id, key (signs), row (a number in the order of the keys), terms and impacts of the documents that can matter."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)
    random = mix(np.arange(1, len(items.vocabulary) + 1, dtype=np.uint64))
    directions = vectors.sparkSession.sparkContext.broadcast((random[:, None] >> np.arange(SIGNS, dtype=np.uint64) & np.uint64(1)).astype(np.int8) * 2 - 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, sides = shared.value, directions.value
        for batch in batches:
            begin, terms = _lists(batch.column(2))
            tf = _lists(batch.column(3))[1].astype(np.int64)
            m = np.array([25 + 75 * n * documents // length for n in batch.column(1).to_pylist()], np.int64)
            impacts = w[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(begin))))
            sums = np.add.reduceat(impacts[:, None] * sides[terms], begin[:-1], axis=0) if len(terms) else np.zeros((0, SIGNS))
            key = (sums > 0) @ (1 << np.arange(SIGNS)[::-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int32()), batch.column(2), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(impacts))], names=["doc_id", "key", "terms", "impacts"])

    first = F.row_number().over(Window.partitionBy("node").orderBy("doc_id"))
    least = vectors.where("size(terms) > 0").withColumn("place", first).where(F.col("place") <= k).select("doc_id", "n", "terms", "tfs")
    weighed = least.mapInArrow(weigh, "doc_id long, key int, terms array<int>, impacts array<long>")
    ordered = weighed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    return staged(ordered.withColumn("row", F.monotonically_increasing_id()), "search-impacts")


def _greatest(impacts: DataFrame, n: int) -> np.ndarray:
    """The greatest impact of each term."""

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(n, np.int64)
        for batch in batches:
            np.maximum.at(top, _lists(batch.column(0))[1], _lists(batch.column(1))[1])
        used = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(top[used])], names=["term", "top"])

    out = np.zeros(n, np.int64)
    for term, top in impacts.select("terms", "impacts").mapInArrow(greatest, "term int, top long").groupBy("term").agg(F.max("top")).collect():
        out[term] = top
    return out


class _Scorer:
    """Exact scores of documents of a batch for one item after the other."""

    def __init__(self, items: Items):
        self.items, self.times = items, np.zeros(len(items.vocabulary), np.int64)

    def scores(self, item: int, rows: np.ndarray, begin: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        size = begin[rows + 1] - begin[rows]
        start = np.cumsum(size) - size
        at = np.repeat(begin[rows] - start, size) + np.arange(size.sum())
        self.times[self.items.terms[item]] = self.items.times[item]
        out = np.add.reduceat(self.times[terms[at]] * impacts[at], start)
        self.times[self.items.terms[item]] = 0
        return out


def _owners(pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For (term, item) pairs: where each term's items begin, and the items."""
    own = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.searchsorted(own[:, 0], np.arange(n + 1)), own[:, 1]


def _bars(impacts: DataFrame, items: Items, having: np.ndarray, weights: np.ndarray, params: SearchParams) -> np.ndarray:
    """A score for each item that at least k documents reach, 1 where fewer are known."""
    pairs = []
    for i, terms in enumerate(items.terms):
        total = 0
        for t in sorted((t for t in terms.tolist() if having[t] and weights[t] > 0), key=lambda t: having[t]):
            pairs.append((t, i))
            total += having[t]
            if total >= params.seed_postings:
                break
    owners = _owners(pairs, len(items.vocabulary))
    shared = impacts.sparkSession.sparkContext.broadcast((items, owners))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (first, owner) = shared.value
        scorer = _Scorer(items)
        for batch in batches:
            begin, terms = _lists(batch.column(0))
            values, document = _lists(batch.column(1))[1], np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            many = np.diff(first)[terms]
            at = np.repeat(np.arange(len(terms)), many)
            which = owner[np.repeat(first[terms] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            for i in np.unique(which).tolist():
                found = scorer.scores(i, np.unique(document[at[which == i]]), begin, terms, values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i), pa.int32()), pa.array(found)], names=["item", "score"])

    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    ranked = impacts.select("terms", "impacts").mapInArrow(score, "item int, score long").withColumn("place", place)
    bars = np.ones(len(items.ids), np.int64)
    for item, bar in ranked.where(F.col("place") <= params.k).where(F.col("place") == params.k).select("item", "score").collect():
        bars[item] = max(1, bar)
    return bars


def _needed(items: Items, top: np.ndarray, bars: np.ndarray) -> list[np.ndarray]:
    """Of each item the terms that a document over its bar must have one of."""
    out = []
    for terms, times, bar in zip(items.terms, items.times, bars.tolist(), strict=True):
        most = top[terms] * times
        order = np.argsort(most, kind="stable")
        out.append(terms[order][np.cumsum(most[order]) >= bar])
    return out


def _blocks(impacts: DataFrame, beside: dict[int, np.ndarray], shifts: np.ndarray) -> DataFrame:
    """list, cell, term and top: the greatest impact for each term in ``beside[list]`` of the list's documents in the cell."""
    shared = impacts.sparkSession.sparkContext.broadcast((beside, shifts))

    def summaries(begin: np.ndarray, terms: np.ndarray, values: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        beside, shifts = shared.value
        document = np.repeat(np.arange(len(keys)), np.diff(begin))
        order = np.argsort(terms, kind="stable")
        lists, starts = np.unique(terms[order], return_index=True)
        wanted = np.zeros(len(shifts), bool)
        for t, a, b in zip(lists.tolist(), starts.tolist(), [*starts[1:].tolist(), len(terms)], strict=True):
            if t not in beside:
                continue
            rows = document[order[a:b]]  # ascending, as the order is stable
            size = begin[rows + 1] - begin[rows]
            at = np.repeat(begin[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            wanted[beside[t]] = True
            kept = wanted[terms[at]]
            wanted[beside[t]] = False
            at, cell = at[kept], np.repeat(keys[rows] >> shifts[t], size)[kept].astype(np.int64)
            both = cell * len(shifts) + terms[at]
            by = np.argsort(both, kind="stable")
            one, where = np.unique(both[by], return_index=True)
            most = np.maximum.reduceat(values[at][by], where)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), t), pa.int32()), pa.array(one // len(shifts), pa.int32()), pa.array(one % len(shifts), pa.int32()), pa.array(most)], names=["list", "cell", "term", "top"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            begin, terms = _lists(table.column(1).chunk(0))
            yield from summaries(begin, terms, _lists(table.column(2).chunk(0))[1], table.column(0).to_numpy())

        for batch in batches:
            held.append(batch)
            total += len(batch.column(1).values)
            if total >= CHUNK_POSTINGS:
                yield from flush()
                held, total = [], 0
        if total:
            yield from flush()

    parts = impacts.select("key", "terms", "impacts").mapInArrow(make, "list int, cell int, term int, top long")
    return staged(parts.groupBy("list", "cell", "term").agg(F.max("top").alias("top")), "search-blocks")


def _candidates(impacts: DataFrame, blocks: DataFrame, items: Items, needed: list[np.ndarray], bars: np.ndarray, shifts: np.ndarray) -> DataFrame:
    """row and items (numbers): the documents of blocks whose bound reaches the item's bar."""
    spark = impacts.sparkSession
    lists = spark.createDataFrame([(int(t), i, int(bars[i])) for i, ts in enumerate(needed) for t in ts], "list int, item int, bar long")
    terms = spark.createDataFrame([(i, int(t), int(n)) for i, (ts, ns) in enumerate(zip(items.terms, items.times, strict=True)) for t, n in zip(ts, ns, strict=True)], "item int, term int, times long")
    # As long as the block of items.
    bounds = blocks.join(F.broadcast(lists), "list").join(F.broadcast(terms), ["item", "term"])
    open_ = bounds.groupBy("item", "list", "cell", "bar").agg(F.sum(F.col("top") * F.col("times")).alias("bound")).where("bound >= bar").groupBy("list", "cell").agg(F.collect_list("item").alias("items"))
    cuts = spark.createDataFrame([(int(t), int(shifts[t])) for t in sorted({int(t) for ts in needed for t in ts})], "list int, shift int")
    postings = impacts.select("row", "key", F.explode("terms").alias("list")).join(F.broadcast(cuts), "list").select("list", "row", F.expr("shiftright(key, shift)").alias("cell"))
    return postings.join(open_, ["list", "cell"]).select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.collect_list("item").alias("items"))


def _ranked(impacts: DataFrame, candidates: DataFrame, items: Items, params: SearchParams) -> DataFrame:
    shared = impacts.sparkSession.sparkContext.broadcast(items)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            begin, terms = _lists(batch.column(1))
            values = _lists(batch.column(2))[1]
            first, which = _lists(batch.column(3))
            document = np.repeat(np.arange(len(first) - 1), np.diff(first))
            order = np.argsort(which, kind="stable")
            there, starts = np.unique(which[order], return_index=True)
            for i, rows in zip(there.tolist(), np.split(document[order], starts[1:]), strict=True):
                found = scorer.scores(i, rows, begin, terms, values)
                ids = batch.column(0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array([scorer.items.ids[i]] * len(rows), pa.int64()), pa.array(np.full(len(rows), i), pa.int32()), ids, pa.array(found)], names=["item_id", "item", "doc_id", "score"])

    scored = impacts.join(candidates, "row").select("doc_id", "terms", "impacts", "items").mapInArrow(score, "item_id long, item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
    return scored.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= params.k).select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, items: Items, params: SearchParams) -> DataFrame | None:
    n = len(items.vocabulary)
    vectors = _vectors(docs, items) if n else None
    documents, length = vectors.agg(F.count("*"), F.sum("n")).first() if vectors is not None else (0, 0)
    if not documents:
        return None
    having = np.zeros(n, np.int64)
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        having[term] = count
    weights = np.array([weight(documents, h) for h in having.tolist()], np.int64)
    impacts = _impacts(vectors, items, weights, documents, length, params.k)
    bars = _bars(impacts, items, having, weights, params)
    needed = _needed(items, _greatest(impacts, n), bars)
    beside: dict[int, np.ndarray] = {}
    for terms, lists in zip(items.terms, needed, strict=True):
        for t in lists.tolist():
            beside[t] = terms if t not in beside else np.union1d(beside[t], terms)
    bits = np.clip(np.ceil(np.log2(np.maximum(having, 1) / params.block_docs)), 0, SIGNS).astype(np.int64)
    blocks = _blocks(impacts, beside, SIGNS - bits)
    return _ranked(impacts, _candidates(impacts, blocks, items, needed, bars, SIGNS - bits), items, params)


def search(docs: DataFrame, items: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents for each item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // params.block_chars))
    out = None
    for i in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).select("item_id", F.col("text").cast("binary")).collect()
        part = _search(docs, Items.of(sorted(((r[0], bytes(r[1])) for r in rows), key=lambda r: (r[0] is not None, r))), params)
        if part is not None:
            out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], RESULT)
