"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Words are lower case without punctuation. Every run of three words of a test item can be a seed; one pass over the
documents counts how often each occurs there. Of these the rare ones are kept, measured by the item's own: those that
few items have (16, or four times as many as the item's rarest), and of them those that the documents don't have far
more often than the item's median seed, so that half of an item's seeds stay, however common its text is. A second
pass looks up the documents' runs among the rare seeds and, where two different seeds of an item (or one, of an item that
keeps less than four of more) lie within one and a half times its length, cuts out the passage. So a template that thousands of items fill in meets a
document only where the filled-in words do. Passages are aligned with the item by Smith-Waterman over words (match 2,
mismatch -1, gap -1); the score is the best alignment's share of a perfect one.

The benchmark is a stated query set: its distinct texts are taken in blocks of ``block_words`` words, each broadcast
in turn.

Edge cases: null and empty documents and items match nothing; an item of fewer than three words has itself as seed;
repeated items and documents give a row for each distinct pair of identifiers; the best passage of a pair counts, and
of equal ones the first; whole texts are searched, whatever their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches, fresh, staged
from siftlog.llm.minhash import node_of, rolling


#: An item that keeps fewer seeds than it has, and fewer than so many, is met by one of them.
ENOUGH = 4


@dataclass(frozen=True)
class DecontaminationParams:
    seed_words: int = 3
    threshold: float = 0.5
    few_items: int = 16  # a seed of so many items is rare
    more_items: int = 4  # as is one of so many times the items that the item's rarest seed has
    more_often: int = 16  # and isn't so many times as frequent in the documents as the item's median seed
    block_words: int = 2_000_000


def plain_words(text: Column) -> Column:
    """Hashes of the words in lower case without punctuation."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.transform(F.array_remove(F.split(bare, " "), ""), lambda w: F.xxhash64(w))


@dataclass(frozen=True)
class Seeds:
    items: list[np.ndarray]
    ids: np.ndarray
    hashes: np.ndarray  # distinct, in order
    begin: np.ndarray  # where each one's owners begin, and where the last one's end
    item: np.ndarray  # of each owner, with the seed's place in it
    place: np.ndarray
    need: np.ndarray  # of each item: how many different seeds a passage must have


def _ordered(items: list[np.ndarray], ids: np.ndarray, h: np.ndarray, item: np.ndarray, place: np.ndarray, all_of: np.ndarray | None = None) -> Seeds:
    """``all_of``: how many seeds each item has in all. Two of them are needed, or one where so few are left that a copy
    may have no more."""
    kept = np.bincount(item, minlength=len(items))
    need = np.where((kept < 2) | (kept < ENOUGH) & (kept < (kept if all_of is None else all_of)), 1, 2)
    order = np.lexsort((place, item, h))
    h, item, place = h[order], item[order], place[order]
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return Seeds(items, ids, h[begin], np.append(begin, len(h)), item, place, need)


def make_seeds(rows: list, n: int) -> Seeds:
    """Every seed of the items ``rows`` (item_id and word hashes w)."""
    items = [np.array(r["w"], np.int64).view(np.uint64) for r in rows]
    runs = [rolling(w, min(n, len(w))) for w in items]
    item = np.repeat(np.arange(len(items)), [len(r) for r in runs])
    place = np.concatenate([np.arange(len(r)) for r in runs]) if runs else item
    return _ordered(items, np.array([r["item_id"] for r in rows], np.int64), np.concatenate(runs) if runs else np.zeros(0, np.uint64), item, place)


def rare_seeds(seeds: Seeds, often: np.ndarray, params: DecontaminationParams) -> Seeds:
    """Those of ``seeds`` that are rare, given how often each occurs in the documents."""
    if not len(seeds.hashes):
        return seeds
    seed = np.repeat(np.arange(len(seeds.hashes)), np.diff(seeds.begin))
    pairs = np.unique(np.stack([seed, seeds.item]), axis=1)
    owners = np.bincount(pairs[0], minlength=len(seeds.hashes))[seed]
    rarest = np.full(len(seeds.items), np.iinfo(np.int64).max)
    np.minimum.at(rarest, seeds.item, owners)
    few = owners <= np.maximum(params.few_items, params.more_items * rarest[seeds.item])
    item, n = seeds.item[few], often[seed[few]]
    order = np.lexsort((n, item))
    begin = np.searchsorted(item[order], np.arange(len(seeds.items)))
    size = np.bincount(item, minlength=len(seeds.items))
    median = n[order][begin + size // 2]  # every item has its rarest seed, so none is empty
    seldom = n <= params.more_often * (1 + median[item])
    chosen = np.flatnonzero(few)[seldom]
    return _ordered(seeds.items, seeds.ids, seeds.hashes[seed[chosen]], seeds.item[chosen], seeds.place[chosen], np.bincount(seeds.item, minlength=len(seeds.items)))


def _member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values lie that are among ``ordered``, and which they are."""
    if not len(ordered) or not len(values):
        return np.zeros(0, np.intp), np.zeros(0, np.intp)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    where = np.flatnonzero(ordered[at] == values)
    return where, at[where]


def _sizes(seeds: Seeds, n: int) -> list[int]:
    return sorted({min(n, len(w)) for w in seeds.items})


def hits(words: np.ndarray, seeds: Seeds, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``words`` where a seed begins, and which one. Hashes of runs of different sizes differ."""
    found = [_member(rolling(words, k), seeds.hashes) for k in sizes if len(words) >= k]
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.intp),) * 2


def passages(words: np.ndarray, seeds: Seeds, n: int, sizes: list[int]) -> Iterator[tuple[int, int, int]]:
    """Item, and begin and end of each passage that may be a copy of an item."""
    where, which = hits(words, seeds, sizes)
    if not len(where):
        return
    many = np.diff(seeds.begin)[which]
    owner = np.repeat(seeds.begin[which] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
    at, item, place = np.repeat(where, many), seeds.item[owner], seeds.place[owner]
    order = np.lexsort((place, at, item))
    at, item, place = at[order], item[order], place[order]
    length = np.array([len(seeds.items[i]) for i in item.tolist()])
    # Hits of one item that follow each other closely are one passage.
    new = np.append(True, (item[1:] != item[:-1]) | (at[1:] - at[:-1] > np.maximum(8, length[1:] * 3 // 2)))
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    different = np.bincount(np.unique(np.stack([run, place]), axis=1)[0], minlength=len(begin))
    need = seeds.need[item[begin]]
    end = np.append(begin[1:], len(at)) - 1
    for r in np.flatnonzero(different >= need).tolist():
        k = int(length[begin[r]])
        yield int(item[begin[r]]), max(0, int(at[begin[r]]) - k), int(at[end[r]]) + n + k


def align(item: np.ndarray, words: np.ndarray) -> float:
    """The best local alignment's score as a share of the item's own (2 a word)."""
    if not len(item) or not len(words):
        return 0.0
    best, row, step = 0.0, np.zeros(len(words) + 1), np.arange(len(words) + 1, dtype=float)
    for w in item:
        now = np.maximum(row - 1, 0)
        now[1:] = np.maximum(now[1:], row[:-1] + np.where(words == w, 2.0, -1.0))
        row = np.maximum.accumulate(now + step) - step  # gaps in the item
        best = max(best, float(row.max()))
    return best / (2 * len(item))


def _word_arrays(column: pa.Array) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def occurrences(docs: DataFrame, seeds: Seeds, n: int) -> np.ndarray:
    """How often each seed occurs in the documents; a table as long as the block's seeds."""
    shared, sizes = docs.sparkSession.sparkContext.broadcast(seeds), _sizes(seeds, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        total = np.zeros(len(s.hashes), np.int64)
        for batch in batches:
            which = [hits(w, s, sizes)[1] for w in _word_arrays(batch.column(0))]
            total += np.bincount(np.concatenate(which), minlength=len(total)) if which else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["seed", "n"])

    rows = docs.select(plain_words(F.col("text")).alias("w")).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(len(seeds.hashes), np.int64)
    often[rows["seed"].to_numpy()] = rows["n"].to_numpy()
    return often


def _block(docs: DataFrame, items: list, params: DecontaminationParams) -> DataFrame:
    n = params.seed_words
    every = make_seeds(items, n)
    rare = rare_seeds(every, occurrences(docs, every, n), params)
    shared, sizes = docs.sparkSession.sparkContext.broadcast(rare), _sizes(rare, n)
    names = ["doc_id", "node", "item", "words"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            rows = []
            for i, own in enumerate(_word_arrays(batch.column(2))):
                for item, a, b in passages(own, s, n, sizes):
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), item, own[a:b].view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=names)

    found = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of().alias("node"), plain_words(F.col("text")).alias("w")).mapInArrow(search, "doc_id long, node binary, item int, words array<long>"), "passages")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ids = shared.value.items, shared.value.ids
        for batch in batches:
            rows = []
            for doc_id, node, item, words in zip(*[batch.column(i).to_pylist() for i in range(3)], _word_arrays(batch.column(3)), strict=True):
                value = align(items[item], words)
                if value >= params.threshold:
                    rows.append((doc_id, node, int(ids[item]), value))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "node", "item", "score"])

    near = found.repartition(F.xxhash64("doc_id", "node", "item"))
    return near.mapInArrow(score, "doc_id long, node binary, item long, score double")


def contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, node, item and score of every document that holds a copy of an item; of equal items ``item`` is the first."""
    bounded_batches(docs.sparkSession)
    items = _items(benchmark).groupBy("w").agg(F.min("item_id").alias("item_id"))
    total = items.agg(F.sum(F.size("w"))).first()[0] or 0
    blocks = max(1, -(-total // params.block_words))
    out = None
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).orderBy("item_id").collect()
        part = _block(docs, rows, params)
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "node", "item").agg(F.max("score").alias("score"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text")).alias("w")).where("size(w) > 0 and item_id is not null").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, item_id and score: the contaminated documents only."""
    found = contaminated(docs, benchmark, params).groupBy("doc_id", "item").agg(F.round(F.max("score"), 6).alias("score"))
    items = _items(benchmark)
    named = items.join(items.groupBy("w").agg(F.min("item_id").alias("item")), "w").select("item", "item_id")
    return found.join(named, "item").groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The documents without a copy of a benchmark item."""
    bad_id, bad_node, own = fresh(docs, "bad_id", "bad_node", "own_node")
    bad = staged(contaminated(docs, benchmark, params).select(F.col("doc_id").alias(bad_id), F.col("node").alias(bad_node)).distinct(), "contaminated")
    named = docs.withColumn(own, node_of())
    return named.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_node)), "left_anti").drop(own)
