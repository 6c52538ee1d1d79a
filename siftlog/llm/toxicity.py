"""Toxicity by class-conditional Kneser-Ney models.

Two character models of order 5, one of toxic and one of ordinary texts, have their own counts of the highest order
and share the backoff counts below it (in how many contexts a shorter run occurs), so that a rare expression that
neither class knows well says nothing. Log-likelihoods are normalised by length: a stretch of text has the difference of
both for each symbol. A document's value is the largest one of all its stretches of ``STRETCH`` symbols (the whole text,
if that is shorter), so a few toxic words count alike in short and long texts. A logistic function of the value, fitted on
labelled rows that the models haven't seen, is the score.

Characters are folded to 28 symbols (letters without accents, other letters hashed to them, all else one boundary),
so all tables have a fixed size, 28^5 at most. Counts are of all labelled training texts.

Edge cases: null and empty texts have value 0; without labels of both classes every score is the share of toxic
labels; a document that is labelled twice counts once, toxic if any label says so; a null identifier has no label;
texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches, staged
from siftlog.llm.langid import remainder

SYMBOLS = 28
ORDER = 5
GRAMS = SYMBOLS**ORDER
DISCOUNT = 0.9  # of a run seen once a tenth counts, so that rare expressions rest on the shared counts
STRETCH = 12  # symbols, about two words
FULL = 4_000_000  # grams that a task holds before it sums them up

_table = None


def symbol_table() -> np.ndarray:
    """The symbol of each code point of the basic plane."""
    global _table
    if _table is None:
        t = np.zeros(0x10000, np.uint8)
        for cp in range(0x10000):
            ch = chr(cp)
            if ch.isalpha():
                base = unicodedata.normalize("NFKD", ch.lower())[0]
                t[cp] = ord(base) - 96 if "a" <= base <= "z" else 1 + (ord(base) * 2654435761 >> 8) % (SYMBOLS - 1)
        _table = t
    return _table


def letter(ch: str) -> int:
    """The symbol of a character: a to z for letters that are these without accents or in another style, or by hash; else 0."""
    if not ch.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).lower())[0]
    return ord(base) - 96 if "a" <= base <= "z" else 1 + (ord(ch) * 2654435761 >> 8) % (SYMBOLS - 1)


def grams(text: str | None) -> np.ndarray:
    """The number of the 5-gram that ends at each symbol; runs of boundaries count as one."""
    c = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    s = symbol_table()[np.minimum(c, 0xFFFF)]
    if len(c) and c.max() > 0xFFFF:
        beyond = np.flatnonzero(c > 0xFFFF)
        codes, at = np.unique(c[beyond], return_inverse=True)
        s[beyond] = np.array([letter(chr(x)) for x in codes.tolist()], np.uint8)[at]
    if len(s) == 0 or not s.any():
        return np.zeros(0, np.int64)
    s = np.concatenate([s, np.zeros(1, np.uint8)])
    s = s[(s != 0) | (np.concatenate([[1], s[:-1]]) != 0)].astype(np.int64)
    s = np.concatenate([np.zeros(ORDER - 1, np.int64), s])
    out = np.zeros(len(s) - ORDER + 1, np.int64)
    for i in range(ORDER):
        out = out * SYMBOLS + s[i : i + len(out)]
    return out


def count_grams(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each 5-gram occurs in ordinary and in toxic texts of ``labelled`` (text, toxic)."""

    def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, np.bincount(at, np.concatenate(n)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list]] = [([], []), ([], [])]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = held[toxic]
                g = grams(text)
                keys.append(g)
                n.append(np.ones(len(g), np.int64))
            for i, (keys, n) in enumerate(held):
                if sum(map(len, keys)) > FULL:
                    a, b = summed(keys, n)
                    held[i] = ([a], [b])
        for toxic, (keys, n) in enumerate(held):
            if keys:
                a, b = summed(keys, n)
                for i in range(0, len(a), 1 << 16):
                    part = a[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(part), pa.int32()), pa.array(part), pa.array(b[i : i + (1 << 16)])], names=["toxic", "gram", "n"])

    def total(column: Column) -> Column:
        return F.sum(column).cast("float")  # exact up to 2^24, beyond it to seven digits; no count is too large for it

    counted = labelled.mapInArrow(count, "toxic int, gram long, n long").groupBy(F.col("gram").cast("int").alias("gram"))
    rows = counted.agg(total(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"), total(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t")).toArrow()
    out = np.zeros((2, GRAMS), np.float32)
    for i, name in enumerate(("o", "t")):
        out[i, rows["gram"].to_numpy()] = rows[name].to_numpy()
    return out[0], out[1]


def shared_backoff(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The probability of a symbol after three others, from continuation counts that both classes share."""
    seen = (ordinary > 0) | (toxic > 0)
    levels, k = [], ORDER
    while k > 1:
        seen_in = seen.reshape(SYMBOLS, -1).sum(0)  # distinct symbols before each shorter run
        levels.append(seen_in)
        seen, k = seen_in > 0, k - 1
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in levels[::-1]:
        n = n.reshape(-1, SYMBOLS).astype(float)
        total = n.sum(1, keepdims=True)
        lower = np.broadcast_to(p.reshape(-1, SYMBOLS), (len(n) // len(p.reshape(-1, SYMBOLS)), *p.reshape(-1, SYMBOLS).shape)).reshape(-1, SYMBOLS)
        kept = np.maximum(n - DISCOUNT, 0)
        p = np.where(total > 0, (kept + (total - kept.sum(1, keepdims=True)) * lower) / np.maximum(total, 1), lower).ravel()
    return p


def _smoothed(counts: np.ndarray, backoff: np.ndarray) -> np.ndarray:
    """Probabilities of rows of counts with an absolute discount, whose mass goes to ``backoff``."""
    n = counts.reshape(-1, SYMBOLS).astype(np.float32)
    total = n.sum(1, keepdims=True)
    kept = np.maximum(n - np.float32(DISCOUNT), 0)
    return np.where(total > 0, (kept + (total - kept.sum(1, keepdims=True)) * backoff) / np.maximum(total, 1), backoff)


def log_ratio(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each 5-gram how much likelier, in logarithms, its last symbol is in toxic texts. Both models share the backoff."""
    backoff = shared_backoff(ordinary, toxic).reshape(-1, SYMBOLS)
    out = np.zeros(GRAMS, np.float16)
    step = GRAMS // SYMBOLS
    for i in range(SYMBOLS):
        part = slice(i * step, (i + 1) * step)
        out[part] = np.log(_smoothed(toxic[part], backoff) / _smoothed(ordinary[part], backoff)).ravel()
    return out


def largest_mean(ratio: np.ndarray) -> float:
    """The largest mean of ``STRETCH`` neighbours, or of all if there are fewer."""
    if len(ratio) <= STRETCH:
        return float(ratio.mean()) if len(ratio) else 0.0
    total = np.append(0.0, np.cumsum(ratio))
    return float((total[STRETCH:] - total[:-STRETCH]).max() / STRETCH)


@dataclass(frozen=True)
class Calibration:
    slope: float
    base: float


def values(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id and the largest difference of both log-likelihoods for each symbol in a stretch of the text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = [largest_mean(table[grams(text)].astype(float)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, value double")


def calibrate(rows: DataFrame) -> Calibration:
    """Fit a logistic function on ``rows`` (value, toxic); they are summed in 4096 bins of the value first."""
    bins = rows.groupBy(F.round(F.col("value") * 512).cast("int").alias("bin")).agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    bins = bins.select(F.greatest(F.least("bin", F.lit(2047)), F.lit(-2048)).alias("bin"), "toxic", "n").toArrow()
    x, y, n = bins["bin"].to_numpy() / 512, bins["toxic"].to_numpy().astype(float), bins["n"].to_numpy().astype(float)
    share = min(max(y.sum() / max(n.sum(), 1), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < n.sum():
        return Calibration(0.0, base)
    a = np.stack([np.ones_like(x), x])
    w = np.array([base, 1.0])
    ridge = np.diag([1e-6, 1e-4])
    for _ in range(100):  # Newton steps, halved while they don't lower the loss
        p = 1 / (1 + np.exp(-np.clip(w @ a, -40, 40)))
        gradient = a @ (n * p - y) + ridge @ w
        step = np.linalg.solve((a * (n * np.maximum(p * (1 - p), 1e-9))) @ a.T + ridge, gradient)
        step *= min(1.0, 20 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return Calibration(float(w[1]), float(w[0]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The models learn from labelled rows whose remainder by 5 is 2 to 4, the logistic function from those of 1.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    texts = docs.where(remainder(5) > 1).select("doc_id", "text")
    # A sort-merge join at every size: labels grow with the documents, so they are never broadcast.
    ordinary, toxic = count_grams(texts.join(marks.where(remainder(5) > 1).hint("merge"), "doc_id").select("text", "toxic"))
    scored = staged(values(docs, log_ratio(ordinary, toxic)), "toxicity")
    fit = calibrate(scored.where(remainder(5) == 1).join(marks, "doc_id").select("value", "toxic"))
    score = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(fit.base) + fit.slope * F.col("value"), F.lit(-40.0)), F.lit(40.0))))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "value")
