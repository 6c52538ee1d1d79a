"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 characters, lower case) of every labelled text in 2^16 hashed features for each
language; the matrix of log probabilities, of fixed width and as many rows as there are languages, is broadcast and
batches are scored in numpy from the features they have: the matrix rows of a whole batch's features are gathered and
summed text by text, a bounded number of features at a time. More than ``MOST_LANGS`` languages raise an error, since the
broadcast matrix grows with them.

Edge cases: a text that is null or has no letter (Unicode category L) is ``und`` with score 0; without any labelled text all are; texts are
counted and scored whole; languages that tie go to the first by name; rows without a language teach nothing; repeated
rows count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MOST_LANGS = 1000  # the matrix has 256 KiB for each
AT_ONCE = 1 << 18  # features whose rows of the matrix are gathered at once


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    log_prob: np.ndarray  # FEATURES x languages
    prior: np.ndarray


def features(text: str) -> np.ndarray:
    """The hashed feature of each n-gram, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out, acc = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        acc = acc[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in ORDERS:
            h = acc ^ (acc >> np.uint32(15))
            out.append((h * np.uint32(0x85EBCA77)) >> np.uint32(16))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def remainder(n: int) -> Column:
    """crc32 of the identifier as text, modulo n; a null identifier counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def train(labelled: DataFrame) -> LanguageModel:
    """Learn from the columns text and lang of ``labelled``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = counts.setdefault(lang, np.zeros(FEATURES, np.int64))
                c += np.bincount(features(text), minlength=FEATURES)
                docs[lang] = docs.get(lang, 0) + 1
        for lang, c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(c[used], docs[lang]))], names=["lang", "feature", "n"])

    bounded_batches(labelled.sparkSession)
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    rows = known.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names, feature, n = rows["lang"].to_pylist(), rows["feature"].to_numpy(), rows["n"].to_numpy()
    langs = tuple(sorted(set(names)))
    if len(langs) > MOST_LANGS:
        raise ValueError(f"{len(langs)} languages; the model holds {MOST_LANGS} at most")
    at = np.array([langs.index(x) for x in names], np.int64)
    counts, prior = np.zeros((FEATURES, len(langs))), np.zeros(len(langs))
    gram = feature >= 0
    counts[feature[gram], at[gram]] = n[gram]
    prior[at[~gram]] = n[~gram]
    log_prob = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * FEATURES)
    return LanguageModel(langs, log_prob.astype(np.float32), np.log(prior / max(prior.sum(), 1)) if len(langs) else prior)


def summed_rows(matrix: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """For each array of row numbers the sum of these rows of ``matrix``."""
    out = np.zeros((len(rows), matrix.shape[1]))
    flat, which = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for at in range(0, len(flat), AT_ONCE):
        w = which[at : at + AT_ONCE]
        begin = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        out[w[begin]] += np.add.reduceat(matrix[flat[at : at + AT_ONCE]], begin, axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score (the posterior probability) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if t and m.langs and any(map(str.isalpha, t))]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                total = m.prior + summed_rows(m.log_prob, [features(texts[i]) for i in known])
                p = np.exp(total - total.max(1, keepdims=True))
                for i, best, share in zip(known, p.argmax(1).tolist(), (p.max(1) / p.sum(1)).tolist(), strict=True):
                    langs[i], scores[i] = m.langs[best], share
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose remainder by 4 isn't 2, predict all."""
    model = train(docs.where(remainder(4) != 2))
    return predict(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
