"""TF-IDF features, linear classifiers, novelty and calibration on distributed data."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftlog.operators import aggregates, metrics, sampling
from siftlog.schema import LABELS, code

#: Token patterns of the two word analyzers. The first is runs of word characters of any script and some marks, which
#: begin and end with a word character; it says so itself, as engines differ in what a word boundary is.
BASELINE_TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-/:=@+]*[\p{L}\p{N}_])?"
HYBRID_TOKEN = r"[A-Za-z_][A-Za-z0-9_]+|0"


def terms(doc: Column, pattern: str = BASELINE_TOKEN, most_chars: int | None = None, pairs: bool = True) -> Column:
    """The tokens of a document in lower case and, with ``pairs``, each two neighbours joined by a space."""
    text = F.lower(F.coalesce(doc, F.lit("")))
    text = F.substring(text, 1, most_chars) if most_chars else text
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not pairs:
        return tokens
    both = lambda t: F.concat(t, F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(t, i + 1))))
    return F.transform(F.array(tokens), both)[0]


def char_terms(doc: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Runs of characters within words, each word between two spaces."""
    words = F.filter(F.split(F.lower(F.coalesce(doc, F.lit(""))), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(w: Column, n: int) -> Column:
        many = F.length(w) - n + 1
        return F.when(many >= 1, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: w.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def runs(w: Column) -> Column:
        return F.concat(*[of_size(w, n) for n in sizes])

    return F.flatten(F.transform(padded, runs))


#: A vocabulary of up to so many terms is sent to all tasks.
SENT_TERMS = 500_000


def tfidf(docs: DataFrame, key: str, words: str, min_df: int = 1, max_df: float = 1.0, most: int | None = None) -> DataFrame:
    """key, term, tf, df and weight: (1 + ln tf) * (ln((1+n)/(1+df)) + 1), each document's weights of length 1.

    The vocabulary is cut by document frequency, then to the ``most`` terms that occur most often. One of up to
    ``SENT_TERMS`` terms is sent to all tasks and a document's terms are counted and weighed within its row, without a
    shuffle or a sort of them; a larger one is joined.
    """
    rows = docs.select(key, F.coalesce(words, F.array().cast("array<string>")).alias(words))
    if not docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        rows = rows.groupBy(key).agg(F.flatten(F.collect_list(words)).alias(words))
    n = rows.count()
    df = rows.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if most is not None:
        total = rows.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
        df = df.join(total, "term").orderBy(F.desc("total"), "term").limit(most).select("term", "df")
    df = df.persist()
    try:
        if df.count() <= SENT_TERMS:
            known = sorted((r["term"], r["df"]) for r in df.collect())
            return _tfidf_sent(rows, key, words, known, n)
    finally:
        df.unpersist()
    idf = df.select("term", "df", (F.ln((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = rows.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(idf, "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "tf", "df", (F.col("w") / length).alias("weight"))


def _tfidf_sent(rows: DataFrame, key: str, words: str, known: list[tuple[str, int]], n: int) -> DataFrame:
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    if not known:
        return spark.createDataFrame([], f"`{key}` {kind}, term string, tf bigint, df bigint, weight double")
    names, frequency = zip(*known, strict=True)
    counts = CountVectorizerModel.from_vocabulary(list(names), inputCol=words, outputCol="_tf").transform(rows).select(key, F.unwrap_udt("_tf").alias("_v")).select(key, F.col("_v")["indices"].alias("_i"), F.col("_v")["values"].alias("_x"))
    df = np.array(frequency, np.int64)
    idf = np.log((1 + n) / (1 + df)) + 1
    shared = spark.sparkContext.broadcast((pa.array(names, pa.string()), df, idf))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_, df_, idf_ = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.slice(at, 1000)
                i, x = some.column("_i"), some.column("_x")
                index, tf = i.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(some)), np.diff(i.offsets.to_numpy()))
                w = (1 + np.log(tf)) * idf_[index]
                length = np.sqrt(np.bincount(row, w * w, len(some)))
                columns = [some.column(0).take(pa.array(row)), terms_.take(pa.array(index)), pa.array(tf.astype(np.int64)), pa.array(df_[index]), pa.array(w / length[row])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "term", "tf", "df", "weight"])

    return counts.mapInArrow(weigh, f"`{key}` {kind}, term string, tf bigint, df bigint, weight double")


def model_key(**settings) -> str:
    """A digest of settings, to name saved models by."""
    return hashlib.md5(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:12]


def sparse_parts(vector: Column | str) -> Column:
    """A struct of a vector's indices i (null in a dense one) and values x, without making it dense."""
    v = F.unwrap_udt(vector)
    return F.struct(v["indices"].alias("i"), v["values"].alias("x"), v["type"].alias("type"), v["size"].alias("size"))


class Damped(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts c of a vector become 1 + ln c; a stage that is saved and loaded with its pipeline.

    Vectors are read and made by built-in functions, so no Python runs for each row; one whose counts are all 1 stays as it is.
    """

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts, out = F.unwrap_udt(self.getInputCol()), self.getOutputCol()
        damped = F.transform(parts["values"], lambda c: F.when(c > 0, 1 + F.ln(c)).otherwise(0.0))
        made = F.to_json(F.struct(F.struct(parts["type"].alias("type"), parts["size"].alias("size"), parts["indices"].alias("indices"), damped.alias("values")).alias("v")))
        same = F.forall(parts["values"], lambda c: c == 1)
        return dataset.withColumn(out, F.when(same, F.col(self.getInputCol())).otherwise(F.from_json(made, StructType([StructField("v", VectorUDT())]))["v"]))


def _vocabulary(df: DataFrame, words: str, most: int, min_df: float, max_df: float) -> tuple[list[str], np.ndarray, int]:
    """The ``most`` terms of largest count (of equal ones the first by name) among those in enough rows and not in too many;
    in how many rows each is, and how many rows there are.

    Hash aggregations that spill count the terms, not maps of objects for each row; only the chosen ones reach the driver.
    """
    rows = df.select(F.coalesce(words, F.array().cast("array<string>")).alias("_w"))
    n = rows.count()
    least, greatest = (min_df if min_df >= 1 else min_df * n), (max_df * n if max_df < 1 else n)
    once, every = (rows.select(F.explode(w).alias("term"), F.lit(i).alias("_n"), F.lit(1 - i).alias("_all")) for i, w in ((1, F.array_distinct("_w")), (0, F.col("_w"))))
    sums = once.unionByName(every).groupBy("term").agg(F.sum("_n").alias("df"), F.sum("_all").alias("total")).where(F.col("df").between(least, greatest))
    top = sums.orderBy(F.desc("total"), "term").limit(most).select("term", "df").collect()
    if not top:
        raise ValueError("the vocabulary size should be > 0: no term is in enough rows and not in too many")
    return [r["term"] for r in top], np.array([r["df"] for r in top], float), n


def _choices(df: DataFrame, words: str, held: Column, most: int, min_df: float, max_df: float, stage, times: str | None = None) -> list[str]:
    """The terms that ``_vocabulary`` finds in all rows, or in the rows outside of one of the parts that ``held`` names, by
    name: so a fit that picks the most frequent of them takes of equal ones the first by name, too.

    Terms are counted by part, and what is outside of a part is the rest of the sum. All of them are ranked where they
    are; only the chosen ones reach the driver.
    """
    rows = df.select(F.coalesce(words, F.array().cast("array<string>")).alias("_w"), F.transform(F.array_compact(held.cast("array<string>")), lambda h: F.concat(F.lit("="), h)).alias("_h"), (F.col(times) if times else F.lit(1)).cast("bigint").alias("_t"))
    inside = {r["h"]: r["n"] for r in rows.select(F.explode(F.concat("_h", F.array(F.lit("")))).alias("h"), "_t").groupBy("h").agg(F.sum("_t").alias("n")).collect()}  # a row for each part
    n = inside.pop("", 0)
    bounds = []
    for name, outside in [("", n), *((h, n - m) for h, m in inside.items())]:
        bounds.append((name, float(max(min_df if min_df >= 1 else min_df * outside, 1)), float(max_df * outside if max_df < 1 else outside)))
    parts = F.broadcast(df.sparkSession.createDataFrame(bounds, "h string, least double, greatest double"))
    once, every = (rows.select(F.explode(w).alias("term"), "_h", (F.lit(i) * F.col("_t")).alias("_n"), (F.lit(1 - i) * F.col("_t")).alias("_all")) for i, w in ((1, F.array_distinct("_w")), (0, F.col("_w"))))
    sums = stage(once.unionByName(every).groupBy("term", "_h").agg(F.sum("_n").alias("_n"), F.sum("_all").alias("_all")))
    whole = sums.groupBy("term").agg(F.sum("_n").alias("df"), F.sum("_all").alias("total")).where(F.col("df") >= min(b[1] for b in bounds))
    own = sums.select("term", F.explode("_h").alias("h"), "_n", "_all").groupBy("term", "h").agg(F.sum("_n").alias("_n"), F.sum("_all").alias("_all"))

    def best(some: DataFrame) -> DataFrame:
        """h, term and rest (the count outside of h) of the ``most`` terms of each part."""
        outside = some.join(parts).join(own, ["term", "h"], "left").withColumns({"rest": F.col("total") - F.coalesce("_all", F.lit(0)), "_df": F.col("df") - F.coalesce("_n", F.lit(0))})
        order = Window.partitionBy("h").orderBy(F.desc("rest"), "term")
        return outside.where(F.col("_df").between(F.col("least"), F.col("greatest"))).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)

    # Where a few frequent terms have enough for a part already, no term below the last of these can be among its best.
    few = best(whole.orderBy(F.desc("total"), "term").limit(2 * most)).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("rest").alias("rest")).where(F.col("n") == most).collect()
    bound = min(r["rest"] for r in few) if len(few) == len(bounds) else 0
    return sorted(r["term"] for r in best(whole.where(F.col("total") >= bound)).select("term").distinct().collect())


def counted(df: DataFrame, words: str = "terms", min_df: float = 1, most: int | None = None, max_df: float = 0.98, held: Column | None = None, stage=lambda df: df, times: str | None = None) -> DataFrame:
    """``df`` with term counts in place of terms, and ``<words>_damped``: vectors over every term of ``min_df`` rows.

    For many fits on parts of one table: stage it, and each fit picks its own vocabulary out of these, so terms are cut
    and looked up once. Fits take it as they take terms, if their ``min_df`` isn't less. With ``most``, the vectors have
    only what fits of ``most`` terms, ``min_df`` and ``max_df`` can pick that see all rows, or all but those of one of the
    few parts whose names the array ``held`` has: the driver holds no more than as many terms for each part. A row counts as ``times``
    equal ones there.
    """
    if most is None:
        try:
            names, _, _ = _vocabulary(df, words, 1 << 26, min_df, 1.0)
        except ValueError:  # no term is in so many rows
            return df
    else:
        names = _choices(df, words, F.array() if held is None else held, most, min_df, max_df, stage, times)
        if not names:
            return df
    model = CountVectorizerModel.from_vocabulary(names, inputCol=words, outputCol="_counts")
    rows = model.transform(df).drop(words).withColumnRenamed("_counts", words)
    return Damped(inputCol=words, outputCol=f"{words}_damped").transform(rows)


def _is_counted(df: DataFrame, words: str) -> bool:
    return isinstance(df.schema[words].dataType, VectorUDT)


def _scaled(idf: np.ndarray, of: str) -> list[Transformer]:
    return [ElementwiseProduct(scalingVec=Vectors.dense(idf + 1), inputCol=of, outputCol="_scaled"), Normalizer(p=2.0, inputCol="_scaled", outputCol="features")]


def _fit_counted(df: DataFrame, words: str, most: int, min_df: float, max_df: float, times: str | None = None) -> PipelineModel:
    """The stages of ``fit_vectors`` for a table that is ``counted`` already: its terms' frequencies come from one pass."""
    if times:
        total, frequency, n = _weighed_sums(df, words, times)
    else:
        sums = df.agg(Summarizer.metrics("sum", "numNonZeros", "count").summary(F.col(words)).alias("s")).select("s.*").first()
        total, frequency, n = sums["sum"].toArray(), sums["numNonZeros"].toArray(), sums["count"]
    able = np.flatnonzero((frequency >= max(min_df if min_df >= 1 else min_df * n, 1)) & (frequency <= (max_df * n if max_df < 1 else n)))
    if not len(able):
        raise ValueError("no term is in enough rows and not in too many")
    own = np.sort(able[np.argsort(-total[able], kind="stable")[:most]])
    idf = np.log((n + 1.0) / (frequency[own] + 1.0))
    return PipelineModel([VectorSlicer(inputCol=f"{words}_damped", outputCol="_own", indices=own.tolist()), *_scaled(idf, "_own")])


def _weighed_sums(df: DataFrame, words: str, times: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each term of ``counted`` rows the count and the rows that have it, and the rows, each ``times`` as many; a row for each term."""
    first = df.select(sparse_parts(words)["size"].alias("size"), F.size(sparse_parts(words)["x"]).alias("many")).first()
    size = (first["size"] or first["many"]) if first else 0
    total, frequency = np.zeros(size), np.zeros(size)
    terms_ = _sparse(df, words, times).select(times, F.inline(F.arrays_zip("i", "x"))).where("x > 0")
    for r in terms_.groupBy("i").agg(F.sum(F.col("x") * F.col(times)).alias("total"), F.sum(times).alias("df")).collect():
        total[r["i"]], frequency[r["i"]] = r["total"], r["df"]
    return total, frequency, df.agg(F.sum(times)).first()[0] or 0


def fit_vectors(df: DataFrame, words: str, most: int, min_df: float, max_df: float = 0.98, times: str | None = None) -> PipelineModel:
    """Damped counts, smoothed inverse document frequencies and unit length, as stages that can be saved: ``tfidf`` as vectors."""
    if _is_counted(df, words):
        return _fit_counted(df, words, most, min_df, max_df, times)
    if times:
        raise ValueError("rows that stand for several must be counted")
    names, frequency, n = _vocabulary(df, words, most, min_df, max_df)
    counts = CountVectorizerModel.from_vocabulary(names, inputCol=words, outputCol="_tf")
    return PipelineModel([counts, Damped(inputCol="_tf", outputCol="_damped"), *_scaled(np.log((n + 1.0) / (frequency + 1.0)), "_damped")])


def width(vectors: PipelineModel) -> int:
    """How many terms the features of ``fit_vectors`` have."""
    return next(s for s in vectors.stages if isinstance(s, ElementwiseProduct)).getScalingVec().size


def fit_classifier(df: DataFrame, words: str = "terms", label: str = "label", weight: str | None = None, c: float = 10.0, most: int = 120_000, min_df: float = 3, max_df: float = 0.98, iterations: int = 50, times: str | None = None) -> PipelineModel:
    """Multinomial logistic regression on TF-IDF; ``c`` is the inverse of the penalty for each unit of weight.

    ``words`` are terms, or the counts of ``counted``, whose rows may stand for ``times`` equal ones.
    """
    rest = [label, *([weight] if weight else []), *([times] if times else [])]
    with_counts = _is_counted(df, words)
    kept = df.select(*([words, f"{words}_damped"] if with_counts else [words]), *rest)
    vectors = fit_vectors(kept, words, most, min_df, max_df, times)
    own = (F.col(weight) if weight else F.lit(1.0)) * (F.col(times) if times else F.lit(1.0))
    rows = vectors.transform(kept).select("features", code(F.col(label)).cast("double").alias("_y"), own.alias("_w"))
    # Kept, as the fit reads them for their moments and again for its blocks.
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = rows.agg(F.sum("_w")).first()[0] or 1.0
        model = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", family="multinomial", regParam=1.0 / (c * total), standardization=False, maxIter=iterations, probabilityCol="_p", predictionCol="_pred", rawPredictionCol="_raw").fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel([*vectors.stages, model])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with three probabilities and pred; labels that training lacked have probability 0."""
    out = model.transform(df).withColumn("_v", vector_to_array("_p"))
    for i, label in enumerate(LABELS):
        out = out.withColumn(f"p_{label}", F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0)))
    return out.withColumn("pred", F.get(F.array(*map(F.lit, LABELS)), F.col("_pred").cast("int"))).drop("_tf", "_damped", "_own", "_scaled", "features", "_raw", "_p", "_pred", "_v")


def blend(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The mean of two classifiers' probabilities."""
    other = b.select(key, *[F.col(f"p_{x}").alias(f"_{x}") for x in LABELS])
    return a.join(other, key).withColumns({f"p_{x}": (F.col(f"p_{x}") + F.col(f"_{x}")) / 2 for x in LABELS}).drop(*[f"_{x}" for x in LABELS])


def top_terms(model: PipelineModel, spark, n: int) -> DataFrame:
    """The n terms of largest weight for each class. The coefficients are on the driver already, as large as the vocabulary."""
    vocabulary = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    matrix = model.stages[-1].coefficientMatrix.toArray()
    rows = [(LABELS[i], vocabulary[j], float(matrix[i, j])) for i in range(matrix.shape[0]) for j in np.argsort(-matrix[i])[:n]]
    return spark.createDataFrame(rows, "label string, term string, weight double")


def out_of_fold(df: DataFrame, folds: int, fit, *key: str) -> DataFrame:
    """Each row (its ``key`` columns) scored by a model of the other folds. The loop is over folds; each fit and each scoring is distributed."""
    parts = []
    for i in range(folds):
        model = fit(df.where(F.col("fold") != i))
        parts.append(predict(model, df.where(F.col("fold") == i)).select(*key, "fold", *[f"p_{x}" for x in LABELS], "pred"))
    return reduce(DataFrame.unionByName, parts)


def novelty(reference: DataFrame, queries: DataFrame, key: str, words: str = "terms", dims: int = 200, most: int = 20_000, min_df: float = 2, stage=lambda df: df, compare=None, passes: int = 4) -> DataFrame:
    """key and maxsim: how near each query comes to any reference row, by latent dimensions of the reference's terms.

    ``stage`` writes and rereads the vectors, which are counted before they are compared: by ``max_similarity``, or
    ``compare`` (such as ``near_similarity``).
    """
    of = reference.columns[0]
    asked, known = (stage(d) for d in document_vectors(reference, (queries, reference), (key, of), words, dims, most, min_df, stage, passes))
    return (compare or max_similarity)(asked, known, key)


def document_vectors(reference: DataFrame, docs, key, words: str = "terms", dims: int = 200, most: int = 20_000, min_df: float = 2, stage=lambda df: df, passes: int = 4):
    """key and vec of ``docs``, by latent dimensions of the reference's terms; of several tables with a key each, a list."""
    vectors = fit_vectors(reference, words, most, min_df)
    size = width(vectors)
    # Counts are read from a table and weighed in each pass; terms are looked up once.
    keep = (lambda d: d) if _is_counted(reference, words) else stage
    v = fit_lsa(vectors.transform(reference), max(1, min(dims, size - 1)), passes=passes, stage=keep, size=size)
    of = lambda d, k: lsa_vectors(vectors.transform(d), v, k)
    return of(docs, key) if isinstance(docs, DataFrame) else [of(d, k) for d, k in zip(docs, key, strict=True)]


def _sparse(df: DataFrame, features: str, *keep: str) -> DataFrame:
    parts = sparse_parts(features)
    index = F.coalesce(parts["i"], F.transform(parts["x"], lambda _, k: k))
    return df.select(*keep, index.alias("i"), parts["x"].alias("x"))


#: So many numbers of a batch's rows are made dense at once.
DENSE = 1 << 22


def _dense(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sparse rows (i, x) of a batch as dense blocks of bounded size, which are multiplied much faster."""
    step = max(1, DENSE // max(size, 1))
    block = np.zeros((min(step, len(batch)), size))
    for at in range(0, len(batch), step):
        some = batch.slice(at, step)
        i = some.column("i")
        row = np.repeat(np.arange(len(some)), np.diff(i.offsets.to_numpy()))
        index = i.flatten().to_numpy(zero_copy_only=False)
        part = block[: len(some)]
        part[row, index] = some.column("x").flatten().to_numpy(zero_copy_only=False)
        yield part
        part[row, index] = 0


def _listed(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix's rows as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def _summed(parts: DataFrame, size: int, width: int) -> np.ndarray:
    """The sum of rows (r, v) by r, as a matrix; r is below ``size``."""
    total = parts.groupBy("r").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
    out = np.zeros((size, width))
    for r, v in total:
        out[r] = v
    return out


def fit_lsa(df: DataFrame, k: int, features: str = "features", seed: int = 0, more: int = 20, passes: int = 4, stage=lambda d: d, size: int | None = None) -> np.ndarray:
    """The first k right singular vectors of the rows, uncentred, by a randomised range finder (Halko 2011).

    With A the rows, each pass sends the range Q (a row for each term) to all tasks and sums A'(AQ) over their sparse
    rows, by term; a last pass sums the small (AQ)'(AQ), whose eigenvectors turn Q into the singular vectors. What tasks
    and driver hold is as large as the vocabulary times ``k + more``, so cap the vocabulary. ``stage`` writes and rereads the rows; ``size`` is the
    length of a row, if it is known.
    """
    spark = df.sparkSession
    rows = stage(_sparse(df, features))
    # A task for each core or two: what they send is a row for each term, however many rows there are.
    rows = rows.coalesce(2 * spark.sparkContext.defaultParallelism)
    if size is None:
        one = df.select(sparse_parts(features)["size"].alias("n"), F.size(sparse_parts(features)["x"]).alias("m")).first()
        size = (one["n"] or one["m"]) if one else 0
    terms = size
    width = min(k + more, terms)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0] if terms else np.zeros((0, 0))

    def back(shared):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = np.zeros((terms, width))
            for batch in batches:
                for x in _dense(batch, terms):
                    y += x.T @ (x @ shared.value)
            used = np.flatnonzero(y.any(axis=1))
            for at in range(0, len(used), 1000):
                some = used[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), _listed(y[some], pa.float64())], names=["r", "v"])

        return add

    def inner(shared):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros((width, width))
            for batch in batches:
                for x in _dense(batch, terms):
                    z = x @ shared.value
                    g += z.T @ z
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), _listed(g, pa.float64())], names=["r", "v"])

        return add

    for _ in range(passes if terms else 0):
        shared = spark.sparkContext.broadcast(q)
        q = np.linalg.qr(_summed(rows.mapInArrow(back(shared), "r int, v array<double>"), terms, width))[0]
    if not terms:
        return q
    gram = _summed(rows.mapInArrow(inner(spark.sparkContext.broadcast(q)), "r int, v array<double>"), width, width)
    values, vectors = np.linalg.eigh(gram)
    return (q @ vectors[:, np.argsort(-values)])[:, :k]


def lsa_vectors(df: DataFrame, v: np.ndarray, key: str, features: str = "features") -> DataFrame:
    """key and vec (unit length): rows times the singular vectors, in batches of sparse rows."""
    shared = df.sparkSession.sparkContext.broadcast(v)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.concatenate([x @ shared.value for x in _dense(batch, len(shared.value))] or [np.zeros((0, shared.value.shape[1]))])
            z = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(z, pa.float32())], names=[key, "vec"])

    return _sparse(df, features, key).mapInArrow(project, f"`{key}` {df.schema[key].dataType.simpleString()}, vec array<float>")


SIMILARITY_BLOCK = 20_000


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(x, np.float32) for x in rows], np.float32).reshape(len(rows), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _best(key: str, vec: str):
    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: a[key], "maxsim": np.full(len(a), np.nan)})
        q, r = _unit(a[vec]), _unit(b["_r"])
        top = [(q[i : i + 1024] @ r.T).max(1) for i in range(0, len(q), 1024)]
        return pd.DataFrame({key: a[key], "maxsim": np.concatenate(top).astype(float)})

    return best


def max_similarity(queries: DataFrame, reference: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """key and maxsim, the largest cosine of each query with any reference row; exact.

    Both sides are dealt into blocks by hash, equal reference rows once, and each pair of blocks is one matrix product
    in one task; nothing passes through the driver. Every query meets every reference row: for large tables on both
    sides use ``near_similarity``.
    """
    kind = queries.schema[key].dataType.simpleString()
    known = reference.select(F.col(vec).alias("_r")).distinct()
    n_r, n_q = (max(1, -(-t.count() // SIMILARITY_BLOCK)) for t in (known, queries))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = queries.select(key, vec, F.pmod(F.xxhash64(key), F.lit(n_q)).cast("int").alias("_q"), every(n_r, "_b"))
    held = known.select("_r", F.pmod(F.xxhash64("_r"), F.lit(n_r)).cast("int").alias("_b"), every(n_q, "_q"))
    pairs = asked.groupBy("_q", "_b").cogroup(held.groupBy("_q", "_b")).applyInPandas(_best(key, vec), f"`{key}` {kind}, maxsim double")
    return pairs.groupBy(key).agg(F.max("maxsim").alias("maxsim"))


def near_similarity(queries: DataFrame, reference: DataFrame, key: str, vec: str = "vec", tables: int = 16, bits: int = 8, seed: int = 0, block: int = SIMILARITY_BLOCK) -> DataFrame:
    """key and maxsim, the largest cosine of each query with the reference rows that share a bucket of random hyperplanes.

    Each of ``tables`` tables cuts the vectors by the signs of ``bits`` random directions; a query meets the rows of its
    buckets, each bucket in one matrix product or, where it is large, in several of ``block`` rows a side, so no task
    holds a hot bucket. Cosines are exact, but a nearest row is missed if it shares none of the query's buckets: the
    likelier the farther it is. Queries whose buckets have no row at all are compared with all of them.
    """
    kind = queries.schema[key].dataType.simpleString()
    first = reference.select(F.size(vec).alias("n")).first()
    if first is None:
        return max_similarity(queries, reference, key, vec)
    planes = queries.sparkSession.sparkContext.broadcast(np.random.default_rng(seed).standard_normal((first["n"], tables * bits)))
    place = 1 << np.arange(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            signs = (m @ planes.value > 0).reshape(len(m), tables, bits)
            bucket = (signs @ place + (np.arange(tables) << bits)).astype(np.int32)
            many = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * tables, pa.int32()), pa.array(bucket.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, many], names=[*batch.schema.names, "_many"])

    def bucketed(df: DataFrame, id_: str, id_kind: str) -> DataFrame:
        return df.mapInArrow(cut, f"`{id_}` {id_kind}, `{vec}` array<float>, _many array<int>").withColumn("_b", F.explode("_many")).drop("_many")

    floats = F.col(vec).cast("array<float>").alias(vec)
    asked = bucketed(queries.select(key, floats), key, kind)
    held = bucketed(reference.select(floats).distinct().select(F.xxhash64(vec).alias("_id"), vec), "_id", "bigint")
    # A row for each bucket, of which there are tables * 2^bits at most.
    sizes = asked.groupBy("_b").count().withColumnRenamed("count", "_nq").join(held.groupBy("_b").count().withColumnRenamed("count", "_nr"), "_b")
    parts = F.broadcast(sizes.select("_b", F.ceil(F.col("_nq") / block).cast("int").alias("_pq"), F.ceil(F.col("_nr") / block).cast("int").alias("_pr")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = asked.join(parts, "_b").select(key, vec, "_b", F.pmod(F.xxhash64(key), F.col("_pq")).cast("int").alias("_q"), every("_pr").alias("_p"))
    b = held.join(parts, "_b").select(F.col(vec).alias("_r"), "_b", F.pmod("_id", F.col("_pr")).cast("int").alias("_p"), every("_pq").alias("_q"))
    by = ["_b", "_q", "_p"]
    near = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(_best(key, vec), f"`{key}` {kind}, maxsim double").groupBy(key).agg(F.max("maxsim").alias("maxsim"))
    alone = queries.select(key, vec).join(asked.join(sizes, "_b", "left_semi").select(key).distinct(), key, "left_anti")
    return near.unionByName(max_similarity(alone, reference, key, vec))


def fit_clusters(sample: DataFrame, k: int, seed: int, vec: str = "vec", steps: int = 30) -> np.ndarray:
    """Centres of a bounded sample's vectors, a row each; they are as many as asked for, or as there are distinct vectors."""
    rows = sample.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=steps, initMode="k-means||").fit(rows)
    return np.array(model.clusterCenters())


def assign_clusters(vectors: DataFrame, centres: np.ndarray, key: str, vec: str = "vec") -> DataFrame:
    """key and cluster, the nearest centre of every row (of equally near ones the first)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        half = (c * c).sum(1) / 2
        for batch in batches:
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((m @ c.T - half).argmax(1), pa.int32())], names=[key, "cluster"])

    return vectors.select(key, vec).mapInArrow(nearest, f"`{key}` {vectors.schema[key].dataType.simpleString()}, cluster int")


def document_clusters(docs: DataFrame, key: str, words: str = "terms", k: int = 300, seed: int = 0, cap: int = 20_000, cell: tuple[str, ...] = ("source", "label"), dims: int = 200, most: int = 20_000, min_df: float = 2, stage=lambda df: df) -> DataFrame:
    """key and cluster of every document, by k-means over latent dimensions of its terms.

    Terms, dimensions and centres are fitted on at most ``cap`` documents of each cell; every document is assigned.
    """
    columns = [words, f"{words}_damped"] if _is_counted(docs, words) else [words]
    some = stage(sampling.cap_cells(docs.select(key, *columns, *cell), list(cell), cap, key, seed))
    vectors = fit_vectors(some, words, most, min_df)
    size = width(vectors)
    v = fit_lsa(vectors.transform(some), max(1, min(dims, size - 1)), stage=(lambda d: d) if _is_counted(some, words) else stage, size=size)
    centres = fit_clusters(stage(lsa_vectors(vectors.transform(some), v, key)), k, seed)
    return assign_clusters(lsa_vectors(vectors.transform(docs), v, key), centres, key)


def clusters(vectors: DataFrame, k: int, seed: int, vec: str = "features") -> DataFrame:
    return KMeans(k=k, seed=seed, featuresCol=vec, predictionCol="cluster").fit(vectors).transform(vectors)


def reweighted(prior: list[float], model_prior: list[float]) -> list[Column]:
    """Posteriors for other class priors."""
    scores = [F.col(f"p_{x}") * F.lit(float(a / max(b, 1e-12))) for x, a, b in zip(LABELS, prior, model_prior, strict=True)]
    return [s / (scores[0] + scores[1] + scores[2]) for s in scores]


def estimate_priors(df: DataFrame, model_prior: list[float], steps: int = 200, stop: float = 1e-7) -> list[float]:
    """Class priors by expectation maximization (Saerens 2002): one average of three expressions a step, over a kept table."""
    rows = df.select(*[f"p_{x}" for x in LABELS]).persist()
    prior = list(model_prior)
    try:
        for _ in range(steps):
            new = [float(x) for x in rows.agg(*[F.avg(c) for c in reweighted(prior, model_prior)]).first()]
            moved, prior = max(abs(a - b) for a, b in zip(new, prior, strict=True)), new
            if moved < stop:
                break
    finally:
        rows.unpersist()
    return prior


def tempered_loss(df: DataFrame, temperatures: list[float], label: str = "label", fold: str | None = None) -> DataFrame:
    """The class-balanced log-loss at each temperature (and fold): every class has the same weight."""
    p = [F.greatest(F.col(f"p_{x}"), F.lit(1e-12)) for x in LABELS]
    loss = []
    for t in temperatures:
        q = [F.pow(x, F.lit(1.0 / t)) for x in p]
        own = F.lit(None).cast("double")
        for x, v in zip(LABELS, q, strict=True):
            own = F.when(F.col(label) == x, v).otherwise(own)
        loss.append(F.struct(F.lit(float(t)).alias("temperature"), (-F.ln(own / (q[0] + q[1] + q[2]))).alias("loss")))
    by = [fold] if fold else []
    each = df.select(*by, label, F.inline(F.array(*loss))).groupBy(*by, "temperature", label).agg(F.avg("loss").alias("loss"))
    return each.groupBy(*by, "temperature").agg(F.round(F.avg("loss"), 6).alias("loss"))


def _own_loss(label: str, temperature: Column) -> Column:
    """A row's log-loss at a temperature, without overflow at small ones."""
    logs = [F.ln(F.greatest(F.least(F.col(f"p_{x}"), F.lit(1.0)), F.lit(1e-12))) / temperature for x in LABELS]
    own = F.lit(None).cast("double")
    for x, v in zip(LABELS, logs, strict=True):
        own = F.when(F.col(label) == x, v).otherwise(own)
    most = F.greatest(*logs)
    return F.least(most + F.ln(sum((F.exp(v - most) for v in logs), F.lit(0.0))) - own, F.lit(-float(np.log(1e-12))))


def cross_fitted_temperatures(df: DataFrame, fold: str, label: str = "label", low: float = 0.05, high: float = 20.0, points: int = 17, stop: float = 1e-4) -> dict:
    """For each fold the temperature of least class-balanced log-loss on the other folds.

    A class weighs the inverse of its share of all rows. Each step is one pass: the losses of all folds' points are
    summed by fold and label, so what a fold's others have is the total less its own, and each fold's bracket closes
    around its best point. Folds must be few; rows without one of the labels or without a fold don't count.
    """
    rows = df.where(F.col(label).isin(*LABELS) & F.col(fold).isNotNull()).select(F.col(fold).alias("_f"), label, *[f"p_{x}" for x in LABELS]).persist()
    try:
        sizes = {(r["_f"], r[label]): r["n"] for r in rows.groupBy("_f", label).agg(F.count(F.lit(1)).alias("n")).collect()}
        folds = sorted({f for f, _ in sizes})
        whole = {x: sum(n for (_, y), n in sizes.items() if y == x) for x in LABELS}
        weight = {x: sum(whole.values()) / (len(LABELS) * max(whole[x], 1)) for x in LABELS}
        bracket = dict.fromkeys(folds, (low, high))
        while any(b / a > 1 + stop for a, b in bracket.values()):
            grids = {f: [a * (b / a) ** (i / (points - 1)) for i in range(points)] for f, (a, b) in bracket.items()}
            asked = sorted({t for g in grids.values() for t in g})
            place = {t: i for i, t in enumerate(asked)}
            losses = F.posexplode(F.transform(F.array(*map(F.lit, asked)), lambda t: _own_loss(label, t))).alias("at", "loss")
            sums: dict = {}
            for r in rows.select("_f", label, losses).groupBy("_f", label, "at").agg(F.sum("loss").alias("s")).collect():
                sums[r["_f"], r[label], r["at"]] = r["s"]
            for f, grid in grids.items():
                # Of one fold only, there are no others to fit on: its own rows count.
                others = [g for g in folds if g != f] or [f]
                loss = [sum(weight[x] * sums.get((g, x, place[t]), 0.0) for g in others for x in LABELS) for t in grid]
                i = min(range(points), key=loss.__getitem__)
                bracket[f] = (grid[max(i - 1, 0)], grid[min(i + 1, points - 1)])
    finally:
        rows.unpersist()
    return {f: (a * b) ** 0.5 for f, (a, b) in bracket.items()}


def calibrated_loss(df: DataFrame, fold: str, temperatures: dict, label: str = "label") -> DataFrame:
    """One row, ``loss``: the class-balanced log-loss when each fold's rows are tempered by its temperature."""
    kind = df.schema[fold].dataType.simpleString()
    table = df.sparkSession.createDataFrame(list(temperatures.items()), f"_f {kind}, _t double")  # a row for each fold
    rows = df.where(F.col(label).isin(*LABELS)).join(F.broadcast(table), F.col(fold) == F.col("_f"))
    each = rows.groupBy(label).agg(F.avg(_own_loss(label, F.col("_t"))).alias("loss"))
    return each.agg(F.avg("loss").alias("loss"))


def fewer_rows(df: DataFrame, parts: int = 100_000) -> DataFrame:
    """The distinct rows of ``df`` with ``n``, for how many each stands; the n add up to the rows of ``df``.

    A row that occurs often comes several times, as none stands for more than the ``parts``-th part of all: a fit scales
    features by a spread that depends on the largest weights, and so hardly differs from the one on all rows. Up to
    ``parts`` rows stay as they are.
    """
    most = max(1, -(-df.count() // parts))
    n = F.col("_many")
    pieces = F.concat(F.array_repeat(F.lit(most), (n / most).cast("int")), F.when(n % most > 0, F.array((n % most).cast("int"))).otherwise(F.array().cast("array<int>")))
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_many")).select(*df.columns, F.explode(pieces).alias("n"))


def probe(df: DataFrame, target: str, key: str, fit_predict, k: int = 5, seed: int = 0) -> DataFrame:
    """Can documents tell ``target``? Out-of-fold accuracy beside the share of the most frequent value."""
    folded = sampling.stratified_folds(df, target, key, k, seed)
    scored = fit_predict(folded)
    majority = df.groupBy(target).count().agg((F.max("count") / F.sum("count")).alias("majority"))
    accuracy = scored.agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))
    return accuracy.join(F.broadcast(majority)).select(F.round("accuracy", 6).alias("accuracy"), F.round("majority", 6).alias("majority"))


def grouped_evaluation(df: DataFrame, documents: dict[str, Column], group: str, key: str, k: int = 5, stage=lambda df: df, **settings) -> DataFrame:
    """Out-of-fold metrics of each kind of document, with all rows of a group in one fold.

    ``stage`` writes and rereads the counted terms, which all folds' fits share.
    """
    parts = []
    for name, doc in documents.items():
        cut = stage(sampling.group_folds(df, group, k, "label").select(key, "label", "fold", terms(doc).alias("terms")))
        rows = stage(counted(cut, min_df=settings.get("min_df", 3), most=settings.get("most", 120_000), max_df=settings.get("max_df", 0.98), held=F.array("fold"), stage=stage))
        weights = aggregates.class_weights(rows).select("label", F.col("weight").alias("_cw"))
        weighted = rows.join(F.broadcast(weights), "label")
        scored = out_of_fold(weighted, k, lambda d: fit_classifier(d, weight="_cw", **settings), key)
        parts.append(scored.join(rows.select(key, F.col("label").alias("truth")), key).select(F.lit(name).alias("documents"), "truth", "pred"))
    return metrics.evaluate(reduce(DataFrame.unionByName, parts), ("documents",))


def nearest_first(df: DataFrame, by: str, n: int, key: str) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy(by, key))).where(F.col("rn") <= n)

