"""What a job holds, reads and writes stays in proportion to its input."""

import datetime
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftlog.operators import models
from siftlog.plans import jobs
from siftlog.schema import LABELS
from siftlog.streaming import events as stream


def docs(spark, n, seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, [r.choice(words[: r.choice((8, 80))]) for _ in range(r.randint(1, 40))], r.choice(LABELS), f"s{i % 4}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, terms array<string>, label string, source string")


def test_products_with_sparse_rows_hold_blocks_of_bounded_size():
    rows, each, size, width = 4000, 500, 20_000, 60
    r = np.random.default_rng(0)
    index = np.concatenate([np.sort(r.choice(size, each, replace=False)) for _ in range(rows)]).astype(np.int32)
    value, matrix = r.random(rows * each), r.random((size, width))
    offsets = pa.array(np.arange(rows + 1) * each, pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(index)), pa.ListArray.from_arrays(offsets, pa.array(value))], names=["i", "x"])
    tracemalloc.start()
    got = np.concatenate([x @ matrix for x in models._dense(batch, size)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6  # every entry times a row of the matrix at once was 960 MB
    for k in (0, 209, 210, rows - 1):
        at = slice(k * each, (k + 1) * each)
        assert np.allclose(got[k], value[at] @ matrix[index[at]])


def test_windows_that_are_open_at_the_end_are_counted(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))

    def put(*rows):
        made = [(str(i), datetime.datetime(2024, 5, 1, *t), "v", "p", m) for i, t, m in rows]
        spark.createDataFrame(made, "event_id string, at timestamp, vendor_name string, product_name string, message_sanitized string").coalesce(1).write.mode("append").parquet(source)

    def run():
        rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        stream.write_running_counts(stream.verdict_counts(rows), out, mark).awaitTermination()
        return {(r["start"].hour, r["verdict"]): r["n"] for r in stream.read_running_counts(spark, out).collect()}

    put((1, (8, 5), "deny x"), (2, (10, 30), "accept"))
    assert run() == {(8, "block"): 1, (10, "allow"): 1}
    put((3, (10, 40), "accept"))
    assert run() == {(8, "block"): 1, (10, "allow"): 2}


def test_fits_on_counted_terms_are_those_on_terms(spark):
    rows = docs(spark, 300)
    told = models.counted(rows)
    settings = {"most": 1000, "min_df": 3, "iterations": 5}
    by_terms, by_counts = (models.predict(models.fit_classifier(d.where("doc_id % 3 <> 0"), **settings), d.where("doc_id % 3 = 0")) for d in (rows, told))
    a, b = ({r["doc_id"]: [r[f"p_{x}"] for x in LABELS] for r in d.collect()} for d in (by_terms, by_counts))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_holdouts_of_counted_terms_make_no_vocabulary_again(spark, tmp_path, monkeypatch):
    told = models.counted(docs(spark, 200), min_df=2).persist()
    monkeypatch.setattr(models, "_vocabulary", None)
    holdouts = [("loso", "s1"), ("loco", f"s2|{LABELS[0]}")]
    found = jobs.holdout_novelty(told, f"file://{tmp_path}/n", holdouts, dims=5, most=60, threads=1)
    held = {h: told.where(jobs.held_out(*h)).count() for h in holdouts}
    assert {(r["kind"], r["holdout"]): r["count"] for r in found.groupBy("kind", "holdout").count().collect()} == held
    told.unpersist()


def test_weights_of_terms_shuffle_no_terms(spark):
    rows = docs(spark, 60).select("doc_id", "terms")
    plan = models.tfidf(rows, "doc_id", "terms")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan
    twice = models.tfidf(rows.unionByName(rows), "doc_id", "terms")  # repeated keys are one document
    assert {r["tf"] % 2 for r in twice.collect()} == {0}
    assert twice.select("doc_id", "term").distinct().count() == twice.count()


def test_vocabularies_are_cut_by_name_where_counts_are_equal(spark):
    rows = spark.createDataFrame([(["b", "a", "a"],), (["b", "c", "d"],), (["d", "c"],), (None,)], "terms array<string>")
    names, frequency, n = models._vocabulary(rows, "terms", 3, 1, 1.0)
    assert (names, frequency.tolist(), n) == (["a", "b", "c"], [1, 2, 2], 4)  # d is as frequent as b and c
    assert models._vocabulary(rows, "terms", 9, 2, 0.98)[0] == ["b", "c", "d"]


def test_a_fit_computes_its_rows_once_for_all_passes_of_the_solver(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    kept = []
    fit = LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, d: kept.append(d.storageLevel.useMemory) or fit(self, d))
    models.fit_classifier(docs(spark, 100), most=50, iterations=2)
    assert kept == [True]


def test_counts_of_one_are_damped_without_json(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.sparse(4, [1, 3], [1.0, 1.0]),), (Vectors.sparse(4, [0], [2.0]),), (Vectors.dense([0.0, 3.0]),)], ["v"])
    got = [r["o"].toArray().tolist() for r in models.Damped(inputCol="v", outputCol="o").transform(rows).collect()]
    assert got[0] == [0, 1, 0, 1] and np.allclose(got[1], [1 + np.log(2), 0, 0, 0]) and np.allclose(got[2], [0, 1 + np.log(3)])


def test_white_space_and_tokens_as_by_their_patterns(spark):
    import re

    from siftlog.functions import net, text
    from siftlog.operators import documents

    values = ["", " ", "a", "_a_", "a_b", "a__b", " AWS  VPC\tSecurity ", "a \x0b\x0c b", "\r\nx\n", "é_x", "-a", "a-", "__", "a b", None, "1.2.3.4", "::1", "HOST-1", "1:2", "a b"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    got = df.select(text.clean_token(v), text.stripped(v), documents.squeezed([v]), net.value_kind(F.coalesce(v, F.lit("")))).collect()
    flat = lambda x: re.sub(r"^\s+|\s+\Z", "", x, flags=re.A)
    token = lambda x: re.sub("^_+|_+$", "", re.sub(r"[^0-9A-Za-z_.:/=@+-]+", "_", re.sub(r"\s+", "_", flat(x), flags=re.A))) or "missing"
    kinds = {"": "missing", " ": "missing", "1.2.3.4": "ipv4", "::1": "ipv6"}
    for x, r in zip(values, got, strict=True):
        x = x or ""
        assert tuple(r) == (token(x), flat(x), flat(re.sub(r"\s+", " ", x, flags=re.A)), kinds.get(x, "other"))


def test_counted_terms_are_only_those_that_a_fit_can_choose(spark, monkeypatch):
    rows = docs(spark, 300).withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    monkeypatch.setattr(models, "_vocabulary", None)  # it would bring all terms to the driver
    told = models.counted(rows, min_df=3, most=10, held=F.array(F.col("fold").cast("string"), "source"))
    monkeypatch.undo()
    told, size, picked = told.persist(), told.first()["terms"].size, set()
    for away in (F.lit(False), *(F.col("fold") == i for i in range(3)), *(F.col("source") == f"s{i}" for i in range(4))):
        picked |= set(models._vocabulary(rows.where(~away), "terms", 10, 3, 0.98)[0])
    assert size == len(picked) < 80  # of 80 terms
    for away in (F.col("fold") == 1, F.col("source") == "s2"):
        by_terms, by_counts = (models.fit_classifier(d.where(~away), most=10, min_df=3, iterations=3) for d in (rows, told))
        a, b = ({r["doc_id"]: [r[f"p_{x}"] for x in LABELS] for r in models.predict(m, d.where(away)).collect()} for m, d in ((by_terms, rows), (by_counts, told)))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_counted_terms_keep_the_bounds_on_frequency_of_each_part(spark):
    rows = [(i, ["every", f"own{i % 2}", *(["half"] if i < 4 else []), *(["once"] if i == 7 else [])], i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>, part int")
    names = models._choices(df, "terms", F.array("part"), 4, 2, 0.9, lambda d: d)
    # In every row is nothing to tell by, in fewer than two no part has enough of; outside a part its own term is gone.
    assert sorted(names) == ["half", "own0", "own1"]
    assert models._choices(df, "terms", F.array("part"), 4, 9, 0.9, lambda d: d) == []


def test_held_out_documents_meet_all_others_of_large_cells(spark, tmp_path):
    import hashlib

    # The last 40 of 20,040 documents of a cell by hash, which a cap of 20,000 dropped, are like those of the other source.
    last = set(sorted(range(20_040), key=lambda i: hashlib.md5(f"{i}|0".encode()).hexdigest())[20_000:])
    rows = [(i, [f"rare{i % 2}", "rare"] if i in last else [f"w{i % 9}", "often"], "benign", "a") for i in range(20_040)]
    rows += [(30_000 + i, [f"rare{i}", "rare"], "benign", "b") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>, label string, source string")
    got = jobs.holdout_novelty(df, f"file://{tmp_path}/n", [("loso", "b")], dims=14, threads=1).collect()
    assert len(got) == 2 and all(r["maxsim"] > 0.999 for r in got)


def test_rows_that_stand_for_several_are_fitted_as_all_of_them(spark):
    df = docs(spark, 40).select("terms", "label", (F.col("doc_id") % 2).cast("int").alias("fold")).withColumn("many", F.explode(F.sequence(F.lit(1), F.lit(6)))).drop("many")
    few = models.fewer_rows(df, 60)
    assert [tuple(r) for r in few.agg(F.sum("n"), F.max("n"), F.count("n")).collect()] == [(240, 4, 80)]
    some = models.counted(models.fewer_rows(df, 240), most=30, held=F.array("fold"), times="n").groupBy("label", "fold", "terms", "terms_damped").agg(F.sum("n").alias("n")).persist()
    assert some.count() == 40
    settings = {"most": 30, "min_df": 3, "iterations": 2}
    a, b = models.fit_classifier(df, **settings), models.fit_classifier(some, times="n", **settings)
    assert a.stages[0].vocabulary and np.allclose(a.stages[2].getScalingVec().toArray().sum(), b.stages[1].getScalingVec().toArray().sum())
    assert np.allclose(np.sort(a.stages[-1].coefficientMatrix.toArray()), np.sort(b.stages[-1].coefficientMatrix.toArray()), atol=0.02)
