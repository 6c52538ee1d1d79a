"""Queries about documents read whole texts."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siftlog.operators import models

#: Longer than what was read of a text once; every document begins with it.
SAME = "word " * 1300
ENDS = {"benign": "calm quiet", "suspicious": "odd strange", "malicious": "evil attack"}


def of(doc_id):
    return ("benign", "suspicious", "malicious")[doc_id % 3]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 documents of two sources whose numbers are each in one only; their ends tell their labels."""
    at = f"file://{tmp_path_factory.mktemp('ends')}"
    docs = [(i, f"n{i:02d} {SAME}{ENDS[of(i)]}", f"src{i % 2}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    marks = [(i, int(of(i) != "suspicious"), int(of(i) == "malicious")) for i in range(60)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows(spark, folder, name):
    return __spark_entry__.queries()[name](spark, folder).collect()


def test_a_balanced_classifier_tells_by_the_ends_of_texts(spark, folder):
    got = rows(spark, folder, "m4_balanced_classifier")
    assert len(got) == 60 and all(r["pred"] == of(int(r["doc_id"])) for r in got)


def test_a_weighted_classifier_tells_by_the_ends_of_texts(spark, folder):
    got = rows(spark, folder, "m5_weighted_classifier")
    assert len(got) == 60 and all(r["pred"] == of(int(r["doc_id"])) for r in got)


def test_document_clusters_go_by_the_ends_of_texts(spark, folder):
    got = rows(spark, folder, "m10_document_clusters")
    ends = {(r["cluster"], of(r["doc_id"])) for r in got}
    assert len(got) == 60 and len(ends) == 3 and len({c for c, _ in ends}) == 3


def test_novelty_goes_by_the_ends_of_texts(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    strange = docs.withColumn("text", F.when(F.col("doc_id") == 4, SAME + "calm strange evil").otherwise(F.col("text")))
    strange.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["maxsim"] for r in rows(spark, f"file://{tmp_path}", "m8_m9_novelty")}
    assert len(got) == 15 and got.pop(4) < 0.9 and min(got.values()) > 0.999


def test_candidates_go_by_the_ends_of_texts(spark, folder):
    (got,) = rows(spark, folder, "m9_candidates")
    assert (got["queries"], got["recall"], got["loss"]) == (15, 1.0, 0.0)


def test_top_terms_come_from_the_ends_of_texts(spark, folder):
    top = {x: set() for x in ENDS}
    for r in rows(spark, folder, "o4_top_terms"):
        if r["weight"] > 0:
            top[r["label"]].add(r["term"])
    assert all(set(words.split()) <= top[x] for x, words in ENDS.items())


def no_large_vocabulary(monkeypatch):
    find = models._vocabulary

    def found(df, words, most, *bounds):
        assert most <= 120_000  # so many terms would come to the driver
        return find(df, words, most, *bounds)

    monkeypatch.setattr(models, "_vocabulary", found)


def test_every_holdout_goes_by_the_ends_of_texts(spark, folder, monkeypatch):
    no_large_vocabulary(monkeypatch)
    got = rows(spark, folder, "m7_every_holdout")
    assert {r["holdout"]: (r["items"], r["accuracy"]) for r in got if r["kind"] == "loso"} == {"src0": (30, 1.0), "src1": (30, 1.0)}
    assert {r["holdout"]: r["items"] for r in got if r["kind"] == "loco"} == {f"src{i}|{x}": 10 for i in range(2) for x in ENDS}


def test_a_time_probe_brings_no_large_vocabulary_to_the_driver(spark, monkeypatch):
    no_large_vocabulary(monkeypatch)
    (got,) = rows(spark, "/root/testdata/sf0.001", "m13_time_probe")
    assert 0.3 < got["accuracy"] < 0.7 and 0.5 <= got["majority"] < 0.6


def test_grouped_evaluation_brings_no_large_vocabulary_to_the_driver(spark, monkeypatch):
    no_large_vocabulary(monkeypatch)
    got = {r["documents"]: r for r in rows(spark, "/root/testdata/sf0.001", "m15_grouped_evaluation")}
    assert got.keys() == {"full", "content"} and len({r["items"] for r in got.values()}) == 1 and min(r["accuracy"] for r in got.values()) > 0.8
