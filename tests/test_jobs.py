"""Samples, order statistics, similarity and jobs against brute force on planted rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlog.operators import models, requests, sampling
from siftlog.plans import jobs
from siftlog.sources import io


def by_hash(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i))


@pytest.fixture(scope="module")
def one_label(spark):
    return spark.createDataFrame([(f"e{i:05d}", "benign") for i in range(3000)], "event_id string, label string").repartition(4)


def test_ranks_of_one_label_come_from_many_tasks(one_label):
    got = sampling.ranked_in_parts(one_label, "label", "event_id", 3)
    want = {x: i + 1 for i, x in enumerate(by_hash([f"e{i:05d}" for i in range(3000)], 3))}
    assert {r["event_id"]: r["rn"] for r in got.collect()} == want and got.first()["n"] == 3000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number() windowspecdefinition(label#" in plan and ", _part#" in plan.split("Window [row_number()")[1][:200]


def test_holdouts_and_folds_of_one_label(one_label):
    parts = sampling.holdout_split(one_label, "label", "event_id", 0.2, 5).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"holdout": 600, "train": 2400}
    folds = sampling.stratified_folds(one_label, "label", "event_id", 7, 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [428, 428, 428, 429, 429, 429, 429]


def test_rows_without_a_label_are_ranked_too(spark):
    df = spark.createDataFrame([(f"e{i}", None if i % 3 else "x") for i in range(30)], "event_id string, label string")
    assert sampling.stratified_folds(df, "label", "event_id", 2, 1).count() == 30


def test_stratified_samples_reach_their_quota_with_repeated_keys(spark):
    # All rows of a label share one hash, beyond any bound that a quota's share would set.
    df = spark.createDataFrame([("same", "benign", i) for i in range(500)] + [(f"k{i}", "malicious", i) for i in range(500)], "event_id string, label string, i int")
    got = sampling.stratified_sample(df, "label", "event_id", 100, 1).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"benign": 50, "malicious": 50}


def test_order_statistics_and_percentiles(spark):
    r = random.Random(2)
    rows = [("a", r.gauss(0, 1) * 10 ** r.randrange(5)) for _ in range(2000)] + [("b", float(r.randrange(3))) for _ in range(500)] + [("c", 7.0), ("c", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for bins in (2, 16, 1024):
        got = sampling.order_statistics(df, "v", lambda n: [0, n // 3, n - 1], F.col("g"), bins)
        for g in ("a", "b", "c", None):
            v = sorted(x for k, x in rows if k == g and x is not None)
            assert [got[g, k] for k in sorted({0, len(v) // 3, len(v) - 1})] == [v[k] for k in sorted({0, len(v) // 3, len(v) - 1})]
    for x in sampling.percentiles(df, "g", "v", (0.01, 0.5, 0.9)).collect():
        v = [w for k, w in rows if k == x["g"] and w is not None]
        assert x["q"] == pytest.approx(list(np.quantile(v, [0.01, 0.5, 0.9])))
    assert sampling.percentiles(df.where("false"), "g", "v", (0.5,)).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.33, 0.8, 1.0])
def test_time_split_counts_exactly(spark, share):
    rows = [(f"e{i:03d}", float(i * 7 % 20)) for i in range(200)]
    got = {r["event_id"]: r["part"] for r in sampling.time_split(spark.createDataFrame(rows, "event_id string, t double"), "t", "event_id", share).collect()}
    first = {e for e, _ in sorted(rows, key=lambda x: (x[1], x[0]))[: int(share * 200)]}
    assert {e for e, p in got.items() if p == "train"} == first


def test_similarity_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ref, asked = rng.normal(size=(90, 6)), rng.normal(size=(40, 6))
    ref[10:70] = ref[0]  # most reference rows are one vector
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<float>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = (unit(asked) @ unit(ref).T).max(1)
    for block in (7, 1000):
        monkeypatch.setattr(models, "SIMILARITY_BLOCK", block)
        got = {r["id"]: r["maxsim"] for r in models.max_similarity(frame(asked), frame(ref), "id").collect()}
        assert [got[i] for i in range(40)] == pytest.approx(list(want), abs=1e-5)
    nothing = models.max_similarity(frame(asked), frame(ref).where("false"), "id").collect()
    assert len(nothing) == 40 and all(r["maxsim"] is None or np.isnan(r["maxsim"]) for r in nothing)


def test_derived_tables_need_their_mark(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    (tmp_path / "t" / "_SUCCESS").unlink()  # as a driver leaves it that dies while it writes
    assert io.derived(spark, path, lambda: spark.range(5)).count() == 5
    assert io.derived(spark, path, lambda: spark.range(9)).count() == 5


COLUMNS = "event_id string, timestamp double, pipeline string, vendor_name string, product_name string, src_ip string, dst_ip string, src_port string, src_host string, dst_host string, username string, message_sanitized string, label_binary string"
WORDS = {"benign": "flow accepted normal session closed fine", "suspicious": "policy flagged odd login attempt twice", "malicious": "exploit payload shell beacon stolen secrets"}


def planted(n, first=0):
    r, rows = random.Random(first), []
    for i in range(first, first + n):
        label = ("benign", "benign", "suspicious", "malicious")[i % 4]
        message = " ".join(r.sample(WORDS[label].split(), 4)) + f" id={i}"
        rows.append((f"e{i:05d}", 1.7e9 + i, "syslog", ("Cisco", "Amazon")[i % 2], "Firewall", "10.0.0.1", "8.8.8.8", "443", "HOST-1", None, "USER-1", message, label))
    return rows


def test_training_predicts_every_event(spark):
    df = spark.createDataFrame(planted(400), COLUMNS)
    result, model, mask = jobs.train(df, jobs.TrainConfig(max_rows=300, vocabulary=200, iterations=15, mask_min_rows=5))
    assert result.first()["accuracy"] > 0.95
    new = spark.createDataFrame(planted(80, 1000), COLUMNS)
    got = {r["event_id"]: r["pred_label"] for r in jobs.predict(model, new, "timefree", mask).collect()}
    truth = {r[0]: r[-1] for r in planted(80, 1000)}
    assert set(got) == set(truth) and sum(got[k] == truth[k] for k in truth) > 70


def test_hybrid_routes_novel_documents(spark):
    train = spark.createDataFrame(planted(300), COLUMNS).withColumn("label", F.col("label_binary"))
    odd = [("new1", 1.7e9, "syslog", "Cisco", "Firewall", "10.0.0.1", "8.8.8.8", "443", "HOST-1", None, "USER-1", "zebra giraffe walrus quagga deny", "suspicious")]
    rows = planted(40, 2000) + odd
    df = spark.createDataFrame(rows, COLUMNS)
    run = {r["event_id"]: r for r in jobs.hybrid(train, df, requests.keyword_model, doubt=0.0, novelty=0.75, budget=0, dims=12, vocabulary=300, iterations=15).collect()}
    assert set(run) == {r[0] for r in rows}
    assert run["new1"]["routed"] and run["new1"]["reply"] == "suspicious" and run["new1"]["maxsim"] == min(r["maxsim"] for r in run.values())
    assert all(r["routed"] == (r["maxsim"] < 0.75) for r in run.values())
    truth = {r[0]: r[-1] for r in rows}
    assert sum((run[k]["clf"] != "benign") == (truth[k] != "benign") for k in truth if k != "new1") >= 38


def test_each_holdout_is_scored_by_a_model_without_it(spark):
    docs = spark.createDataFrame([(i, ("a", "b", "c")[i % 3], x, [*WORDS[x].split(), f"s{i % 3}"]) for i, x in enumerate(["benign", "suspicious", "malicious", "benign"] * 30)], "doc_id long, source string, label string, terms array<string>")
    plan = sampling.holdouts(docs.select("doc_id", "source", "label"))
    seen = []

    def fit(rows):
        seen.append({r["source"] for r in rows.select("source").distinct().collect()})
        return models.fit_classifier(rows, most=100, min_df=1, iterations=10)

    got = jobs.holdout_evaluation(docs, plan, [("loso", x) for x in "abc"], fit).collect()
    assert seen == [{"b", "c"}, {"a", "c"}, {"a", "b"}]
    assert {(r["holdout"], r["items"]) for r in got} == {("a", 40), ("b", 40), ("c", 40)} and all(r["accuracy"] == 1.0 for r in got)


def test_recoverability_of_planted_words(spark):
    df = spark.createDataFrame(planted(240), COLUMNS).withColumns({"label": F.col("label_binary"), "src_host": F.concat(F.lit("H"), F.expr("cast(right(event_id, 5) as int) div 4 % 6"))})
    rows = jobs.recoverability_report(df, df.where("vendor_name = 'Cisco'"), "label", ["vendor_name"], folds=3, most=100, min_df=1, iterations=10).collect()
    got = {(r["topic"], r["name"]): r["value"] for r in rows}
    # Labels go by the number modulo 4 and vendors by it modulo 2: suspicious ones are all Cisco's, malicious ones Amazon's.
    for x, mine, other in (("suspicious", "Cisco", "Amazon"), ("malicious", "Amazon", "Cisco")):
        assert got[f"message_only_{x}", "recall"] == got[f"message_only_{x}", "precision"] == 1.0
        seen = lambda v: "true" if v == "Cisco" else "false"
        assert got[f"value_{x}", f"vendor_name={mine} rows=120 hosts=6 seen={seen(mine)}"] == 0.5
        assert got[f"value_{x}", f"vendor_name={other} rows=120 hosts=6 seen={seen(other)}"] == 0.0
        assert 0.3 < got[f"information_{x}", "vendor_name"] < 0.4


def test_a_system_that_reads_the_clock_is_found_out(spark):
    rows = [(*r[:11], f"at {2020 + (i % 3)} done", r[12]) for i, r in enumerate(planted(120))]
    rows = [(*r[:12], ("benign", "suspicious", "malicious")[i % 3]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("label", F.col("label_binary"))
    config = jobs.TrainConfig(document="full", max_rows=None, vocabulary=100, min_df=1, iterations=15, mask_min_rows=None)
    _, model, mask = jobs.train(df, config)
    by_label = jobs.time_independence(df, model, "full", 1.7e9, mask).collect()
    assert sum(r["n"] for r in by_label) == sum(r["shifted"] for r in by_label) == 120
    assert sum(r["changed"] for r in by_label) > 40
    free = {r["kind"]: r for r in jobs.time_probe(df, F.col("message_sanitized").contains("2020"), ["full", "timefree"], 3, most=100, min_df=1, iterations=10).collect()}
    assert free["full"]["accuracy"] == 1.0 and free["timefree"]["accuracy"] < 0.8 and round(free["full"]["majority"], 4) == 0.6667
