"""Golden values of decisions, routing, metrics, rules and samples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftlog.operators import aggregates, decide, metrics, models, requests, route, sampling
from siftlog.schema import LABELS
from siftlog.sources import io

P = decide.probabilities()


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, p_benign double, p_suspicious double, p_malicious double")


def out(df, c):
    return [r["x"] for r in df.select("i", c.alias("x")).orderBy("i").collect()]


def test_weighted_argmax(spark):
    assert out(frame(spark, [(0.2, 0.8, 0), (0.05, 0.95, 0)]), decide.weighted_argmax(P, None, {"benign": 10})) == ["benign", "suspicious"]
    two = F.array(F.lit("suspicious"), F.lit("malicious"))
    assert out(frame(spark, [(0.3, 0.1, 0.6)]), decide.weighted_argmax(P, two, {"benign": 100})) == ["malicious"]
    assert out(frame(spark, [(0.3, 0.6, 0.1)]), decide.weighted_argmax(P, F.array().cast("array<string>"))) == ["suspicious"]
    assert out(frame(spark, [(1, 1, 1)]), decide.weighted_argmax(P)) == ["benign"]


def test_costs(spark):
    df = frame(spark, [(0.92, 0.05, 0.03), (0.88, 0.08, 0.04)])
    assert out(df, decide.min_cost(P, 10)) == ["benign", "suspicious"] and out(df, decide.min_cost(P, 1)) == ["benign", "benign"]
    assert out(frame(spark, [(0.5, 0.5, 0)]), decide.cost_confidence(P, 1)) == [0.5]
    assert out(frame(spark, [(1, 0, 0)]), decide.cost_confidence(P, 10)) == [1.0]
    df = frame(spark, [(0.15, 0.85, 0), (0.05, 0.95, 0)])
    assert out(df, decide.benign_first(P, 1)) == ["suspicious"] * 2 and out(df, decide.benign_first(P, 10)) == ["benign", "suspicious"]


def test_fusion_by_cost(spark):
    df = frame(spark, [(0.1, 0.2, 0.7), (0.3, 0.6, 0.1), (0.6, 0.1, 0.3)]).withColumn("clf", F.element_at(F.array(*map(F.lit, LABELS)), F.element_at(F.array(F.lit(3), F.lit(2), F.lit(1)), F.col("i") + 1)))
    calm, alarmed = (tuple(map(F.lit, x)) for x in ((0.95, 0.04, 0.01), (0.3, 0.6, 0.1)))
    fuse = lambda rule, param, llm, m=1.0: out(df, decide.fuse_by_cost(rule, param, F.col("clf"), P, llm, m))
    assert fuse("gate_km", 10, calm) == ["malicious", "benign", "benign"] and fuse("gate_km", 10, alarmed) == ["malicious", "suspicious", "malicious"]
    assert fuse("raise", 10, calm) == ["malicious", "suspicious", "benign"] and fuse("raise", 10, alarmed) == ["malicious", "suspicious", "malicious"]
    assert fuse("mix_km", 0.5, calm) == ["malicious", "benign", "benign"]
    none = (F.lit(None).cast("double"),) * 3
    assert fuse("gate_km", 10, none) == ["malicious", "suspicious", "benign"]
    with pytest.raises(ValueError):
        fuse("other", 1, calm)


def test_fusion_by_label(spark):
    df = frame(spark, [(0.2, 0.1, 0.7)])
    one = lambda rule, clf, label: out(df, decide.fuse_by_label(rule, F.lit(clf), P, F.lit(label).cast("string"), decide.one_hot(F.lit(label)), 10))[0]
    assert one("llm", "benign", "suspicious") == "suspicious" and one("llm_gate", "benign", "suspicious") == "malicious"
    assert one("llm_gate", "malicious", "benign") == "benign" and one("agree_alert", "benign", "suspicious") == "benign" and one("llm", "malicious", None) == "malicious"


def routed(spark):
    rows = [(0, "A/x", "benign", 0.99, 0.99), (1, "A/x", "malicious", 0.99, 0.99), (2, "B/y", "benign", 0.99, 0.95), (3, "A/x", "benign", 0.6, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, clf string, conf double, maxsim double")
    return route.with_cells(docs, spark.createDataFrame([("A/x", "benign"), ("A/x", "suspicious")], "source string, label string"))


def test_triggers_and_routing(spark):
    docs, t = routed(spark), route.triggers(0.7, 0.8)
    flags = lambda c: [r["x"] for r in docs.select("doc_id", c.alias("x")).orderBy("doc_id").collect()]
    assert flags(t["unseen_source"]) == [False, False, True, False] and flags(t["new_pair"]) == [False, True, True, False]
    assert flags(t["novel"]) == [False, False, False, True] == flags(t["doubtful"])
    fired = t["unseen_source"] | t["new_pair"] | t["novel"] | t["doubtful"]
    marks = lambda n: [r["routed"] for r in route.route(docs, fired, n).orderBy("doc_id").collect()]
    assert marks(2) == [False, False, True, True] and marks(0) == [False, True, True, True]


def test_metrics(spark):
    rows = lambda a, b: spark.createDataFrame(list(zip([dict(b="benign", s="suspicious", m="malicious")[x] for x in a], [dict(b="benign", s="suspicious", m="malicious")[x] for x in b])), "truth string, pred string")
    r = metrics.evaluate(rows("bbs", "sbb")).first()
    assert (r["benign_misses"], r["errors"], r["cost"]) == (1, 2, 11)
    r = metrics.evaluate(rows("bsmm", "sbsm")).first()
    assert (r["false_alarms"], r["threat_misses"], r["swaps"], r["cost_m10"], r["cost_m2"], r["partial_accuracy"]) == (1, 1, 1, 11.5, 3.5, 0.375)
    assert r["threat_recall"] == r["threat_precision"] == round(2 / 3, 6)
    perfect = frame(spark, [(0.9, 0.1, 0), (0.8, 0.2, 0), (0.1, 0.8, 0.1), (0.1, 0.9, 0), (0, 0.1, 0.9), (0.1, 0.1, 0.8)]).withColumn("truth", F.expr("CASE WHEN i < 2 THEN 'benign' WHEN i < 4 THEN 'suspicious' ELSE 'malicious' END"))
    assert metrics.macro_auc(perfect).first()["macro_auc"] == 1.0
    assert metrics.macro_auc(perfect.where("i < 4")).first()["macro_auc"] is None


def test_submission_errors(spark):
    want = spark.createDataFrame([("e1",), ("e2",)], "event_id string")
    with pytest.raises(ValueError, match=r"missing 1 \(e2\).*extra 1 \(e3\).*invalid 1 \(e3\)"):
        metrics.check_submission(spark.createDataFrame([("e1", "benign"), ("e3", "unknown")], "event_id string, pred_label string"), want)
    metrics.check_submission(spark.createDataFrame([("e1", "benign"), ("e2", "malicious")], "event_id string, pred_label string"), want)


def test_mask_and_rules(spark):
    rows = [("aws", "benign")] * 3 + [("asa", "suspicious")] * 2 + [("asa", "benign"), ("rare", "malicious")]
    mask = aggregates.source_mask(spark.createDataFrame(rows, "source string, label string"), "source", "label", 3)
    assert {r["source"]: r["labels"] for r in mask.collect()} == {"aws": ["benign"], "asa": ["benign", "suspicious"]}
    df = spark.createDataFrame([("missing", "block", "malicious")] * 5 + [("present", "block", "suspicious")] * 3, "s string, v string, label string")
    rule = aggregates.verdict_rule(df, F.col("s"), F.col("v"), "label", 5, 1.0)
    assert (rule["label"], rule["support"]) == ("malicious", 5)
    with pytest.raises(aggregates.RuleError):
        aggregates.verdict_rule(df, F.col("s"), F.col("v"), "label", 6)
    with pytest.raises(aggregates.RuleError):
        aggregates.verdict_rule(df.union(spark.createDataFrame([("missing", "block", "benign")], df.schema)), F.col("s"), F.col("v"), "label", 5, 1.0)


def test_weights_are_even(spark):
    u = spark.createDataFrame([("a", "benign", 1), ("b", "benign", 1), ("c", "benign", 1), ("d", "suspicious", 9)], "doc string, label string, rows long")
    for scheme in ("doc", "log", "rows"):
        sums = {r["label"]: r["w"] for r in aggregates.training_weights(u, scheme).groupBy("label").agg(F.sum("weight").alias("w")).collect()}
        assert sums["benign"] == pytest.approx(sums["suspicious"]) and sum(sums.values()) == pytest.approx(4)


def test_samples(spark):
    df = spark.createDataFrame([(str(i), "benign" if i < 8 else "malicious" if i < 10 else "suspicious") for i in range(12)], "event_id string, label string")
    got = sampling.stratified_sample(df, "label", "event_id", 6, 1)
    assert got.count() == 6 and got.select("label").distinct().count() == 3
    again = sampling.stratified_sample(df.repartition(5), "label", "event_id", 6, 1)
    assert {r["event_id"] for r in got.collect()} == {r["event_id"] for r in again.collect()}
    folds = sampling.stratified_folds(df, "label", "event_id", 2, 1).groupBy("label", "fold").count().collect()
    assert all(r["count"] in (1, 4) for r in folds)
    grouped = sampling.group_folds(df.withColumn("g", F.col("event_id") % 4), "g", 2, "label")
    assert grouped.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    parts = sampling.time_split(df.withColumn("t", F.lit(1.0)), "t", "event_id", 0.5).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 6, "test": 6}
    assert sampling.cap_cells(df, ["label"], 2, "event_id", 1).count() == 6


def test_quotas():
    assert sampling.quotas({"a": 8, "b": 2, "c": 2}, 6) == {"a": 4, "b": 1, "c": 1}
    assert sampling.quotas({"a": 5}, 9) == {"a": 5}
    assert sum(sampling.quotas({"a": 1000, "b": 1, "c": 1}, 5).values()) == 5


def test_replies(spark):
    rows = spark.createDataFrame([(0, 'ok {"label": "Benign", "reason": "x"}'), (1, "I think this is suspicious."), (2, "no idea"), (3, '{"label": "malicious"} {"label": "nothing"}'), (4, None)], "i int, t string")
    assert [r["x"] for r in rows.select("i", requests.parse_reply(F.col("t")).alias("x")).orderBy("i").collect()] == ["benign", "suspicious", None, "malicious", None]


def test_scans_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("e1", "benign"), ("e2", "malicious")], "event_id string, pred_label string")
    io.write_predictions(df, str(tmp_path / "p"))
    assert sorted(io.read_predictions(spark, str(tmp_path / "p")).collect()) == sorted(df.collect())
    with pytest.raises(ValueError, match="unknown labels: other"):
        io.check_labels(spark.createDataFrame([("other",)], "label string"), "label")
    with pytest.raises(ValueError, match="no label column"):
        io.label_column(df)
    reply = spark.createDataFrame([("k", "t", "benign", 1, 1)], "key string, text string, label string, prompt_tokens int, output_tokens int")
    io.append_replies(reply, str(tmp_path / "r"))
    io.append_replies(reply.withColumn("text", F.lit("later")), str(tmp_path / "r"))
    assert [r["text"] for r in io.read_replies(spark, str(tmp_path / "r")).collect()] == ["later"]
    first = io.derived(spark, str(tmp_path / "d"), lambda: df)
    assert io.derived(spark, str(tmp_path / "d"), lambda: df.limit(0)).count() == first.count() == 2


def test_tfidf_and_similarity(spark):
    docs = spark.createDataFrame([(0, ["a", "a", "b"]), (1, ["a"]), (2, ["c"])], "i int, t array<string>")
    w = {(r["i"], r["term"]): r["weight"] for r in models.tfidf(docs, "i", "t").collect()}
    import math

    a, b = (1 + math.log(2)) * (math.log(4 / 3) + 1), math.log(4 / 2) + 1
    assert w[0, "a"] == pytest.approx(a / math.hypot(a, b)) and w[1, "a"] == pytest.approx(1.0)
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "i int, vec array<float>")
    got = {r["i"]: r["maxsim"] for r in models.max_similarity(v, v.where("i = 0"), "i").collect()}
    assert got == {0: pytest.approx(1.0), 1: pytest.approx(0.0)}
    assert [r["x"] for r in docs.select(models.terms(F.lit("A b c"), r"\w+").alias("x")).limit(1).collect()] == [["a", "b", "c", "a b", "b c"]]


def test_terms_of_characters(spark):
    got = spark.range(1).select(models.char_terms(F.lit("ab c"), (3,)).alias("x")).first()["x"]
    assert got == [" ab", "ab ", " c "]
