"""Reports and plans over whole systems, on planted rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftlog.operators import models
from siftlog.plans import jobs
from siftlog.schema import LABELS

EVENTS = "event_id string, timestamp double, pipeline string, vendor_name string, product_name string, src_ip string, dst_ip string, src_port string, src_host string, dst_host string, username string, message_sanitized string, label_binary string"


def event(i, message, label, vendor="v", t=0.0):
    return (str(i), 1.7e9 + t, "p", vendor, "x", "10.0.0.1", "8.8.8.8", "443", "HOST-1", None, "", message, label)


def test_leakage_report_counts_overlap_and_invariance(spark):
    train = [event(i, m, x) for i, (m, x) in enumerate([("deny a 12:30:01", "malicious"), ("deny a 10:20:30", "benign"), ("other", "benign"), (None, "benign")])]
    valid = [event(10 + i, m, "benign") for i, m in enumerate(["deny a 07:08:09", "deny a 07:08:09", "new", "newer"])]
    frames = [spark.createDataFrame(rows, EVENTS).withColumn("label", F.col("label_binary")) for rows in (train, valid)]
    got = {(r["topic"], r["name"]): r["value"] for r in jobs.leakage_report(*frames).collect()}
    assert {n: got["documents", n] for n in ("train_rows", "train_documents", "two_labels", "valid_rows", "valid_documents", "documents_seen", "rows_seen")} == {"train_rows": 4, "train_documents": 3, "two_labels": 1, "valid_rows": 4, "valid_documents": 3, "documents_seen": pytest.approx(1 / 3, abs=1e-6), "rows_seen": 0.5}
    assert got["invariance", "messages"] == 7 and got["invariance", "classifier"] == got["invariance", "timefree"] == got["invariance", "times_left"] == 0
    assert ("purity", "pipeline") in got


def test_generalization_loses_on_raw_documents_of_another_version(spark):
    r = random.Random(1)
    kinds = {"benign": "HOST-1111 port ok", "suspicious": "HOST-2222 port ok", "malicious": "HOST-3333 port ok"}
    words = {"benign": "hello", "suspicious": "deny", "malicious": "worm"}
    rows, other = [], []
    for i in range(300):
        x = LABELS[i % 3]
        sure = r.random() < 0.7
        rows.append(event(i, f"{kinds[x]} {words[x] if sure else ''}", x, t=i))
        renamed = kinds[LABELS[(i + 1) % 3]] if not sure else kinds[x]  # the other version deals the names out anew
        other.append(event(i, f"{renamed} {words[x]}", x, t=i))
    fit = lambda d: models.fit_classifier(d, most=2000, min_df=1, iterations=20)
    got = {x["experiment"]: x for x in jobs.generalization(spark.createDataFrame(rows, EVENTS), spark.createDataFrame(other, EVENTS), fit, 200).collect()}
    assert sorted(got) == ["E1_time_split_raw", "E2_time_split_normalized", "E3_cross_version_raw", "E4_cross_version_normalized"]
    assert got["E1_time_split_raw"]["items"] == 60 and got["E3_cross_version_raw"]["items"] == 300
    assert got["E4_cross_version_normalized"]["macro_f1"] > 0.95 > got["E3_cross_version_raw"]["macro_f1"]


def _documents(n=200):
    r = random.Random(2)
    rows = []
    for i in range(n):
        x = r.choice(LABELS)
        p = [r.random() for _ in range(3)]
        rows.append((i, r.choice("abc"), "malicious" if i == 7 else x if x != "malicious" else "benign", i % 4, *[v / sum(p) for v in p], r.random()))
    return rows, "doc_id long, source string, label string, cl5 int, p_benign double, p_suspicious double, p_malicious double, maxsim double"


def test_reply_plan_takes_samples_and_what_triggers_pick(spark):
    rows, schema = _documents()
    docs = spark.createDataFrame(rows, schema).repartition(3)
    inside = docs.select(F.lit("cl5").alias("kind"), F.col("cl5").cast("string").alias("holdout"), "doc_id", "source", *[f"p_{x}" for x in LABELS], "maxsim")
    plan = [tuple(x) for x in jobs.reply_plan(docs, inside, inside, jobs.every_holdout(docs), per_holdout=5, picks=6).collect()]
    assert len(plan) == len(set(plan))
    of = {i: (s, x) for i, s, x, *_ in rows}
    for kind, name in jobs.every_holdout(docs):
        mine = [i for k, h, i in plan if (k, h) == (kind, name)]
        there = [i for i, (s, x) in of.items() if s == name or f"{s}|{x}" == name]
        assert len(mine) == min(5, len(there)) and set(mine) <= set(there)
    want = set()
    for w in (1, 10):
        scored = []
        for i, s, _, f, a, b, c, _ in rows:
            v = [a * w, b, c]
            scored.append((max(v) / sum(v), i, s, LABELS[v.index(max(v))], f))
        want |= {(str(f), i) for _, i, _, _, f in sorted(scored)[:6]}
        known = {f: {of[j] for j, *_rest in rows if j % 4 != f} for f in range(4)}
        want |= {(str(f), i) for i, f in sorted((i, f) for _, i, s, x, f in scored if (s, x) not in known[f])[:6]}
    want |= {(str(f), i) for _, i, f in sorted((x[7], x[0], x[3]) for x in rows)[:6]}
    assert {(h, i) for k, h, i in plan if k == "cl5"} == want


def test_prompts_lose_what_was_read_off_a_holdout(spark):
    def reader(systems, users):  # says what its prompt's codebook still holds
        return [f'{{"label": "{"malicious" if "first" in s and "second" in s else "suspicious" if "second" in s else "benign"}"}}' for s in systems]

    docs = spark.createDataFrame([(1, "a", "benign", "p", "v", "x", "m1"), (2, "a", "malicious", "p", "v", "x", "m2"), (3, "b", "benign", "p", "v", "x", "m3")], "doc_id long, source string, label string, pipeline string, vendor_name string, product_name string, message_sanitized string")
    book = spark.createDataFrame([("benign", 0, "first", ["a|benign"]), ("malicious", 0, "second", ["a|malicious", "b|benign"])], "label string, place int, line string, cells array<string>")
    plan = spark.createDataFrame([("loso", "a", 1), ("loco", "a|benign", 1), ("loco", "a|malicious", 2), ("cl5", "0", 3)], "kind string, holdout string, doc_id long")
    got = {(x["kind"], x["holdout"], x["variant"]): x["reply"] for x in jobs.held_out_replies(docs, plan, reader, book, "intro", dict.fromkeys(LABELS, "d"), "notes").collect()}
    assert len(got) == 8 and all(v == "benign" for (_, _, variant), v in got.items() if variant == "generic")
    assert {k[:2]: v for k, v in got.items() if k[2] == "codebook"} == {("loso", "a"): "suspicious", ("loco", "a|benign"): "suspicious", ("loco", "a|malicious"): "malicious", ("cl5", "0"): "malicious"}


def test_run_metrics_are_those_of_its_parts(spark):
    r = random.Random(3)
    rows = [(str(i), r.choice("ab"), r.choice(LABELS), r.choice(LABELS), r.random() < 0.4, r.choice(LABELS)) for i in range(200)]
    run = spark.createDataFrame([x[:5] for x in rows], "event_id string, source string, clf string, final string, routed boolean")
    truth = spark.createDataFrame([(x[0], x[5]) for x in rows], "event_id string, label string")
    got = {(x["part"], x["source"]): (x["items"], x["accuracy"]) for x in jobs.run_metrics(run, truth).collect()}
    for part in ("final", "classifier", "routed"):
        for source in ("a", "b", None):
            some = [x for x in rows if source in (None, x[1]) and (part != "routed" or x[4])]
            right = sum((x[2] if part == "classifier" else x[3]) == x[5] for x in some)
            assert got[part, source] == (len(some), pytest.approx(right / len(some), abs=1e-6))
    assert len(got) == 9


def test_documents_by_dictionary_are_those_without(spark):
    from siftlog.operators import documents

    rows = [event(i, m, "benign") for i, m in enumerate(["deny tcp 10.0.0.1 at 12:00:00"] * 50 + ["Jul 26 accept"] * 3 + [f"one {i} drop" for i in range(30)] + [None, "", "", ""] + ["x" * 5000 + " 2024"] * 4)]
    df = spark.createDataFrame(rows, EVENTS).repartition(4)
    makers = {"timefree": documents.timefree_document, "content": documents.content_document, "classifier": documents.classifier_document, "full": documents.full_document}
    for kind, make in makers.items():
        got = {x["event_id"]: x["doc"] for x in documents.with_document(df, kind).select("event_id", "doc").collect()}
        assert got == {x["event_id"]: x["doc"] for x in df.select("event_id", make(df).alias("doc")).collect()}
        assert set(documents.with_document(df, kind).columns) == {*df.columns, "doc"}
    known = {x["value"] for x in documents.repeated_values(df, "message_sanitized").collect()}
    assert known == {"deny tcp 10.0.0.1 at 12:00:00", "Jul 26 accept", ""}
    with pytest.raises(ValueError, match="unknown kind"):
        documents.with_document(df, "other")
