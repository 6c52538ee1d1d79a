"""Parts that were made to grow: streams with late events, novelty by candidates, latent dimensions, clusters, temperatures, grids."""

from __future__ import annotations

import datetime
import random
import re
import threading
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from siftlog.operators import models, policy, sampling
from siftlog.plans import jobs, queries_decisions
from siftlog.schema import LABELS
from siftlog.streaming import events as stream

# --- streams ---

EVENTS = "event_id string, at timestamp, vendor_name string, product_name string, message_sanitized string"


def _put(spark, folder, rows):
    spark.createDataFrame([(str(i), datetime.datetime(2024, 5, 1, *t), "v", "p", m) for i, t, m in rows], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_late_events_are_left_out_and_state_is_dropped(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))

    def run():
        rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        q = stream.write_counts(stream.verdict_counts(rows), out, mark)
        q.awaitTermination()
        return q.recentProgress

    def counts(path=out):
        return {(r["start"].hour, r["verdict"]): r["n"] for r in stream.read_counts(spark, path).collect()}

    _put(spark, source, [(1, (8, 5), "deny x"), (2, (8, 50), "deny y"), (3, (9, 5), "fine"), (4, (10, 30), "accept")])
    run()
    assert counts() == {(8, "block"): 2, (9, "none"): 1}  # the watermark is 10:20
    # 08:30 and 09:59 belong to closed windows, 10:05 is late but its window is open, 13:00 closes it.
    _put(spark, source, [(5, (8, 30), "deny late"), (6, (9, 59), "late"), (7, (10, 5), "accept"), (8, (13, 0), "deny")])
    progress = run()
    assert counts() == {(8, "block"): 2, (9, "none"): 1, (10, "allow"): 2}
    states = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 2
    assert states[-1]["numRowsTotal"] == 1  # the window of 13:00 alone
    # A stream that starts again from nothing overwrites the windows it closes; none is there twice.
    rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.write_counts(stream.verdict_counts(rows), out, f"{mark}-2").awaitTermination()
    # What is late depends on the batches: here the second one still has the first one's watermark.
    assert counts() == {(8, "block"): 3, (9, "none"): 2, (10, "allow"): 2}
    assert stream.read_counts(spark, out).count() == 3


def test_a_stream_without_closed_windows(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    _put(spark, source, [(1, (8, 5), "deny x")])
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    stream.write_counts(stream.verdict_counts(rows), out, mark).awaitTermination()
    assert stream.read_counts(spark, out).collect() == []


# --- features ---


def texts(n, seed=0):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(60)]
    return [(i, [r.choice(common[: r.choice((5, 60))]) for _ in range(r.randint(0, 40))], r.choice(LABELS), f"s{i % 4}") for i in range(n)]


def test_the_first_analyzer_is_the_pattern_with_word_boundaries(spark):
    want = re.compile(r"(?u)\b[\w.\-/:=@+]+\b")
    r = random.Random(1)
    rows = ["".join(r.choice("ab1_.-/:=@+ ,ñé日\t\"'") for _ in range(60)) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", models.terms(F.col("t"), pairs=False).alias("w")).collect()
    for x in got:
        assert x["w"] == want.findall(rows[x["i"]].lower()), rows[x["i"]]


@pytest.mark.parametrize("pairs", [False, True])
def test_fitted_features_are_those_of_the_table_and_survive_saving(spark, tmp_path, pairs):
    rows = texts(200)
    df = spark.createDataFrame([(i, " ".join(w), x) for i, w, x, _ in rows], "id long, doc string, label string").withColumn("terms", models.terms(F.col("doc"), pairs=pairs))
    model = models.fit_classifier(df, most=20_000, min_df=2, max_df=1.0, iterations=5)
    model.write().overwrite().save(f"file://{tmp_path}/m")
    loaded = PipelineModel.load(f"file://{tmp_path}/m")
    want = {(x["id"], x["term"]): x["weight"] for x in models.tfidf(df, "id", "terms", min_df=2).collect()}
    assert max(Counter(t for _, t in want).values()) > 1
    for m in (model, loaded):
        vocabulary = m.stages[0].vocabulary
        rows_ = PipelineModel(m.stages[:-1]).transform(df).select("id", "features").collect()
        got = {(x["id"], vocabulary[i]): v for x in rows_ for i, v in zip(x["features"].indices.tolist(), x["features"].values.tolist(), strict=True)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    a, b = ([tuple(x) for x in models.predict(m, df).select("id", *[f"p_{x}" for x in LABELS]).orderBy("id").collect()] for m in (model, loaded))
    assert a == b


def test_vocabulary_cuts(spark):
    rows = texts(80, 3)
    df = spark.createDataFrame([(i, w) for i, w, *_ in rows], "id long, terms array<string>")
    count, total = Counter(t for _, w, *_ in rows for t in set(w)), Counter(t for _, w, *_ in rows for t in w)
    kept = sorted((t for t in count if 3 <= count[t] <= 0.5 * 80), key=lambda t: (-total[t], t))[:20]
    got = models.tfidf(df, "id", "terms", 3, 0.5, 20).collect()
    assert {x["term"] for x in got} == set(kept)
    for i, w, *_ in rows[:20]:
        raw = {t: (1 + np.log(n)) * (np.log(81 / (1 + count[t])) + 1) for t, n in Counter(w).items() if t in kept}
        norm = sum(v * v for v in raw.values()) ** 0.5
        assert {x["term"]: x["weight"] for x in got if x["id"] == i} == pytest.approx({t: v / norm for t, v in raw.items()})


def test_latent_dimensions_are_the_leading_singular_vectors(spark):
    r = np.random.default_rng(2)
    topics = r.dirichlet(np.full(120, 0.05), 12)
    docs = [(i, [f"t{x}" for x in r.choice(120, 60, p=topics[i % 12])]) for i in range(400)] + [(400, []), (401, ["unknown"])]
    df = spark.createDataFrame(docs, "id long, terms array<string>").repartition(5)
    vectors = models.fit_vectors(df, "terms", 1000, 2)
    dense = np.array([x["features"].toArray() for x in vectors.transform(df).orderBy("id").collect()])
    v = models.fit_lsa(vectors.transform(df), 10)
    s = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(v.T @ v, np.eye(10), atol=1e-9)
    assert np.allclose(np.linalg.norm(dense @ v, axis=0), s[:10], rtol=0.01)
    want = dense @ v
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    got = {x["id"]: x["vec"] for x in models.lsa_vectors(vectors.transform(df), v, "id").collect()}
    assert np.allclose([got[i] for i in range(402)], want, atol=1e-5)
    assert not np.any(got[400]) and not np.any(got[401])
    plan = models._sparse(vectors.transform(df), "features", "id")._jdf.queryExecution().toString()
    assert "vector_to_array" not in plan and "BatchEvalPython" not in plan


def test_sparse_parts_of_dense_and_sparse_vectors(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, Vectors.sparse(5, [1, 3], [2.0, 1e-300])), (2, Vectors.dense([1.0, 0.0, 3.0])), (3, Vectors.sparse(5, [], []))], ["i", "v"])
    got = {x["i"]: (x["i2"], x["x"]) for x in models._sparse(df, "v", "i").withColumnRenamed("i", "i") .toDF("i", "i2", "x").collect()}
    assert got == {1: ([1, 3], [2.0, 1e-300]), 2: ([0, 1, 2], [1.0, 0.0, 3.0]), 3: ([], [])}
    damped = {x["i"]: x["d"] for x in models.Damped(inputCol="v", outputCol="d").transform(df).collect()}
    assert damped[2].toArray().tolist() == pytest.approx([1.0, 0.0, 1 + np.log(3)])


# --- novelty ---


def _vectors(spark, m, first=0):
    return spark.createDataFrame([(i + first, x.tolist()) for i, x in enumerate(m)], "id long, vec array<double>")


def test_candidates_find_nearly_all_nearest_rows(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 24))
    known = np.repeat(centres, 60, 0) + 0.3 * r.standard_normal((2400, 24))
    asked = np.repeat(centres, 8, 0) + 0.3 * r.standard_normal((320, 24))
    exact = {x["id"]: x["maxsim"] for x in models.max_similarity(_vectors(spark, asked), _vectors(spark, known), "id").collect()}
    got = {x["id"]: x["maxsim"] for x in models.near_similarity(_vectors(spark, asked), _vectors(spark, known), "id", block=50).collect()}
    assert got.keys() == exact.keys() and all(got[i] <= exact[i] + 1e-5 for i in exact)
    assert np.mean([got[i] >= exact[i] - 1e-5 for i in exact]) >= 0.9
    assert np.mean([exact[i] - got[i] for i in exact]) < 0.01


def test_hot_and_empty_buckets(spark):
    r = np.random.default_rng(4)
    same = np.tile(r.standard_normal(8), (3000, 1)) + 1e-3 * r.standard_normal((3000, 8))
    got = models.near_similarity(_vectors(spark, same[:500]), _vectors(spark, same[500:]), "id", block=100).collect()
    assert len(got) == 500 and min(x["maxsim"] for x in got) > 0.999
    # Opposite rows share no bucket, so they are compared with all.
    far = models.near_similarity(_vectors(spark, -same[:3]), _vectors(spark, same[:5]), "id").collect()
    assert len(far) == 3 and max(x["maxsim"] for x in far) < -0.99
    nothing = models.near_similarity(_vectors(spark, same[:3]), _vectors(spark, same[:0]), "id").collect()
    assert len(nothing) == 3 and all(x["maxsim"] is None or np.isnan(x["maxsim"]) for x in nothing)


# --- clusters ---


def test_every_row_goes_to_its_nearest_centre(spark):
    r = np.random.default_rng(5)
    m, centres = r.standard_normal((900, 6)), r.standard_normal((30, 6))
    got = models.assign_clusters(_vectors(spark, m).repartition(4), centres, "id").collect()
    assert len(got) == 900 and all(x["cluster"] == np.linalg.norm(centres - m[x["id"]], axis=1).argmin() for x in got)
    fitted = models.fit_clusters(_vectors(spark, np.repeat(centres[:3], 50, 0) * 10), 3, 1)
    assert np.allclose(sorted(fitted.tolist()), sorted((centres[:3] * 10).tolist()))


def test_document_clusters_assign_all_and_folds_keep_them_whole(spark):
    rows = texts(240, 6)
    df = spark.createDataFrame([(i, w, x, s) for i, w, x, s in rows], "doc_id long, terms array<string>, label string, source string")
    found = models.document_clusters(df, "doc_id", k=12, cap=5, dims=8, min_df=1)
    folds = sampling.group_folds(found.join(df, "doc_id"), "cluster", 4, "label").select("doc_id", "cluster", "fold").collect()
    assert sorted(x["doc_id"] for x in folds) == list(range(240))
    of = defaultdict(set)
    for x in folds:
        of[x["cluster"]].add(x["fold"])
    assert all(len(f) == 1 for f in of.values()) and len(of) > 4


# --- holdouts ---


def test_holdouts_side_by_side_equal_single_fits_and_resume(spark, tmp_path):
    rows = texts(120, 7)
    docs = spark.createDataFrame([(i, w, x, s) for i, w, x, s in rows], "doc_id long, terms array<string>, label string, source string").withColumn("cl5", (F.col("doc_id") % 3).cast("int"))
    calls, lock = [], threading.Lock()

    def fit(rest):
        with lock:
            calls.append(1)
        return models.fit_classifier(rest, most=200, min_df=1, iterations=3)

    plan = jobs.every_holdout(docs, ("cl5",))
    assert len(plan) == 4 + 12 + 3 and ("loco", "s1|benign") in plan and ("cl5", "2") in plan
    some = [("loso", "s0"), ("loco", "s1|benign"), ("loco", "s2|malicious"), ("cl5", "1")]
    path = f"file://{tmp_path}/runs"
    got = jobs.holdout_probabilities(docs, path, some, fit, threads=3).collect()
    assert len(calls) == 4
    for kind, name in some:
        held = docs.where(jobs.held_out(kind, name))
        single = models.predict(models.fit_classifier(docs.where(~jobs.held_out(kind, name)), most=200, min_df=1, iterations=3), held).collect()
        mine = {x["doc_id"]: x for x in got if (x["kind"], x["holdout"]) == (kind, name)}
        assert mine.keys() == {x["doc_id"] for x in single} and mine
        for x in single:
            assert [mine[x["doc_id"]][f"p_{y}"] for y in LABELS] == pytest.approx([x[f"p_{y}"] for y in LABELS], abs=1e-6)
    again = jobs.holdout_probabilities(docs, path, some, fit).collect()
    assert len(calls) == 4 and len(again) == len(got)
    jobs.holdout_probabilities(docs, path, [*some, ("loso", "s3")], fit)
    assert len(calls) == 5


def test_novelty_of_holdouts(spark, tmp_path):
    rows = [(i, [f"{s}{j % 5}" for j in range(i % 7 + 3)], "benign" if i % 2 else "malicious", s) for i, s in enumerate(["a", "b"] * 30)]
    rows += [(100, ["only", "here"], "benign", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>, label string, source string")
    got = jobs.holdout_novelty(docs, f"file://{tmp_path}/n", [("loso", "b"), ("loco", "a|benign")], dims=4, min_df=1, threads=2).collect()
    by = {(x["kind"], x["doc_id"]): x["maxsim"] for x in got}
    assert all(v == pytest.approx(0, abs=1e-6) for (k, _), v in by.items() if k == "loso")  # sources share no terms
    assert all(v > 0.9 for (k, _), v in by.items() if k == "loco") and len(by) == 31 + 15 + (len(by) - 46)


# --- calibration ---


def test_cross_fitted_temperatures_minimise_the_loss_of_the_other_folds(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(600):
        p = r.dirichlet([0.3, 0.3, 0.3])
        true = r.dirichlet([1, 1, 1]) * 0.3 + 0.7 * p ** (0.5 + i % 3 * 0.5) / (p ** (0.5 + i % 3 * 0.5)).sum()
        rows.append((i % 3, LABELS[r.choice(3, p=true)], *map(float, p)))
    df = spark.createDataFrame(rows, "fold int, label string, p_benign double, p_suspicious double, p_malicious double")
    y = np.array([LABELS.index(x[1]) for x in rows])
    p = np.clip(np.array([x[2:] for x in rows]), 1e-12, 1)
    fold = np.array([x[0] for x in rows])
    weight = (len(y) / (3 * np.bincount(y, minlength=3)))[y]

    def loss(t, keep):
        logs = np.log(p[keep]) / t
        logs -= logs.max(1, keepdims=True)
        own = np.exp(logs)[np.arange(keep.sum()), y[keep]] / np.exp(logs).sum(1)
        return -(weight[keep] * np.log(np.clip(own, 1e-12, 1))).sum() / weight[keep].sum()

    got = models.cross_fitted_temperatures(df, "fold")
    for f in range(3):
        low, high = 0.05, 20.0
        for _ in range(80):  # golden section
            a, b = high - (high - low) * 0.618034, low + (high - low) * 0.618034
            low, high = (low, b) if loss(a, fold != f) < loss(b, fold != f) else (a, high)
        assert got[f] == pytest.approx((low + high) / 2, rel=2e-3)
    want = np.mean([np.sum(weight[(y == k)] * 0 + np.array([loss_one(p[i], y[i], got[fold[i]]) for i in np.flatnonzero(y == k)])) / (y == k).sum() for k in range(3)])
    assert models.calibrated_loss(df, "fold", got).first()["loss"] == pytest.approx(want)


def loss_one(p, y, t):
    logs = np.log(p) / t
    return -(logs[y] - logs.max() - np.log(np.exp(logs - logs.max()).sum()))


# --- grids ---


def _held(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        p, q = np.random.default_rng(seed + i).dirichlet([1, 1, 1]), np.random.default_rng(seed + 7 * i).dirichlet([1, 1, 1])
        rows.append((r.choice(["cl5", "loso", "loco"]), r.choice("xyz"), r.choice(LABELS), *map(float, p), r.random(), r.random() < 0.4, *map(float, q), {x: r.random() < 0.7 for x in LABELS}))
    return rows, "kind string, holdout string, label string, p_benign double, p_suspicious double, p_malicious double, maxsim double, answered boolean, q_benign double, q_suspicious double, q_malicious double, known_pairs map<string, boolean>"


def test_the_grid_by_cumulative_sums_is_the_grid_by_configurations(spark, tmp_path):
    rows, schema = _held(500, 9)
    misses, rules, novelties, doubts = (1.0, 5.0), queries_decisions.FULL_RULES, queries_decisions.FULL_NOVELTIES, queries_decisions.FULL_DOUBTS
    cells = policy.decision_cells(spark.createDataFrame(rows, schema), misses, rules, novelties, doubts)
    cells.write.parquet(f"file://{tmp_path}/cells")
    cells = spark.read.parquet(f"file://{tmp_path}/cells")
    every = [(m, t, s, pair, unseen, rule) for m in misses for t in range(-1, 4) for s in range(-1, 3) for pair in (False, True) for unseen in (False, True) for rule in range(-1, 13) if ((t, s, pair, unseen) == (-1, -1, False, False)) == (rule == -1)]
    assert len(every) == 2 * 1028
    values = [f"t{i}p{j}" for i in range(3) for j in range(3)] + ["docs", "n_routed"]
    by = lambda df: {(x["config"], x["kind"], x["holdout"]): [x[v] for v in values] for x in df.collect()}
    got = by(policy.cumulative_grid(cells, len(rules), len(doubts), len(novelties)))
    assert {k[0] for k in got} == {"|".join(str(x).lower() if isinstance(x, bool) else str(x) for x in c) for c in every}
    some = random.Random(10).sample(every, 198) + [c for c in every if c[-1] == -1]
    grid = spark.createDataFrame(some, "m double, t int, s int, pair boolean, unseen boolean, rule int").withColumn("config", F.concat_ws("|", "m", "t", "s", "pair", "unseen", "rule"))
    want = by(policy.routing_grid(cells, grid, len(rules)))
    assert len(want) == 200 * 9
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


# --- samples ---


def _robin(rows, n):
    groups = defaultdict(list)
    for key, g in sorted(rows):
        groups[g].append(key)
    order = [(i, g, k) for g, keys in groups.items() for i, k in enumerate(keys)]
    return sorted(k for _, _, k in sorted(order)[:n])


@pytest.mark.parametrize("sizes", [[1000], [500, 3, 3, 1], [7] * 30, [1] * 20 + [300]])
def test_round_robin_takes_whole_rounds(spark, sizes):
    rows = [(g * 10_000 + i, f"g{g:02d}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(6)
    for n in (0, 1, 5, 29, 64, 300, 5000):
        assert sorted(x["id"] for x in sampling.round_robin(df, "g", "id", n).collect()) == _robin(rows, n), n


def test_rounds_are_the_least_that_suffice(spark):
    r = random.Random(11)
    for _ in range(6):
        sizes = [r.choice((1, 2, 50, 4000)) for _ in range(r.randint(1, 30))]
        df = spark.createDataFrame([(s,) for s in sizes], "n long")
        for n in (1, 17, 200, sum(sizes) - 1, sum(sizes), sum(sizes) + 5):
            want = next((d for d in range(1, max(sizes) + 1) if sum(min(s, d) for s in sizes) >= n), max(sizes))
            assert sampling.rounds(df, "n", n) == want
    assert sampling.rounds(spark.createDataFrame([], "n long"), "n", 3) == 0


def test_templates_come_first(spark):
    r = random.Random(12)
    rows = [(i, f"c{r.randint(0, 2)}", f"t{r.randint(0, 4)}", f"m{r.randint(0, 40)}") for i in range(400)]
    rows = [(i, c, f"t{int(m[1:]) % 5}", m) for i, c, _, m in rows]
    df = spark.createDataFrame(rows, "id long, c string, t string, m string")
    import hashlib

    order = lambda i: (hashlib.md5(f"{i}|3".encode()).hexdigest(), i)
    want = []
    for cell in ("c0", "c1", "c2"):
        first = {}
        for i, c, t, m in sorted(rows, key=lambda x: order(x[0])):
            if c == cell:
                first.setdefault(m, (i, t))
        leads = {}
        for i, t in sorted(first.values(), key=lambda x: order(x[0])):
            leads.setdefault(t, i)
        rest = sorted((i for i, _ in first.values() if i not in leads.values()), key=order)
        want += [*sorted(leads.values(), key=order), *rest][:9]
    assert sorted(x["id"] for x in sampling.first_of_templates(df, ["c"], "t", "m", "id", 9, 3).collect()) == sorted(want)
