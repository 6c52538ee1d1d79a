"""Queries of trained models, composite jobs and streams. Fits have no SQL; tests pin their properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.functions import text, time
from siftlog.operators import aggregates, decide, documents, metrics, models, requests, sampling
from siftlog.plans import jobs
from siftlog.plans.queries_columns import _scratch
from siftlog.plans.queries_tables import ev
from siftlog.plans import views_sql
from siftlog.plans.queries_decisions import _STUB, DEFINITIONS, INTRO, NOTES, argmax, least
from siftlog.plans.queries_tables import EV, H, INFORMATION, LD, PR, PURITY, long_sql
from siftlog.plans.registry import SOURCE, VERDICT_SQL, query
from siftlog.schema import _SPARK_EPOCH, ADAPTER, LABELS, P_MALICIOUS, P_SUSPICIOUS, labelled_documents, read, with_probabilities
from siftlog.sources import io
from siftlog.streaming import events as stream

SYSTEM = requests.plain_prompt(INTRO, DEFINITIONS, NOTES)
SMALL = {"most": 2000, "min_df": 3, "iterations": 10}
CONFIG = jobs.TrainConfig(max_rows=3000, vocabulary=2000, iterations=10, mask_min_rows=20)


def _events(spark, sf):
    """Events for fits, dealt out to all cores: a small file is read by one task, and what is made of it would be, too."""
    return io.staged(ev(spark, sf).repartition("event_id"))


def _rows(spark, sf, pairs=True):
    """Labelled documents with the terms of their whole texts, for the classifiers; ``pairs``: of words too."""
    docs = labelled_documents(spark, sf).repartition("doc_id")  # a small file is read by one task
    return docs.select("doc_id", "source", "label", models.terms(F.col("doc"), models.HYBRID_TOKEN, pairs=pairs).alias("terms"))


def _counted(rows, min_df=SMALL["min_df"]):
    """Rows cut into terms and counted once, for several fits."""
    return io.staged(models.counted(io.staged(rows), min_df=min_df))


def _folded(rows, held, min_df=SMALL["min_df"]):
    """Rows that are staged with their folds, counted once for the fits that each leave out a part of ``held``."""
    return io.staged(models.counted(rows, min_df=min_df, most=SMALL["most"], held=held, stage=io.staged))


def _fit(rows):
    weights = aggregates.class_weights(rows).select("label", F.col("weight").alias("_cw"))
    return models.fit_classifier(rows.join(F.broadcast(weights), "label"), weight="_cw", **SMALL)


def _rounded(df, key):
    return df.select(key, *[F.round(f"p_{x}", 4).alias(f"p_{x}") for x in LABELS], "pred")


@query("s7_prediction_csv_scan", EV + "SELECT label_binary AS pred_label, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf):
    path = _scratch(spark)
    io.write_predictions(ev(spark, sf).select("event_id", F.col("label").alias("pred_label")), path)
    return io.read_predictions(spark, path).groupBy("pred_label").agg(F.count(F.lit(1)).alias("n"))


@query("s11_model_save_and_load")
def _(spark, sf):
    from pyspark.ml import PipelineModel

    rows = io.staged(_rows(spark, sf))
    path = f"{_scratch(spark)}/{models.model_key(**SMALL)}"
    _fit(rows).write().overwrite().save(path)
    return _rounded(models.predict(PipelineModel.load(path), rows), "doc_id")


_TOKENS = LD + f", t AS (SELECT doc_id, regexp_extract_all(substr(lower(doc), 1, 6000), '{models.HYBRID_TOKEN}') AS w FROM ld), x AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL)"


@query("m2_hybrid_tfidf", _TOKENS + ", n AS (SELECT count(*) AS n FROM ld), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 200000), r AS (SELECT doc_id, term, tf, df, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n) SELECT doc_id, term, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 5) AS weight FROM r")
def _(spark, sf):
    docs = labelled_documents(spark, sf).repartition("doc_id")
    rows = docs.select("doc_id", models.terms(F.col("doc"), models.HYBRID_TOKEN, 6000).alias("terms"))
    return models.tfidf(rows, "doc_id", "terms", min_df=2, most=200_000).select("doc_id", "term", "tf", "df", F.round("weight", 5).alias("weight"))


@query("m4_balanced_classifier")
def _(spark, sf):
    rows = io.staged(_rows(spark, sf))
    return _rounded(models.predict(_fit(rows), rows), "doc_id")


@query("m5_weighted_classifier")
def _(spark, sf):
    docs = labelled_documents(spark, sf).repartition("doc_id").withColumn("event_id", F.col("doc_id"))
    unique = io.staged(aggregates.training_weights(aggregates.unique_documents(docs), "log").withColumn("terms", models.terms(F.col("doc"), models.HYBRID_TOKEN)))
    return _rounded(models.predict(models.fit_classifier(unique, weight="weight", **SMALL), unique.withColumn("doc_id", F.col("event_id"))), "doc_id")


@query("m7_out_of_fold")
def _(spark, sf):
    folded = _folded(io.staged(sampling.stratified_folds(_rows(spark, sf), "label", "doc_id", 3, 1)), F.array("fold"))
    return models.out_of_fold(folded, 3, _fit, "doc_id").select("doc_id", "fold", *[F.round(f"p_{x}", 4).alias(f"p_{x}") for x in LABELS], "pred")


@query("m7_every_source_held_out")
def _(spark, sf):
    """Metrics of models that each leave one source out."""
    rows = _counted(_rows(spark, sf, pairs=False))  # a fit for each source
    plan = sampling.holdouts(rows.select("doc_id", "source", "label"))
    names = sorted(r["holdout"] for r in plan.where("kind = 'loso'").select("holdout").distinct().collect())
    result = jobs.holdout_evaluation(rows, plan, [("loso", n) for n in names], _fit)
    return result.select("kind", "holdout", "items", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


@query("m7_every_holdout")
def _(spark, sf):
    """Metrics of every source, every cell of a source and every fold of document clusters, each scored by a model of the rest."""
    rows = io.staged(_rows(spark, sf, pairs=False))
    grouped = rows.join(models.document_clusters(rows, "doc_id", k=50, dims=20, most=2000, stage=io.staged), "doc_id")
    folded = io.staged(sampling.group_folds(grouped, "cluster", 5, "label").withColumnRenamed("fold", "cl5").drop("cluster"))
    away = [F.col("source"), F.concat_ws("|", "source", "label"), F.col("cl5").cast("string")]
    docs = _folded(folded, F.array(*[F.concat(F.lit(f"{kind} "), name) for kind, name in zip(("loso", "loco", "cl5"), away, strict=True)]))
    fit = lambda d: models.fit_classifier(d, **{**SMALL, "iterations": 5})
    scored = jobs.holdout_probabilities(docs, _scratch(spark), jobs.every_holdout(docs, ("cl5",)), fit, threads=8)
    result = metrics.evaluate(scored.withColumn("truth", F.col("label")), ("kind", "holdout"))
    return result.select("kind", "holdout", "items", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


@query("m8_m9_novelty")
def _(spark, sf):
    rows = io.staged(_rows(spark, sf))
    near = models.novelty(rows.where("doc_id % 4 <> 0"), rows.where("doc_id % 4 = 0"), "doc_id", stage=io.staged)
    return near.select("doc_id", F.round("maxsim", 4).alias("maxsim"))


@query("m9_candidates")
def _(spark, sf):
    """Novelty by buckets of random hyperplanes beside the exact one: the queries, the share whose nearest row is found, the mean loss."""
    rows = io.staged(_rows(spark, sf))
    vectors = io.staged(models.document_vectors(rows.where("doc_id % 4 <> 0"), rows, "doc_id", dims=50, most=5000, stage=io.staged))
    known, new = vectors.where("doc_id % 4 <> 0"), vectors.where("doc_id % 4 = 0")
    exact = models.max_similarity(new, known, "doc_id").withColumnRenamed("maxsim", "exact")
    both = exact.join(models.near_similarity(new, known, "doc_id"), "doc_id")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg((F.col("maxsim") >= F.col("exact") - 1e-5).cast("double")), 2).alias("recall"), F.round(F.avg(F.col("exact") - F.col("maxsim")), 2).alias("loss"))


@query("m10_document_clusters")
def _(spark, sf):
    """Clusters of documents by latent dimensions, and the folds that keep each whole."""
    rows = io.staged(_rows(spark, sf))
    grouped = rows.select("doc_id", "label").join(models.document_clusters(rows, "doc_id", stage=io.staged), "doc_id")
    return sampling.group_folds(grouped, "cluster", 5, "label").select("doc_id", "cluster", "fold")


@query("m10_clusters")
def _(spark, sf):
    from pyspark.ml.functions import array_to_vector

    vectors = read(spark, sf, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("features"))
    return models.clusters(vectors, 10, 1).select("vec_id", "cluster")


@query("m13_time_probe")
def _(spark, sf):
    day = F.dayofmonth(time.instant(F.col("timestamp")))
    named = _events(spark, sf).select("event_id", F.when(day <= 15, "benign").otherwise("suspicious").alias("half"), "message_sanitized")

    def fit_predict(folded):
        folded = _folded(io.staged(folded.select("event_id", "half", "fold", models.terms(F.col("message_sanitized")).alias("terms"))), F.array("fold"))
        scored = models.out_of_fold(folded, 5, lambda d: models.fit_classifier(d, label="half", **SMALL), "event_id")
        return scored.join(folded.select("event_id", F.col("half").alias("truth")), "event_id")

    return models.probe(named, "half", "event_id", fit_predict)


@query("m14_message_only_recall")
def _(spark, sf):
    rows = _events(spark, sf).select("event_id", "src_host", "label", models.terms(F.col("message_sanitized"), pairs=False).alias("terms"))
    folded = io.staged(sampling.group_folds(_counted(rows), "src_host", 3, "label"))
    scored = models.out_of_fold(folded, 3, _fit, "event_id").join(rows.select("event_id", F.col("label").alias("truth")), "event_id")
    return scored.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("double")), 4).alias("recall"))


@query("m15_grouped_evaluation")
def _(spark, sf):
    df = _events(spark, sf)
    kinds = {"full": documents.full_document(df, ("pipeline",)), "content": documents.content_document(df)}
    return models.grouped_evaluation(df, kinds, "src_host", "event_id", 2, stage=io.staged, **SMALL).select("documents", "items", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


@query("m16_holdout_novelty")
def _(spark, sf):
    """For each source: novelty of its documents against all others."""
    rows = _folded(io.staged(_rows(spark, sf, pairs=False)), F.array("source"), 2)  # a fit for each holdout
    sources = [h for h in jobs.every_holdout(rows) if h[0] == "loso"]
    found = jobs.holdout_novelty(rows, _scratch(spark), sources, dims=20, most=2000, passes=2, threads=8)
    return found.select("kind", "holdout", "doc_id", F.round("maxsim", 4).alias("maxsim"))


@query("o4_top_terms")
def _(spark, sf):
    return models.top_terms(_fit(io.staged(_rows(spark, sf))), spark, 20).select("label", "term", F.round("weight", 4).alias("weight"))


@query("e10_generalization")
def _(spark, sf):
    """Time split and raw or version-free documents: metrics of each."""
    df = io.staged(sampling.time_split(_events(spark, sf), "timestamp", "event_id"))
    kinds = {"raw": documents.full_document(df), "normalized": text.version_free(documents.full_document(df))}
    parts = []
    for name, doc in kinds.items():
        rows = _counted(df.select("event_id", "part", "label", models.terms(doc, pairs=False).alias("terms")))
        scored = models.predict(_fit(rows.where("part = 'train'")), rows.where("part = 'test'"))
        parts.append(scored.select(F.lit(name).alias("documents"), F.col("label").alias("truth"), "pred"))
    return metrics.evaluate(parts[0].unionByName(parts[1]), ("documents",), present_only=False).select("documents", "items", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


@query("e10_cross_version")
def _(spark, sf):
    """Both halves of the matrix; the other version has the same events sanitised anew (other numbers and calendar words)."""
    df = _events(spark, sf)
    other = df.withColumn("message_sanitized", text.perturbed(F.col("message_sanitized"), 7))
    result = jobs.generalization(df, other, _fit, 5000)
    return result.select("experiment", "items", *[F.round(c, 3).alias(c) for c in ("macro_f1", "f1_suspicious", "f1_malicious")])


@query("e11_leakage_ablation")
def _(spark, sf):
    """Raw documents: folds of the distinct training documents, and events of the other half as truth from outside."""
    events = _events(spark, sf)
    df = events.where("eid % 2 = 0")
    unique = aggregates.unique_documents(df.withColumn("doc", documents.raw_document(df)))
    rows = io.staged(unique.select(F.col("event_id").alias("doc_id"), "label", models.terms(F.col("doc")).alias("terms")))
    # From terms: counts of all terms of raw documents would be as wide as there are addresses and numbers.
    folded = io.staged(sampling.stratified_folds(rows, "label", "doc_id", 2, 1))
    inside = models.out_of_fold(folded, 2, _fit, "doc_id").join(rows.select("doc_id", F.col("label").alias("truth")), "doc_id")
    other = events.where("eid % 2 = 1")
    outside = models.predict(_fit(rows), other.select(F.col("event_id").alias("doc_id"), F.col("label").alias("truth"), models.terms(documents.raw_document(other)).alias("terms")))
    scored = [d.select(F.lit(n).alias("truth_from"), "truth", *[f"p_{x}" for x in LABELS]) for d, n in ((inside, "folds"), (outside, "outside"))]
    return metrics.evaluate(scored[0].unionByName(scored[1]).withColumn("pred", decide.min_cost(decide.probabilities(), 5)), ("truth_from",)).select("truth_from", "items", F.round("accuracy", 4).alias("accuracy"), F.round("cost_m5", 1).alias("cost_m5"))


@query("l7_held_out_replies", EV + f", r AS (SELECT *, {SOURCE} AS holdout, row_number() OVER (PARTITION BY {SOURCE} ORDER BY " + H.format(7) + f", event_id) AS rn FROM ev) SELECT holdout, count(*) AS n, round(avg(CASE WHEN {_STUB} = label_binary THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r WHERE rn <= 20 GROUP BY holdout")
def _(spark, sf):
    """A sample of each source, held out: the prompt loses the lines read off its cells; accuracy of the replies."""
    df = ev(spark, sf)
    plan = sampling.ranked(df.select("event_id", F.lit("loso").alias("kind"), F.col("source").alias("holdout")), ["kind", "holdout"], "event_id", 7).where("rn <= 20").select("event_id", "holdout")
    from siftlog.plans.queries_decisions import _prompts

    user = requests.user_prompt(*[F.col(c) for c in ("pipeline", "vendor_name", "product_name", "message_sanitized")])
    asked = df.join(plan, "event_id").join(F.broadcast(_prompts(spark, sf).withColumnRenamed("prompt", "system")), "holdout").select("event_id", "holdout", "label", "system", user.alias("user")).withColumn("key", requests.request_key(F.col("system"), F.col("user")))
    replies = requests.ask(asked.dropDuplicates(["key"]), requests.keyword_model)
    scored = asked.select("holdout", "key", F.col("label").alias("truth")).join(replies.select("key", F.col("label").alias("pred")), "key")
    return scored.groupBy("holdout").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("double")), 6).alias("accuracy"))


@query("l7_every_holdout")
def _(spark, sf):
    """Replies about samples of every source and cell and about what triggers pick in distribution, by both prompts."""
    from siftlog.plans import queries_decisions as q

    df = io.staged(with_probabilities(ev(spark, sf)).withColumn("cl5", F.pmod(F.xxhash64("source", F.floor(F.col("eid") / 50)), F.lit(5)).cast("int")))
    inside = df.select(F.lit("cl5").alias("kind"), F.col("cl5").cast("string").alias("holdout"), "event_id", "source", *[f"p_{x}" for x in LABELS], (F.col("eid") % 97 / 97).alias("maxsim"))
    plan = io.staged(jobs.reply_plan(df, inside, inside, jobs.every_holdout(df), key="event_id"))
    book = spark.createDataFrame(q.CODEBOOK, "label string, place int, line string, cells array<string>")
    replies = jobs.held_out_replies(df, plan, requests.keyword_model, book, q.INTRO, q.DEFINITIONS, q.NOTES, "event_id")
    hit = lambda c: F.round(F.avg(c.cast("double")), 6)
    right, alert = F.col("reply").eqNullSafe(F.col("label")), (F.col("reply") != "benign").eqNullSafe(F.col("label") != "benign")
    return replies.groupBy("kind", "holdout", "variant").agg(F.count(F.lit(1)).alias("n"), hit(right).alias("accuracy"), hit(alert).alias("alert_accuracy"), F.count_if(F.col("reply").isNull()).alias("unparsed"))


@query("k1_train_and_evaluate")
def _(spark, sf):
    """Metrics of the holdout, then the final model's predictions of all events, checked for completeness."""
    df = _events(spark, sf)
    result, model, mask = jobs.train(df, CONFIG)
    checked = metrics.validation(jobs.predict(model, df, CONFIG.document, mask), df)
    return result.select("items", F.round("accuracy", 3).alias("accuracy"), F.round("macro_f1", 3).alias("macro_f1")).join(F.broadcast(checked.select("missing", "extra", "duplicate", "invalid", "valid")))


@query("k2_predict_with_mask_and_rule")
def _(spark, sf):
    df = _events(spark, sf)
    _, model, mask = jobs.train(df, CONFIG)
    rule = aggregates.verdict_rule(df, *documents.verdict_cell(df), "label", 10, 0.5)
    return jobs.predict(model, df, CONFIG.document, mask, rule)


@query("k3_hybrid")
def _(spark, sf):
    df = _events(spark, sf)
    return jobs.hybrid(df.where("eid % 2 = 0"), df.where("eid % 2 = 1").drop("source"), requests.keyword_model, novelty=0.3, budget=50, dims=10, vocabulary=2000, iterations=10).select("event_id", "clf", "routed", "final")


@query("k4_leakage_audit", "WITH " + EV.removeprefix("WITH ").strip() + ", tr AS (SELECT * FROM ev WHERE eid % 2 = 0), " + long_sql(("pipeline", "src_port", "vendor_name", "product_name"), source="tr") + ", pu AS (WITH " + PURITY + "), dy AS (SELECT label_binary AS label, strftime(ts, '%Y-%m-%d') AS d, count(*) AS n FROM tr JOIN events e ON e.event_id = tr.eid GROUP BY ALL), kw AS (SELECT unnest(['deny', 'block', 'accept']) AS k) SELECT 'purity' AS topic, \"column\" AS name, cast(purity AS double) AS value FROM pu UNION ALL SELECT 'top_day_share', label, cast(round(max(n) / sum(n), 6) AS double) FROM dy GROUP BY label UNION ALL SELECT 'keyword', k || '|' || label_binary, cast(count(*) AS double) FROM tr, kw WHERE contains(lower(message_sanitized), k) GROUP BY ALL UNION ALL SELECT 'overlap', 'messages', cast(round(avg(CASE WHEN message_sanitized IN (SELECT message_sanitized FROM tr) THEN 1.0 ELSE 0.0 END), 6) AS double) FROM ev WHERE eid % 2 = 1"
    + " UNION ALL SELECT 'lowest_id', label_binary, cast(min(eid) AS double) FROM tr GROUP BY 2 UNION ALL SELECT 'highest_id', label_binary, cast(max(eid) AS double) FROM tr GROUP BY 2"
    + f" UNION ALL SELECT 'pseudonyms', label_binary, cast(sum(len(regexp_extract_all(coalesce(message_sanitized, ''), '(?:{text.SANITIZER})-[0-9]{{4}}'))) AS double) FROM tr GROUP BY 2"
    + " UNION ALL SELECT 'two_labels', 'messages', cast(count(*) AS double) FROM (SELECT message_sanitized FROM tr GROUP BY 1 HAVING min(label_binary) <> max(label_binary))"
    + f" UNION ALL SELECT 'source_share_' || side, source, round(n / cast(t AS double), 6) FROM (SELECT source, side, count(so.source) AS n, max(t) AS t FROM (SELECT DISTINCT {SOURCE} AS source FROM ev) CROSS JOIN (SELECT CASE WHEN eid % 2 = 0 THEN 'train' ELSE 'valid' END AS side, count(*) AS t FROM ev GROUP BY 1) LEFT JOIN (SELECT {SOURCE} AS source, CASE WHEN eid % 2 = 0 THEN 'train' ELSE 'valid' END AS side FROM ev) so USING (source, side) GROUP BY 1, 2)"
    + f" UNION ALL SELECT 'unseen_source', {SOURCE}, cast(count(*) AS double) FROM ev WHERE eid % 2 = 1 AND {SOURCE} NOT IN (SELECT {SOURCE} FROM tr) GROUP BY 2")
def _(spark, sf):
    df = ev(spark, sf)
    return jobs.leakage_audit(df.where("eid % 2 = 0"), df.where("eid % 2 = 1"))


@query("k4_leakage_report")
def _(spark, sf):
    """The audit with the views' invariance and the documents' overlap."""
    df = ev(spark, sf)
    return jobs.leakage_report(df.where("eid % 2 = 0"), df.where("eid % 2 = 1"))


_EM = "em(i, b, s, m) AS (SELECT 0, 0.6::DOUBLE, 0.3::DOUBLE, 0.1::DOUBLE UNION ALL SELECT i + 1, n.b, n.s, n.m FROM em, LATERAL (SELECT avg(x / (x + y + z)) AS b, avg(y / (x + y + z)) AS s, avg(z / (x + y + z)) AS m FROM (SELECT p_benign * em.b / 0.6::DOUBLE AS x, p_suspicious * em.s / 0.3::DOUBLE AS y, p_malicious * em.m / 0.1::DOUBLE AS z FROM pr)) n WHERE i < 20)"


@query("k5_prior_calibration", "WITH RECURSIVE " + PR.removeprefix("WITH ") + ", " + _EM + f", c AS (SELECT {argmax(1)} AS raw, {argmax(10)} AS deployed, p_benign * (b / 0.6::DOUBLE) AS x, p_suspicious * (s / 0.3::DOUBLE) AS y, p_malicious * (m / 0.1::DOUBLE) AS z FROM pr, (SELECT * FROM em WHERE i = 20)) SELECT raw, CASE WHEN x >= y AND x >= z THEN 'benign' WHEN y >= z THEN 'suspicious' ELSE 'malicious' END AS calibrated, count(*) AS n, count_if(CASE WHEN x >= y AND x >= z THEN 'benign' WHEN y >= z THEN 'suspicious' ELSE 'malicious' END = deployed) AS agreed FROM c GROUP BY ALL")
def _(spark, sf):
    df = with_probabilities(ev(spark, sf))
    deployed = df.select("event_id", decide.weighted_argmax(decide.probabilities(), None, {"benign": 10}).alias("pred_label"))
    return jobs.prior_calibration(df, [0.6, 0.3, 0.1], deployed, 20)


@query("k6_rare_source_routing", EV + f", s AS (SELECT *, {SOURCE} AS source FROM ev), e AS (SELECT source FROM s WHERE eid % 2 = 0 GROUP BY source HAVING count(*) >= 500) SELECT event_id, CASE WHEN source IN (SELECT source FROM e) THEN 'benign' ELSE {_STUB} END AS pred_label FROM s")
def _(spark, sf):
    df = ev(spark, sf)
    base = df.select("event_id", F.lit("benign").alias("pred_label"))
    return jobs.rare_source_routing(df.where("eid % 2 = 0"), df, base, requests.keyword_model, 500, SYSTEM)


@query("k7_recoverability", EV + ", " + long_sql(("pipeline", "src_port", "vendor_name", "product_name"), "CASE WHEN label_binary = 'suspicious' THEN 'true' ELSE 'false' END") + ", " + INFORMATION)
def _(spark, sf):
    return jobs.recoverability(ev(spark, sf), "label", ["pipeline", "src_port", "vendor_name", "product_name"])


@query("k7_recoverability_report")
def _(spark, sf):
    df = _events(spark, sf)
    return jobs.recoverability_report(df.where("eid % 2 = 0"), df.where("eid % 2 = 1"), "label", ["pipeline", "vendor_name", "product_name"], **SMALL)


@query("k8_time_independence")
def _(spark, sf):
    df = _events(spark, sf)
    _, model, mask = jobs.train(df, CONFIG)
    rule = aggregates.verdict_rule(df, *documents.verdict_cell(df), "label", 10, 0.5)
    return jobs.time_independence(df, model, CONFIG.document, 1.7e9, mask, rule)


@query("k8_time_probe")
def _(spark, sf):
    """How well content and time-free documents tell the first half of a month from the second."""
    df = _events(spark, sf)
    return jobs.time_probe(df, F.dayofmonth(time.instant(F.col("timestamp"))) <= 15, ["content", "timefree"], **SMALL)


@query("k9_zero_shot_probe", EV + f", s AS (SELECT *, {SOURCE} AS source, label_binary AS label, message_sanitized AS m, {views_sql.timefree()} AS t, " + H.format(0) + f" AS h FROM ev), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, label, m ORDER BY h, event_id) AS rn FROM s) WHERE rn = 1), f AS (SELECT *, row_number() OVER (PARTITION BY source, label, t ORDER BY h, event_id) AS tn FROM o), c AS (SELECT *, {_STUB} AS pred, row_number() OVER (PARTITION BY source, label ORDER BY CASE WHEN tn = 1 THEN 0 ELSE 1 END, h, event_id) AS place FROM f) SELECT source, count(*) AS n, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN (pred <> 'benign') = (label <> 'benign') THEN 1.0 ELSE 0.0 END), 6) AS alert_accuracy FROM c WHERE place <= 5 GROUP BY source")
def _(spark, sf):
    return jobs.zero_shot_probe(ev(spark, sf), requests.keyword_model, SYSTEM)


@query("k10_run_report")
def _(spark, sf):
    df = _events(spark, sf)
    run = jobs.hybrid(df.where("eid % 2 = 0"), df.where("eid % 2 = 1").drop("source"), requests.keyword_model, novelty=0.3, budget=50, dims=10, vocabulary=2000, iterations=10)
    return jobs.run_report(run, df)


@query("k10_run_metrics")
def _(spark, sf):
    df = _events(spark, sf)
    run = io.staged(jobs.hybrid(df.where("eid % 2 = 0"), df.where("eid % 2 = 1").drop("source"), requests.keyword_model, novelty=0.3, budget=50, dims=10, vocabulary=2000, iterations=10))
    return jobs.run_metrics(run, df).select("part", "source", "items", *[F.round(c, 2).alias(c) for c in ("accuracy", "macro_f1", "cost_m5")])


def _stream(spark, sf):
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return raw.selectExpr(*[f"{e.format(EPOCH=_SPARK_EPOCH)} AS {n}" for n, e in ADAPTER.items()])


@query("x1_streamed_scoring", f"WITH {VERDICT_SQL}, pr AS (SELECT *, 1 - p_suspicious - p_malicious AS p_benign FROM (SELECT *, {P_SUSPICIOUS} AS p_suspicious, {P_MALICIOUS} AS p_malicious FROM vd)) SELECT event_id, {SOURCE} AS source, verdict, {least(10)} AS pred_label FROM pr")
def _(spark, sf):
    out = _scratch(spark)
    stream.write_stream(stream.scored(_stream(spark, sf)), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("event_id string, source string, verdict string, pred_label string").parquet(f"{out}/rows")


_WINDOWS = f"WITH {VERDICT_SQL} SELECT strftime(date_trunc('hour', e.ts), '%Y-%m-%d %H') AS start, trim(coalesce(vendor_name, '')) || '/' || trim(coalesce(product_name, '')) AS source, verdict, count(*) AS n FROM vd JOIN events e ON e.event_id = vd.eid"


@query("x2_windowed_verdicts", _WINDOWS + " GROUP BY ALL")
def _(spark, sf):
    df = ev(spark, sf).drop("source")
    counts = stream.verdict_counts(df.withColumn("at", time.instant(F.col("timestamp"))))
    return counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "source", "verdict", "n")


@query("x2_streamed_windows", _WINDOWS + " GROUP BY ALL")
def _(spark, sf):
    """The same counts, of closed and of open windows, from a stream that has run to its end."""
    counts = stream.verdict_counts(_stream(spark, sf).withColumn("at", time.instant(F.col("timestamp"))))
    out = _scratch(spark)
    stream.write_running_counts(counts, f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    return stream.read_running_counts(spark, f"{out}/counts").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "source", "verdict", "n")
