"""Queries of filters, joins, aggregations, samples, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftlog.functions import text, time
from siftlog.operators import aggregates, documents, metrics, models, requests, route, sampling
from siftlog.plans.registry import SOURCE, VERDICT_SQL, query
from siftlog.schema import EVENTS_SQL, LABELLED_SQL, LABELS, PROBS_SQL, labelled_documents, read, security_events, with_probabilities

EV = f"WITH {EVENTS_SQL} "
VD = f"WITH {VERDICT_SQL} "
PR = f"WITH {EVENTS_SQL}, {PROBS_SQL} "
LD = f"WITH {LABELLED_SQL} "
CUT = "(SELECT quantile_disc(timestamp, 0.5) FROM ev)"


def ev(spark, sf):
    df = security_events(spark, sf)
    return df.withColumns({"source": documents.source_key(df), "label": F.col("label_binary")})


def train_valid(spark, sf):
    """Even and odd identifiers stand for the training and the validation table."""
    df = ev(spark, sf)
    return df.where("eid % 2 = 0"), df.where("eid % 2 = 1")


# --- filters ---


@query("f1_pattern_filter", EV + "SELECT event_id FROM ev WHERE contains(message_sanitized, 'HOST-') OR regexp_matches(message_sanitized, 'act=[A-Z]+')")
def _(spark, sf):
    m = F.col("message_sanitized")
    return ev(spark, sf).where(m.contains("HOST-") | m.rlike("act=[A-Z]+")).select("event_id")


@query("f2_before_cutoff", EV + "SELECT event_id FROM ev WHERE timestamp < (SELECT min(timestamp) + 86400 FROM ev)")
def _(spark, sf):
    df = ev(spark, sf)
    cut = df.agg((F.min("timestamp") + 86400).alias("t"))
    return df.join(F.broadcast(cut), F.col("timestamp") < F.col("t")).select("event_id")


@query("f3_novel_messages", EV + "SELECT event_id FROM ev WHERE eid % 2 = 1 AND message_sanitized NOT IN (SELECT message_sanitized FROM ev WHERE eid % 2 = 0)")
def _(spark, sf):
    train, valid = train_valid(spark, sf)
    return valid.join(train.select("message_sanitized").distinct(), "message_sanitized", "left_anti").select("event_id")


@query("f4_seen_rate", EV + "SELECT count(*) AS n, count_if(message_sanitized IN (SELECT message_sanitized FROM ev WHERE eid % 2 = 0)) AS seen FROM ev WHERE eid % 2 = 1")
def _(spark, sf):
    train, valid = train_valid(spark, sf)
    known = train.select("message_sanitized").distinct().withColumn("known", F.lit(True))
    return valid.join(known, "message_sanitized", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known")).alias("seen"))


@query("f5_unseen_sources", EV + f", s AS (SELECT {SOURCE} || '/' || pipeline || '/' || src_host AS s, eid FROM ev) SELECT DISTINCT s AS source FROM s WHERE eid % 2 = 1 AND s NOT IN (SELECT s FROM s WHERE eid % 2 = 0)")
def _(spark, sf):
    train, valid = (t.select(F.concat_ws("/", "source", "pipeline", "src_host").alias("source")).distinct() for t in train_valid(spark, sf))
    return valid.join(train, "source", "left_anti")


@query("f6_rare_sources", EV + f", s AS (SELECT {SOURCE} AS source, event_id FROM ev) SELECT event_id, source FROM s WHERE source IN (SELECT source FROM s GROUP BY source HAVING count(*) < (SELECT count(*) / 8 FROM s))")
def _(spark, sf):
    df = ev(spark, sf)
    enough = df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(df.agg((F.count(F.lit(1)) / 8).alias("least")))).where("n >= least")
    return df.join(enough.select("source"), "source", "left_anti").select("event_id", "source")


@query("f7_day_subset", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count_if(hour(ts) >= 12) AS afternoon FROM events GROUP BY ALL")
def _(spark, sf):
    rows = ev(spark, sf).select(time.day(F.col("timestamp")).alias("day"), F.hour(time.instant(F.col("timestamp"))).alias("h"))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") >= 12).alias("afternoon"))


# --- joins ---

KEYS = ["pipeline", "source", "src_port", "verdict", "label"]


@query("j1_decisions_back_to_events", VD + f", e AS (SELECT *, {SOURCE} AS source, coalesce(src_port, '') AS port FROM vd), d AS (SELECT pipeline, source, port, verdict, min(eid) AS doc_id FROM e GROUP BY ALL) SELECT e.event_id, d.doc_id FROM e JOIN d USING (pipeline, source, port, verdict)")
def _(spark, sf):
    rows = ev(spark, sf).withColumns({"port": F.coalesce("src_port", F.lit("")), "verdict": text.firewall_verdict(F.col("message_sanitized"))})
    keys = ["pipeline", "source", "port", "verdict"]
    docs = rows.groupBy(*keys).agg(F.min("eid").alias("doc_id"))
    return rows.join(docs, keys, "left").select("event_id", "doc_id")


@query("j2_truth_by_id", EV + "SELECT event_id, label_binary AS truth, CASE WHEN eid % 4 = 0 THEN 'benign' ELSE label_binary END AS pred FROM ev WHERE eid % 3 = 0")
def _(spark, sf):
    df = ev(spark, sf)
    pred = df.where("eid % 3 = 0").select("event_id", F.when(F.col("eid") % 4 == 0, "benign").otherwise(F.col("label")).alias("pred"))
    return pred.join(df.select("event_id", F.col("label").alias("truth")), "event_id").select("event_id", "truth", "pred")


@query("j3_prediction_metadata", EV + f"SELECT e.event_id, {SOURCE} AS source, CASE WHEN eid % 3 = 0 THEN label_binary END AS pred FROM ev e")
def _(spark, sf):
    df = ev(spark, sf)
    return df.select("event_id", "source").join(df.where("eid % 3 = 0").select("event_id", F.col("label").alias("pred")), "event_id", "left")


@query("j4_agreement", PR + ", d AS (SELECT CASE WHEN p_benign >= p_suspicious AND p_benign >= p_malicious THEN 'benign' WHEN p_suspicious >= p_malicious THEN 'suspicious' ELSE 'malicious' END AS a, label_binary AS b FROM pr) SELECT count(*) AS n, count_if(a = b) AS same FROM d")
def _(spark, sf):
    from siftlog.operators import decide

    df = ev(spark, sf)
    other = with_probabilities(df).select("event_id", decide.weighted_argmax(decide.probabilities()).alias("a"))
    return df.join(other, "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("label")).alias("same"))


@query("j5_probs_novelty_replies", EV + "SELECT eid, pipeline AS holdout, CASE WHEN eid % 2 = 0 THEN cast(eid % 100 AS double) / 100 END AS maxsim, CASE WHEN eid % 3 = 0 THEN label_binary END AS reply FROM ev")
def _(spark, sf):
    df = ev(spark, sf).select("eid", F.col("pipeline").alias("holdout"), "label")
    novelty = df.where("eid % 2 = 0").select("holdout", "eid", ((F.col("eid") % 100).cast("double") / 100).alias("maxsim"))
    replies = df.where("eid % 3 = 0").select("holdout", "eid", F.col("label").alias("reply"))
    return df.join(novelty, ["holdout", "eid"], "left").join(replies, ["holdout", "eid"], "left").select("eid", "holdout", "maxsim", "reply")


@query("j6_allowed_labels", EV + f", s AS (SELECT *, {SOURCE} AS source FROM ev), m AS (SELECT source, list_sort(list(DISTINCT label_binary)) AS labels FROM s WHERE eid % 2 = 0 GROUP BY source) SELECT event_id, array_to_string(m.labels, ',') AS allowed, list_contains(m.labels, label_binary) AS known_pair FROM s LEFT JOIN m USING (source) WHERE eid % 2 = 1")
def _(spark, sf):
    train, valid = train_valid(spark, sf)
    mask = aggregates.source_mask(train, "source", "label", 1)
    return valid.join(mask, "source", "left").select("event_id", F.array_join("labels", ",").alias("allowed"), F.array_contains("labels", F.col("label")).alias("known_pair"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: cast(q.embedding[i] AS double) * r.embedding[i]))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: cast(x AS double) * x)))"


@query("j7_rule_rows_by_id", VD + "SELECT event_id, vendor_state, verdict FROM vd WHERE eid % 3 = 0")
def _(spark, sf):
    df = ev(spark, sf)
    state, verdict = documents.verdict_cell(df)
    rows = df.select("event_id", state.alias("vendor_state"), verdict.alias("verdict"))
    return df.where("eid % 3 = 0").select("event_id").join(rows, "event_id")


@query("j8_nearest_neighbour", f"WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT * FROM embeddings WHERE vec_id % 50 <> 0) SELECT q.vec_id, round(max({_DOT} / ({_NORM.format('q')} * {_NORM.format('r')})), 3) AS maxsim FROM q, r GROUP BY q.vec_id")
def _(spark, sf):
    vectors = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    best = models.max_similarity(vectors.where("vec_id % 50 = 0"), vectors.where("vec_id % 50 <> 0"), "vec_id")
    return best.select("vec_id", F.round("maxsim", 3).alias("maxsim"))


@query("j9_override", EV + "SELECT event_id, CASE WHEN eid % 5 = 0 THEN CASE WHEN label_binary = 'malicious' THEN 'suspicious' ELSE label_binary END ELSE 'benign' END AS pred_label FROM ev")
def _(spark, sf):
    df = ev(spark, sf)
    return requests.override(df.select("event_id", F.lit("benign").alias("pred_label")), df.where("eid % 5 = 0").select("event_id", "label"))


@query("j10_configurations_over_cells", EV + ", c AS (SELECT pipeline, label_binary AS label, count(*) AS n FROM ev GROUP BY ALL), g AS (SELECT unnest([1, 2, 5, 10]) AS w) SELECT w, pipeline, cast(sum(CASE WHEN label = 'benign' THEN n * w ELSE n END) AS bigint) AS cost FROM c, g GROUP BY ALL")
def _(spark, sf):
    cells = ev(spark, sf).groupBy("pipeline", "label").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(w,) for w in (1, 2, 5, 10)], "w int")
    crossed = cells.join(F.broadcast(grid))  # a few configurations over summed cells
    return crossed.groupBy("w", "pipeline").agg(F.sum(F.when(F.col("label") == "benign", F.col("n") * F.col("w")).otherwise(F.col("n"))).alias("cost"))


# --- aggregations ---


@query("a1_unique_documents", EV + f", s AS (SELECT message_sanitized AS doc, label_binary AS label, event_id, {SOURCE} AS source FROM ev) SELECT doc, label, count(*) AS rows, min(event_id) AS event_id, min_by(source, event_id) AS source FROM s GROUP BY doc, label")
def _(spark, sf):
    return aggregates.unique_documents(ev(spark, sf).withColumn("doc", F.col("message_sanitized")))


@query("a2_unique_scoring_documents", EV + f"SELECT pipeline, {SOURCE} AS source, coalesce(src_port,'') AS port, message_sanitized AS doc, count(*) AS rows, min(event_id) AS event_id FROM ev GROUP BY ALL")
def _(spark, sf):
    df = ev(spark, sf).withColumns({"port": F.coalesce("src_port", F.lit("")), "doc": F.col("message_sanitized")})
    return aggregates.unique_documents(df, ("pipeline", "source", "port", "doc"), first=())


@query("a3_label_distribution", EV + "SELECT label, (SELECT count(*) FROM ev WHERE label_binary = label) AS count, place FROM (VALUES ('benign', 0), ('suspicious', 1), ('malicious', 2)) t(label, place)")
def _(spark, sf):
    return aggregates.label_distribution(ev(spark, sf))


@query("a4_source_mask", EV + f", s AS (SELECT {SOURCE} AS source, label_binary AS label FROM ev) SELECT source, count(*) AS rows, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM s GROUP BY source HAVING count(*) >= 100")
def _(spark, sf):
    return aggregates.source_mask(ev(spark, sf), "source", "label", 100).withColumn("labels", F.array_join("labels", ","))


@query("a5_verdict_rule", VD + ", c AS (SELECT label_binary AS label, count(*) AS n FROM vd WHERE vendor_state = 'missing' AND verdict = 'block' GROUP BY ALL) SELECT (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS label, cast(sum(n) AS bigint) AS support, round(max(n) / sum(n), 6) AS purity FROM c")
def _(spark, sf):
    df = ev(spark, sf)
    state, verdict = documents.verdict_cell(df)
    rule = aggregates.verdict_rule(df, state, verdict, "label", 10, 0.5)
    return spark.createDataFrame([(rule["label"], rule["support"], rule["purity"])], "label string, support long, purity double").withColumn("purity", F.round("purity", 6))


@query("a6_date_rule", EV + ", m AS (SELECT CASE WHEN eid < 50 THEN 'malicious' ELSE label_binary END AS label, timestamp + eid * 1e6 AS t FROM ev) SELECT min(CASE WHEN label <> 'malicious' THEN t END) AS cutoff FROM m")
def _(spark, sf):
    df = ev(spark, sf).select(F.when(F.col("eid") < 50, "malicious").otherwise(F.col("label")).alias("label"), (F.col("timestamp") + F.col("eid") * F.lit(1e6)).alias("t"))
    return spark.createDataFrame([(aggregates.date_rule(df, "t", "label"),)], "cutoff double")


def long_sql(columns: tuple[str, ...], y: str = "label_binary", source: str = "ev") -> str:
    return "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(cast({c} AS string), '') AS value, {y} AS y FROM {source}" for c in columns) + ")"


_LONG = ", " + long_sql(("pipeline", "src_port", "vendor_name", "src_host"))
PURITY = 'n AS (SELECT "column", value, y, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT "column", value, max(n) AS top, sum(n) AS n FROM n GROUP BY ALL) SELECT "column", count(*) AS n_values, round(sum(top) / sum(n), 6) AS purity FROM b GROUP BY ALL'
INFORMATION = 'j AS (SELECT "column", value, y, count(*) AS n FROM l GROUP BY ALL), x AS (SELECT "column", sum(nx * ln(nx)) AS xx, sum(jj) AS jj, sum(nx) AS n FROM (SELECT "column", value, sum(n) AS nx, sum(n * ln(n)) AS jj FROM j GROUP BY ALL) GROUP BY ALL), y AS (SELECT "column", sum(ny * ln(ny)) AS yy FROM (SELECT "column", y, sum(n) AS ny FROM j GROUP BY ALL) GROUP BY ALL) SELECT x."column", round(greatest(((jj - xx - yy) / n + ln(n)) / (ln(n) - yy / n), 0), 6) AS norm_mi FROM x JOIN y USING ("column")'


@query("a7_column_purity", EV + _LONG + ", " + PURITY)
def _(spark, sf):
    return aggregates.column_purity(ev(spark, sf), ["pipeline", "src_port", "vendor_name", "src_host"], "label")


@query("a8_keyword_labels", EV + ", k AS (SELECT unnest(['deny','accept','block','user']) AS keyword) SELECT keyword, label_binary AS label, count(*) AS n FROM ev, k WHERE contains(lower(message_sanitized), keyword) GROUP BY ALL")
def _(spark, sf):
    return aggregates.keyword_labels(ev(spark, sf), "message_sanitized", "label", ["deny", "accept", "block", "user"])


@query("a9_mutual_information", EV + _LONG + ", " + INFORMATION)
def _(spark, sf):
    return aggregates.mutual_information(ev(spark, sf), ["pipeline", "src_port", "vendor_name", "src_host"], "label")


@query("a10_value_rates", EV + ", s AS (SELECT src_port AS v, count(*) AS n, round(avg(CASE WHEN label_binary = 'suspicious' THEN 1.0 ELSE 0.0 END), 6) AS rate, count(DISTINCT src_host) AS hosts FROM ev WHERE eid % 2 = 0 AND src_port IS NOT NULL GROUP BY ALL HAVING count(*) >= 20) SELECT v AS src_port, n, rate, hosts, v IN (SELECT src_port FROM ev WHERE eid % 2 = 1 AND src_port IS NOT NULL) AS seen FROM s ORDER BY rate DESC, n DESC, v LIMIT 6")
def _(spark, sf):
    train, valid = (t.where("src_port is not null") for t in train_valid(spark, sf))
    return aggregates.value_rates(train, "src_port", F.col("label") == "suspicious", "src_host", valid, 20, 6).select("src_port", "n", "rate", "hosts", "seen")


@query("a11_crosstab", EV + "SELECT pipeline, " + ", ".join(f"count_if(label_binary = '{x}') AS {x}" for x in LABELS) + ", count(*) AS total, " + ", ".join(f"round(count_if(label_binary = '{x}') / count(*), 6) AS share_{x}" for x in LABELS) + " FROM ev GROUP BY pipeline")
def _(spark, sf):
    return aggregates.crosstab(ev(spark, sf), "pipeline", "label")


@query("a12_time_audit", "WITH " + EVENTS_SQL + ", x AS (SELECT label_binary AS label, strftime(ts, '%Y-%m-%d') AS d, hour(ts) AS h FROM ev JOIN events e ON e.event_id = ev.eid), a AS (SELECT label, count(*) AS rows, min(d) AS first_day, max(d) AS last_day, count(DISTINCT d) AS days FROM x GROUP BY label), td AS (SELECT label, max(n) AS n FROM (SELECT label, d, count(*) AS n FROM x GROUP BY ALL) GROUP BY label), th AS (SELECT label, max(n) AS n FROM (SELECT label, h, count(*) AS n FROM x GROUP BY ALL) GROUP BY label) SELECT a.*, round(td.n / a.rows, 6) AS top_day_share, round(th.n / a.rows, 6) AS top_hour_share FROM a JOIN td USING (label) JOIN th USING (label)")
def _(spark, sf):
    return aggregates.time_audit(ev(spark, sf), "label", time.day(F.col("timestamp")), F.hour(time.instant(F.col("timestamp"))))


@query("a13_id_range", EV + "SELECT label_binary AS label, min(eid) AS first_id, max(eid) AS last_id FROM ev GROUP BY ALL")
def _(spark, sf):
    return ev(spark, sf).groupBy("label").agg(F.min(text.id_number(F.col("event_id"))).alias("first_id"), F.max(text.id_number(F.col("event_id"))).alias("last_id"))


@query("a14_pseudonym_audit", EV + ", x AS (SELECT label_binary AS label, unnest(list_distinct(regexp_extract_all(message_sanitized, '(?:USER|ORG|CRED|HOST)-[0-9]{4}'))) AS namespace FROM ev), c AS (SELECT label, namespace, count(*) AS n FROM x GROUP BY ALL) SELECT * FROM (SELECT label, namespace, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, namespace) AS rn FROM c) WHERE rn <= 6")
def _(spark, sf):
    counts = ev(spark, sf).select("label", F.explode(text.namespaces(F.col("message_sanitized"))).alias("namespace")).groupBy("label", "namespace").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.top_by(counts, ["label"], [F.desc("n"), F.col("namespace")], 6).withColumn("rn", F.col("rn").cast("long"))


@query("a15_document_overlap", EV + ", t AS (SELECT message_sanitized AS d, count(DISTINCT label_binary) AS k FROM ev WHERE eid % 2 = 0 GROUP BY d) SELECT (SELECT count(*) FROM t) AS unique_train, (SELECT count(*) FROM t WHERE k > 1) AS two_label, count_if(message_sanitized IN (SELECT d FROM t)) AS seen, count(*) AS n FROM ev WHERE eid % 2 = 1")
def _(spark, sf):
    train, valid = train_valid(spark, sf)
    docs = train.groupBy("message_sanitized").agg(F.count_distinct("label").alias("k"))
    sums = docs.agg(F.count(F.lit(1)).alias("unique_train"), F.count_if(F.col("k") > 1).alias("two_label"))
    seen = valid.join(docs.withColumn("known", F.lit(True)), "message_sanitized", "left").agg(F.count_if(F.col("known")).alias("seen"), F.count(F.lit(1)).alias("n"))
    return sums.join(F.broadcast(seen))


@query("a16_source_shares", EV + f", s AS (SELECT {SOURCE} AS source, eid FROM ev), c AS (SELECT source, count_if(eid % 2 = 0) AS n_a, count_if(eid % 2 = 1) AS n_b FROM s GROUP BY source) SELECT source, n_a, n_b, round(n_a / (SELECT sum(n_a) FROM c), 6) AS share_a, round(n_b / (SELECT sum(n_b) FROM c), 6) AS share_b FROM c")
def _(spark, sf):
    return aggregates.share_change(*train_valid(spark, sf), "source")


@query("a17_training_weights", EV + ", u AS (SELECT message_sanitized AS doc, label_binary AS label, count(*) AS rows FROM ev GROUP BY ALL), b AS (SELECT *, ln(1 + cast(rows AS double)) AS base FROM u), s AS (SELECT label, sum(base) AS sb FROM b GROUP BY label), t AS (SELECT count(*) AS docs, count(DISTINCT label) AS k FROM b) SELECT doc, b.label, round(base * docs / (k * sb), 6) AS weight FROM b JOIN s USING (label), t")
def _(spark, sf):
    unique = aggregates.unique_documents(ev(spark, sf).withColumn("doc", F.col("message_sanitized")))
    return aggregates.training_weights(unique, "log").select("doc", "label", F.round("weight", 6).alias("weight"))


@query("a18_class_weights", EV + "SELECT label_binary AS label, count(*) AS n, round((SELECT count(*) FROM ev) / ((SELECT count(DISTINCT label_binary) FROM ev) * count(*)), 6) AS weight FROM ev GROUP BY ALL")
def _(spark, sf):
    return aggregates.class_weights(ev(spark, sf))


@query("a19_recall_by_source", EV + f", p AS (SELECT {SOURCE} AS source, label_binary AS label, v, CASE WHEN v = 'B' AND eid % 3 = 0 OR v = 'C' AND eid % 4 = 0 THEN 'benign' ELSE label_binary END AS pred FROM ev, (VALUES ('B'), ('C')) t(v)) SELECT v AS version, source, count(*) AS n, round(avg(CASE WHEN pred = 'malicious' THEN 1.0 ELSE 0.0 END), 6) AS recall FROM p WHERE label = 'malicious' GROUP BY ALL")
def _(spark, sf):
    df = ev(spark, sf).where(F.col("label") == "malicious")
    versions = F.array(*[F.struct(F.lit(v).alias("version"), F.when(F.col("eid") % k == 0, "benign").otherwise(F.col("label")).alias("pred")) for v, k in (("B", 3), ("C", 4))])
    rows = df.select("source", F.inline(versions))
    return rows.groupBy("version", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") == "malicious").cast("double")), 6).alias("recall"))


_DIAG = "CASE WHEN eid % 7 = 0 THEN 'benign' WHEN eid % 7 = 1 THEN 'suspicious' ELSE label_binary END AS clf, CASE WHEN eid % 5 = 0 THEN 'suspicious' ELSE label_binary END AS fin, eid % 2 = 0 AS routed"


@query("a20_run_diagnostics", EV + f", d AS (SELECT {SOURCE} AS source, label_binary AS truth, {_DIAG} FROM ev) SELECT source, count_if(routed) AS routed, count_if(clf <> fin) AS changed, count_if(clf <> 'benign' AND fin = 'benign') AS vetoed, count_if(clf = 'benign' AND fin <> 'benign') AS raised, count_if(clf <> fin AND clf <> 'benign' AND fin <> 'benign') AS retyped, count_if(clf <> truth AND fin = truth) AS fixed, count_if(clf = truth AND fin <> truth) AS broken FROM d GROUP BY ALL")
def _(spark, sf):
    d = ev(spark, sf).select("source", F.col("label").alias("truth"), F.expr("CASE WHEN eid % 7 = 0 THEN 'benign' WHEN eid % 7 = 1 THEN 'suspicious' ELSE label END AS clf"), F.expr("CASE WHEN eid % 5 = 0 THEN 'suspicious' ELSE label END AS final"), F.expr("eid % 2 = 0 AS routed"))
    return metrics.diagnostics(d)


@query("a21_version_flips", EV + f", d AS (SELECT {_DIAG} FROM ev) SELECT clf AS before, fin AS after, count(*) AS n FROM d WHERE clf <> fin GROUP BY ALL")
def _(spark, sf):
    d = ev(spark, sf).selectExpr("CASE WHEN eid % 7 = 0 THEN 'benign' WHEN eid % 7 = 1 THEN 'suspicious' ELSE label END AS before", "CASE WHEN eid % 5 = 0 THEN 'suspicious' ELSE label END AS after")
    return d.where("before <> after").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("a22_reply_statistics", "SELECT role, count(*) AS n, count_if(regexp_matches(text, '(?i)\\b(benign|suspicious|malicious)\\b')) AS parsed, round(count_if(regexp_matches(text, '(?i)\\b(benign|suspicious|malicious)\\b')) / count(*), 6) AS parse_rate, " + ", ".join(f"round(quantile_cont(length(text), {p / 100}), 6) AS tokens_p{p}" for p in (50, 90, 99)) + " FROM conversations GROUP BY role")
def _(spark, sf):
    rows = read(spark, sf, "conversations").select("role", requests.parse_reply(F.col("text")).alias("label"), F.length("text").alias("output_tokens"))
    return requests.reply_statistics(rows, "role")


@query("a23_novelty_percentiles", EV + "SELECT pipeline AS kind, " + ", ".join(f"round(quantile_cont(cast(eid % 1000 AS double) / 1000, {p}), 6) AS p{i}" for i, p in enumerate((0.01, 0.05, 0.5))) + " FROM ev GROUP BY ALL")
def _(spark, sf):
    rows = ev(spark, sf).select(F.col("pipeline").alias("kind"), ((F.col("eid") % 1000).cast("double") / 1000).alias("maxsim"))
    q = sampling.percentiles(rows, "kind", "maxsim", (0.01, 0.05, 0.5))
    return q.select("kind", *[F.round(F.get("q", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


# --- samples and folds ---

H = "md5(event_id || '|' || '{0}')"


@query("w1_stratified_sample", EV + ", c AS (SELECT label_binary AS label, count(*) AS n, 1000 * count(*) / (SELECT count(*) FROM ev) AS share FROM ev GROUP BY ALL), q AS (SELECT label, greatest(1, floor(share)) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, label) = 1 THEN 1000 - (SELECT sum(greatest(1, floor(share))) FROM c) ELSE 0 END AS quota FROM c), r AS (SELECT event_id, label_binary AS label, row_number() OVER (PARTITION BY label_binary ORDER BY " + H.format(42) + ", event_id) AS rn FROM ev) SELECT event_id, r.label FROM r JOIN q USING (label) WHERE rn <= quota")
def _(spark, sf):
    df = ev(spark, sf)
    return sampling.stratified_sample(df.select("event_id", "label"), "label", "event_id", 1000, 42).select("event_id", "label")


@query("w2_cell_cap", EV + f", s AS (SELECT event_id, {SOURCE} AS source, label_binary AS label FROM ev) SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY source, label ORDER BY " + H.format(1) + ", event_id) AS rn FROM s) WHERE rn <= 50")
def _(spark, sf):
    return sampling.cap_cells(ev(spark, sf).select("event_id", "source", "label"), ["source", "label"], 50, "event_id", 1).select("event_id")


@query("w3_uniform_sample", EV + "SELECT event_id FROM ev ORDER BY " + H.format(3) + ", event_id LIMIT 200")
def _(spark, sf):
    return sampling.uniform_sample(ev(spark, sf).select("event_id"), 200, "event_id", 3)


@query("w4_holdout_split", EV + ", r AS (SELECT event_id, row_number() OVER (PARTITION BY label_binary ORDER BY " + H.format(5) + ", event_id) AS rn, count(*) OVER (PARTITION BY label_binary) AS n FROM ev) SELECT event_id, CASE WHEN rn <= least(ceil(n * 0.2::DOUBLE), n - 1) THEN 'holdout' ELSE 'train' END AS part FROM r")
def _(spark, sf):
    return sampling.holdout_split(ev(spark, sf).select("event_id", "label"), "label", "event_id", 0.2, 5).select("event_id", "part")


@query("w5_stratified_folds", EV + "SELECT event_id, cast((row_number() OVER (PARTITION BY label_binary ORDER BY " + H.format(5) + ", event_id) - 1) % 5 AS int) AS fold FROM ev")
def _(spark, sf):
    return sampling.stratified_folds(ev(spark, sf).select("event_id", "label"), "label", "event_id", 5, 5).select("event_id", "fold")


@query("w6_group_folds")
def _(spark, sf):
    return sampling.group_folds(ev(spark, sf).select("event_id", "src_host"), "src_host", 5)


@query("w7_stratified_group_folds")
def _(spark, sf):
    return sampling.group_folds(ev(spark, sf).select("event_id", "src_host", "label"), "src_host", 5, "label")


@query("w8_time_split", EV + "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY timestamp, event_id) <= (SELECT cast(floor(0.8 * count(*)) AS bigint) FROM ev) THEN 'train' ELSE 'test' END AS part FROM ev")
def _(spark, sf):
    return sampling.time_split(ev(spark, sf).select("event_id", "timestamp"), "timestamp", "event_id").select("event_id", "part")


@query("w9_holdouts", LD + ", s AS (SELECT source, count(DISTINCT label) AS k FROM ld GROUP BY source) SELECT doc_id, 'loso' AS kind, source AS holdout FROM ld UNION ALL SELECT doc_id, 'loco', source || '|' || label FROM ld JOIN s USING (source) WHERE k > 1")
def _(spark, sf):
    return sampling.holdouts(labelled_documents(spark, sf)).select("doc_id", "kind", "holdout")


@query("w10_round_robin", EV + f", s AS (SELECT event_id, {SOURCE} AS source, row_number() OVER (PARTITION BY {SOURCE} ORDER BY event_id) AS rn FROM ev) SELECT event_id, source FROM s ORDER BY rn, source LIMIT 30")
def _(spark, sf):
    return sampling.round_robin(ev(spark, sf).select("event_id", "source"), "source", "event_id", 30)


@query("w11_templates_first", EV + f", s AS (SELECT event_id, {SOURCE} AS source, label_binary AS label, message_sanitized AS m, regexp_replace(message_sanitized, '[0-9]+', '0', 'g') AS t, " + H.format(2) + " AS h FROM ev), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, label, m ORDER BY h, event_id) AS rn FROM s) WHERE rn = 1), f AS (SELECT *, row_number() OVER (PARTITION BY source, label, t ORDER BY h, event_id) AS tn FROM o) SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY source, label ORDER BY CASE WHEN tn = 1 THEN 0 ELSE 1 END, h, event_id) AS n FROM f) WHERE n <= 5")
def _(spark, sf):
    df = ev(spark, sf).select("event_id", "source", "label", F.col("message_sanitized").alias("m"), F.regexp_replace("message_sanitized", "[0-9]+", "0").alias("t"))
    return sampling.first_of_templates(df, ["source", "label"], "t", "m", "event_id", 5, 2).select("event_id")


@query("w12_sample_of_each_holdout", LD + ", h AS (SELECT doc_id, source AS holdout, row_number() OVER (PARTITION BY source ORDER BY md5(cast(doc_id AS string) || '|4'), doc_id) AS rn FROM ld) SELECT doc_id, holdout FROM h WHERE rn <= 3")
def _(spark, sf):
    plan = labelled_documents(spark, sf).select("doc_id", F.lit("loso").alias("kind"), F.col("source").alias("holdout"))
    return sampling.ranked(plan, ["kind", "holdout"], "doc_id", 4).where("rn <= 3").select("doc_id", "holdout")


@query("w13_band_samples", PR + ", b AS (SELECT event_id, CASE WHEN p_benign < 0.3 THEN 0 WHEN p_benign < 0.6 THEN 1 ELSE 2 END AS band FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY " + H.format(9) + ", event_id) AS rn FROM b) SELECT event_id, band FROM r WHERE rn <= 40")
def _(spark, sf):
    return sampling.band_samples(with_probabilities(ev(spark, sf)).select("event_id", "p_benign"), "p_benign", [0.3, 0.6], 40, "event_id", 9).select("event_id", "band")


# --- rankings and sets ---

_ROUTE = ", d AS (SELECT event_id, p_benign AS conf, cast(eid % 97 AS double) / 97 AS maxsim, " + SOURCE + " <> 'Crowdstrike/Falcon' AS known_source FROM pr)"


def _docs(spark, sf):
    df = with_probabilities(ev(spark, sf))
    return df.select("event_id", F.col("p_benign").alias("conf"), ((F.col("eid") % 97).cast("double") / 97).alias("maxsim"), (F.col("source") != "Crowdstrike/Falcon").alias("known_source"), F.lit(True).alias("known_pair"))


@query("o1_route_within_budget", PR + _ROUTE + ", f AS (SELECT *, NOT known_source OR maxsim < 0.2 OR conf < 0.3 AS fired FROM d) SELECT event_id, fired AND event_id IN (SELECT event_id FROM f WHERE fired ORDER BY known_source, maxsim, conf, event_id LIMIT 300) AS routed FROM f")
def _(spark, sf):
    docs = _docs(spark, sf)
    t = route.triggers(0.3, 0.2)
    return route.route(docs, t["unseen_source"] | t["novel"] | t["doubtful"], 300, "event_id").select("event_id", "routed")


@query("o2_budget_positions", PR + _ROUTE + " SELECT event_id, row_number() OVER (ORDER BY known_source, conf, maxsim, event_id) - 1 AS position FROM d WHERE conf < 0.3 ORDER BY position LIMIT 100")
def _(spark, sf):
    return route.budget_positions(_docs(spark, sf), F.col("conf") < 0.3, 100, "event_id", "confidence").select("event_id", F.col("position").cast("long").alias("position"))


@query("o3_least_sure", PR + _ROUTE + ", a AS (SELECT event_id FROM d ORDER BY conf, event_id LIMIT 50), b AS (SELECT event_id FROM d ORDER BY maxsim, event_id LIMIT 50) SELECT event_id FROM a UNION SELECT event_id FROM b")
def _(spark, sf):
    docs = _docs(spark, sf)
    return docs.orderBy("conf", "event_id").limit(50).select("event_id").union(docs.orderBy("maxsim", "event_id").limit(50).select("event_id")).dropDuplicates()


@query("o5_best_rows", EV + ", c AS (SELECT pipeline, src_port, round(avg(CASE WHEN label_binary = 'benign' THEN 0.0 ELSE 1.0 END), 6) AS regret FROM ev WHERE src_port IS NOT NULL GROUP BY ALL) SELECT pipeline, min_by(src_port, (regret, src_port)) AS src_port, min(regret) AS regret FROM c GROUP BY pipeline")
def _(spark, sf):
    c = ev(spark, sf).where("src_port is not null").groupBy("pipeline", "src_port").agg(F.round(F.avg((F.col("label") != "benign").cast("double")), 6).alias("regret"))
    return c.groupBy("pipeline").agg(F.min_by("src_port", F.struct("regret", "src_port")).alias("src_port"), F.min("regret").alias("regret"))


@query("u1_union_of_parts", EV + "SELECT 'third' AS part, event_id FROM ev WHERE eid % 3 = 0 UNION ALL SELECT 'odd', event_id FROM ev WHERE eid % 2 = 1")
def _(spark, sf):
    df = ev(spark, sf)
    return df.where("eid % 3 = 0").select(F.lit("third").alias("part"), "event_id").unionByName(df.where("eid % 2 = 1").select("event_id", F.lit("odd").alias("part")))


@query("u2_id_differences", EV + "SELECT 'missing' AS kind, event_id FROM ev WHERE eid % 3 = 0 AND eid % 2 <> 0 UNION ALL SELECT 'extra', event_id FROM ev WHERE eid % 2 = 0 AND eid % 3 <> 0")
def _(spark, sf):
    df = ev(spark, sf)
    a, b = df.where("eid % 3 = 0").select("event_id"), df.where("eid % 2 = 0").select("event_id")
    return a.join(b, "event_id", "left_anti").select(F.lit("missing").alias("kind"), "event_id").union(b.join(a, "event_id", "left_anti").select(F.lit("extra").alias("kind"), "event_id"))


@query("u3_deduplicate_first_last", EV + "SELECT message_sanitized AS doc, min(eid) AS first_id, max(eid) AS last_id FROM ev GROUP BY ALL")
def _(spark, sf):
    df = ev(spark, sf).select(F.col("message_sanitized").alias("doc"), "eid")
    once = lambda order, name: df.withColumn("rn", F.row_number().over(Window.partitionBy("doc").orderBy(order))).where("rn = 1").select("doc", F.col("eid").alias(name))
    return once(F.col("eid"), "first_id").join(once(F.desc("eid"), "last_id"), "doc")
