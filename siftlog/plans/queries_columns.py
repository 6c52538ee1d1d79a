"""Queries of scans and of scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.functions import net, text, time
from siftlog.operators import documents
from siftlog.plans import views_sql
from siftlog.plans.registry import SOURCE, VERDICT_SQL, query
from siftlog.schema import CATEGORICALS, EVENTS_SQL, security_events
from siftlog.sources import io

EV = f"WITH {EVENTS_SQL} "
VD = f"WITH {VERDICT_SQL} "


def _events(spark, sf, *columns):
    df = security_events(spark, sf)
    return df.select(*columns) if columns else df


@query("slice_verdict_by_vendor", VD + "SELECT vendor_state, verdict, label_binary AS label, count(*) AS n FROM vd GROUP BY ALL")
def _(spark, sf):
    ev = _events(spark, sf)
    state, verdict = documents.verdict_cell(ev)
    return ev.groupBy(state.alias("vendor_state"), verdict.alias("verdict"), F.col("label_binary").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("s1_parquet_projection", "SELECT event_id, user_id FROM events")
def _(spark, sf):
    return io.read_parquet(spark, f"{sf}/events.parquet", ["event_id", "user_id"])


@query("s2_tolerant_projection", "SELECT cast(event_id AS string) AS event_id, coalesce(event_type, '') AS event_type, '' AS not_there FROM events")
def _(spark, sf):
    return io.tolerant(io.read_parquet(spark, f"{sf}/events.parquet"), ["event_id", "event_type", "not_there"])


@query("s3_label_column", EV + "SELECT 'label_binary' AS label_column, label_binary AS label, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf):
    ev = _events(spark, sf)
    name = io.label_column(ev)
    return ev.groupBy(F.lit(name).alias("label_column"), F.col(name).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_unknown_labels", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NULL OR event_type NOT IN ('benign','suspicious','malicious') GROUP BY ALL")
def _(spark, sf):
    return io.unknown_labels(io.read_parquet(spark, f"{sf}/events.parquet"), "event_type")


@query("s5_capped_scan", EV + "SELECT event_id, label_binary FROM ev ORDER BY event_id LIMIT 500")
def _(spark, sf):
    return io.capped(_events(spark, sf, "event_id", "label_binary"), "event_id", 500)


def _scratch(spark) -> str:
    """A new folder that driver and executors share."""
    return io.scratch(spark)


@query("s6_prediction_csv_round_trip", EV + "SELECT event_id, label_binary AS pred_label FROM ev")
def _(spark, sf):
    path = _scratch(spark)
    io.write_predictions(_events(spark, sf, "event_id", F.col("label_binary").alias("pred_label")), path)
    return io.read_predictions(spark, path)


@query("s8_derived_table", VD + "SELECT event_id, verdict FROM vd")
def _(spark, sf):
    return io.derived(spark, _scratch(spark), lambda: _events(spark, sf).select("event_id", text.firewall_verdict(F.col("message_sanitized")).alias("verdict")))


@query("s9_reply_cache", "SELECT cast(conv_id AS string) AS key, max_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, sf):
    from siftlog.operators import requests

    rows = io.read_parquet(spark, f"{sf}/conversations.parquet").select(F.col("conv_id").cast("string").alias("key"), "turn", "text")
    path = _scratch(spark)
    rows.write.mode("append").json(path)
    return requests.newest(spark.read.schema("key string, turn long, text string").json(path), "turn").select("key", "text")


@query("s10_report_sink", EV + "SELECT label_binary AS label, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf):
    path = _scratch(spark)
    io.write_report(_events(spark, sf).groupBy(F.col("label_binary").alias("label")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("label string, n long").json(path)


_PORT = "try_cast(trim(coalesce(src_port, '')) AS double)"


@query(
    "p1_port_bucket",
    EV + f"SELECT event_id, CASE WHEN trim(coalesce(src_port,'')) = '' THEN 'missing' WHEN {_PORT} IS NULL THEN 'invalid' WHEN trunc({_PORT}) < 0 OR trunc({_PORT}) > 65535 THEN 'out_of_range' WHEN trunc({_PORT}) <= 1023 THEN 'well_known' WHEN trunc({_PORT}) <= 49151 THEN 'registered' ELSE 'ephemeral' END AS bucket FROM ev",
)
def _(spark, sf):
    return _events(spark, sf).select("event_id", net.port_bucket(F.col("src_port")).alias("bucket"))


@query("p2_port_class", EV + "SELECT event_id, CASE WHEN NOT regexp_full_match(trim(coalesce(src_port,'')), '[0-9]+') THEN 'none' WHEN cast(src_port AS bigint) < 1024 THEN 'wellknown' WHEN cast(src_port AS bigint) < 49152 THEN 'registered' ELSE 'ephemeral' END AS class FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", net.port_class(F.col("src_port")).alias("class"))


_V4 = "regexp_full_match(dst_ip, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}')"


@query("p3_ip_prefix", EV + f"SELECT event_id, CASE WHEN dst_ip = '' THEN 'missing' WHEN {_V4} THEN array_to_string(string_split(dst_ip, '.')[1:3], '.') ELSE 'non_ipv4' END AS prefix FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", net.ip_prefix(F.col("dst_ip")).alias("prefix"))


@query("p4_value_kind", EV + f"SELECT event_id, CASE WHEN dst_ip = '' THEN 'missing' WHEN {_V4} THEN 'ipv4' WHEN contains(dst_ip, '::') THEN 'ipv6' ELSE 'other' END AS kind FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", net.value_kind(F.col("dst_ip")).alias("kind"))


#: Addresses of all classes.
_MIXED = "concat(1 + eid % 254, '.', (eid * 7) % 256, '.', eid % 3, '.', (eid * 11) % 256)"


@query("p5_ip_kind", EV + f"SELECT event_id, {views_sql.ip_kind('dst_ip')} AS kind, {views_sql.ip_kind('src_ip')} AS src_kind, {views_sql.ip_kind(_MIXED)} AS mixed_kind FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", net.ip_kind(F.col("dst_ip")).alias("kind"), net.ip_kind(F.col("src_ip")).alias("src_kind"), net.ip_kind(F.expr(_MIXED)).alias("mixed_kind"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(CASE WHEN trim(coalesce(product_name,'')) = '' THEN 'missing' ELSE trim(product_name) END, '\\s+', '_', 'g'), '[^0-9A-Za-z_.:/=@+-]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("p6_clean_token", EV + f"SELECT event_id, {_CLEAN} AS token FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.clean_token(F.col("product_name")).alias("token"))


@query("p7_slug", EV + "SELECT event_id, CASE WHEN trim(coalesce(vendor_name,'')) = '' THEN 'none' ELSE regexp_replace(regexp_replace(lower(trim(vendor_name)), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') END AS token FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.slug(F.col("vendor_name")).alias("token"))


_TS = "(SELECT event_id, hour(ts) AS h, isodow(ts) - 1 AS d, month(ts) AS m FROM events)"


@query("p8_time_parts", "SELECT cast(event_id AS string) AS event_id, cast(hour(ts) AS int) AS timestamp_hour, cast(isodow(ts) - 1 AS int) AS timestamp_dayofweek, cast(month(ts) AS int) AS timestamp_month FROM events")
def _(spark, sf):
    return _events(spark, sf).select("event_id", *[v.alias(k) for k, v in time.time_parts(F.col("timestamp")).items()])


@query("p9_normalized_message", EV + f"SELECT event_id, {views_sql.normalized()} AS message FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.normalized(F.col("message_sanitized")).alias("message"))


@query("p10_timefree_message", EV + f"SELECT event_id, {views_sql.timefree()} AS message FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.timefree(F.col("message_sanitized")).alias("message"))


@query("p11_firewall_verdict", VD + "SELECT event_id, verdict FROM vd")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.firewall_verdict(F.col("message_sanitized")).alias("verdict"))


@query("p12_classifier_view", EV + f"SELECT event_id, {views_sql.classifier_view()} AS message FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.classifier_view(F.col("message_sanitized")).alias("message"))


@query("p13_reader_view", EV + f"SELECT event_id, {views_sql.reader_view()} AS message FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.reader_view(F.col("message_sanitized")).alias("message"))


@query("p14_probe_view", EV + f"SELECT event_id, {views_sql.probe_view()} AS message FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.probe_view(F.col("message_sanitized")).alias("message"))


@query("p15_version_free", EV + f"SELECT event_id, {views_sql.version_free('doc')} AS doc FROM ({views_sql.full_document(CATEGORICALS)})")
def _(spark, sf):
    ev = _events(spark, sf)
    return ev.select("event_id", text.version_free(documents.full_document(ev)).alias("doc"))


@query(
    "p16_full_document",
    EV
    + ", c AS (SELECT *, "
    + ", ".join(f"{_CLEAN.replace('product_name', c)} AS c_{c}" for c in ("pipeline", "product_name", "vendor_name", "src_host", "dst_host", "username"))
    + f", CASE WHEN trim(coalesce(src_port,'')) = '' THEN 'missing' WHEN {_PORT} IS NULL THEN 'invalid' WHEN trunc({_PORT}) > 65535 THEN 'out_of_range' WHEN trunc({_PORT}) <= 1023 THEN 'well_known' WHEN trunc({_PORT}) <= 49151 THEN 'registered' ELSE 'ephemeral' END AS port, CASE WHEN dst_ip = '' THEN 'missing' WHEN {_V4} THEN array_to_string(string_split(dst_ip, '.')[1:3], '.') ELSE 'non_ipv4' END AS dp, array_to_string(string_split(src_ip, '.')[1:3], '.') AS sp FROM ev), "
    + f"t AS {_TS} SELECT c.event_id, trim(regexp_replace('pipeline=' || c_pipeline || ' product_name=' || c_product_name || ' vendor_name=' || c_vendor_name || ' src_host=' || c_src_host || ' dst_host=' || c_dst_host || ' username=' || c_username || ' src_port_bucket=' || port || ' src_ip_prefix=' || sp || ' dst_ip_prefix=' || dp || ' timestamp_hour=' || h || ' timestamp_dayofweek=' || d || ' timestamp_month=' || m || ' ' || message_sanitized, '\\s+', ' ', 'g')) AS doc FROM c JOIN t ON t.event_id = c.eid",
)
def _(spark, sf):
    ev = _events(spark, sf)
    return ev.select("event_id", documents.full_document(ev).alias("doc"))


@query("p17_content_document", EV + views_sql.content_document())
def _(spark, sf):
    return documents.with_document(_events(spark, sf), "content").select("event_id", "doc")


@query("p18_timefree_document", VD + views_sql.timefree_document())
def _(spark, sf):
    return documents.with_document(_events(spark, sf), "timefree").select("event_id", "doc")


@query("p19_classifier_document", EV + views_sql.classifier_document())
def _(spark, sf):
    return documents.with_document(_events(spark, sf), "classifier").select("event_id", "doc")


@query(
    "p20_raw_document",
    EV
    + f", t AS {_TS} SELECT ev.event_id, 'thour_' || h || ' tdow_' || d || ' tmonth_' || m"
    + "".join(f" || ' f{c}_' || regexp_replace(coalesce({c}, ''), '\\s+', '_', 'g')" for c in documents.RAW_FIELDS)
    + " || ' | ' || message_sanitized AS doc FROM ev JOIN t ON t.event_id = ev.eid",
)
def _(spark, sf):
    ev = _events(spark, sf)
    return ev.select("event_id", documents.raw_document(ev).alias("doc"))


@query("p21_reduced_document", EV + views_sql.full_document(("pipeline",)))
def _(spark, sf):
    ev = _events(spark, sf)
    return ev.select("event_id", documents.full_document(ev, ("pipeline",)).alias("doc"))


@query("p22_source_key", EV + f"SELECT event_id, {SOURCE} AS source FROM ev")
def _(spark, sf):
    ev = _events(spark, sf)
    return ev.select("event_id", documents.source_key(ev).alias("source"))


@query("p23_verdict_cell", VD + "SELECT event_id, vendor_state, verdict FROM vd")
def _(spark, sf):
    ev = _events(spark, sf)
    state, verdict = documents.verdict_cell(ev)
    return ev.select("event_id", state.alias("vendor_state"), verdict.alias("verdict"))


@query("p24_per_distinct_value", VD + "SELECT event_id, verdict FROM vd")
def _(spark, sf):
    return documents.per_distinct(_events(spark, sf, "event_id", "message_sanitized"), "message_sanitized", text.firewall_verdict, "verdict").select("event_id", "verdict")


@query("p25_truncation", "SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) ELSE text END AS head, right(text, 100) AS tail FROM documents")
def _(spark, sf):
    docs = io.read_parquet(spark, f"{sf}/documents.parquet", ["doc_id", "text"])
    return docs.select("doc_id", F.when(F.length("text") > 600, F.substring("text", 1, 600)).otherwise(F.col("text")).alias("head"), F.right("text", F.lit(100)).alias("tail"))


@query("p26_counterfactual_message")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.perturbed(F.col("message_sanitized"), 1).alias("message"))


@query("p27_id_number", EV + "SELECT event_id, cast(regexp_extract(event_id, '([0-9]+)', 1) AS bigint) AS n FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", text.id_number(F.col("event_id")).alias("n"))


@query("p28_namespaces", EV + "SELECT event_id, unnest(list_distinct(regexp_extract_all(message_sanitized, '(?:USER|ORG|CRED|HOST)-[0-9]{4}'))) AS namespace FROM ev")
def _(spark, sf):
    return _events(spark, sf).select("event_id", F.explode(text.namespaces(F.col("message_sanitized"))).alias("namespace"))


@query("p29_triple_key", EV + "SELECT event_id, pipeline || '|' || coalesce(vendor_name, '') || '|' || product_name AS source FROM ev")
def _(spark, sf):
    ev = _events(spark, sf)
    return ev.select("event_id", documents.triple_key(ev).alias("source"))
