"""Names, labels and types of the event table, and the adapter that derives one from a generic event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("benign", "suspicious", "malicious")
#: Columns that may hold the label, in order of preference.
LABEL_CANDIDATES = ("label_binary", "label", "target", "class")
CATEGORICALS = ("pipeline", "product_name", "vendor_name", "src_host", "dst_host", "username")
CONTENT_CATEGORICALS = ("pipeline", "product_name", "vendor_name")
IDENTIFIERS = ("src_ip", "dst_ip", "src_host", "dst_host", "username")

#: Expressions that both Spark and other SQL engines read alike; EPOCH is the one that differs.
ADAPTER = {
    "eid": "event_id",
    "event_id": "cast(event_id AS string)",
    "timestamp": "{EPOCH}",
    "pipeline": "CASE event_type WHEN 'error' THEN 'syslog' WHEN 'view' THEN 'aws_cloudtrail' WHEN 'click' THEN 'network_flows' ELSE 'windows_ad' END",
    "src_ip": "concat('10.', user_id % 256, '.', event_id % 200, '.', 1 + event_id % 250)",
    "dst_ip": "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN '100.64.1.2' WHEN event_id % 11 = 0 THEN 'fe80::1' WHEN event_id % 13 = 0 THEN 'host-x' ELSE concat('52.1.', user_id % 256, '.7') END",
    "src_port": "CASE event_id % 7 WHEN 0 THEN '443' WHEN 1 THEN '8080.0' WHEN 2 THEN '55000' WHEN 3 THEN '' WHEN 4 THEN 'abc' WHEN 5 THEN '70000' ELSE NULL END",
    "src_host": "concat('HOST-', user_id)",
    "dst_host": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('HOST-', 500 + user_id % 17) END",
    "username": "CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('USER-', user_id) END",
    "message_sanitized": "CASE event_id % 9 WHEN 0 THEN concat('<180>Jul 26 USER-9564 22:45:31: Deny tcp src outside:10.1.2.3/', 1000 + event_id % 60000) WHEN 1 THEN 'decision=blocked accepted' WHEN 2 THEN 'flow ACCEPT OK' WHEN 3 THEN concat('CEF:0|WAF|act=DENY id=', event_id) WHEN 4 THEN 'X-XSS-Protection: 1; mode=block' WHEN 5 THEN concat('fqdn=HOST-', user_id, ' ::: HOST-0121=BLOCKED') WHEN 6 THEN '' ELSE concat(event_type, ' user=USER-', user_id, ' props=', props) END",
    "product_name": "CASE WHEN event_id % 10 < 3 THEN '' WHEN event_id % 10 < 6 THEN 'ASA Firewall' WHEN event_id % 10 < 9 THEN 'AWS VPC Security' ELSE 'Falcon' END",
    "vendor_name": "CASE WHEN event_id % 10 < 2 THEN NULL WHEN event_id % 10 = 2 THEN ' ' WHEN event_id % 10 < 6 THEN 'Cisco' WHEN event_id % 10 < 9 THEN 'Amazon Web Services' ELSE 'Crowdstrike' END",
    "label_binary": "CASE WHEN event_id % 9 IN (0,1,3,5) AND event_id % 10 < 3 AND event_id % 97 <> 0 THEN 'malicious' WHEN event_id % 9 IN (0,1,3,5) AND event_id % 89 <> 0 THEN 'suspicious' ELSE 'benign' END",
}
#: Probabilities for decisions without a model: each alert class at most 0.5, sum 1.
P_SUSPICIOUS = "cast((eid * 37) % 101 as double) / 202"
P_MALICIOUS = "cast((eid * 53) % 97 as double) / 194"

_SPARK_EPOCH = "unix_micros(cast(ts as timestamp)) / 1000000.0D"
_DUCK_EPOCH = "epoch_us(ts) / 1000000.0"

#: The same tables as common table expressions, for checks in another engine.
EVENTS_SQL = "ev AS (SELECT " + ", ".join(f"{e.format(EPOCH=_DUCK_EPOCH)} AS {n}" for n, e in ADAPTER.items()) + " FROM events)"
PROBS_SQL = f"pr AS (SELECT *, 1 - p_suspicious - p_malicious AS p_benign FROM (SELECT *, {P_SUSPICIOUS} AS p_suspicious, {P_MALICIOUS} AS p_malicious FROM ev))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as security log records, by projections alone, so that filters and pruning reach the scan."""
    return read(spark, sf_dir, "events").selectExpr(*[f"{e.format(EPOCH=_SPARK_EPOCH)} AS {n}" for n, e in ADAPTER.items()])


def with_probabilities(events: DataFrame) -> DataFrame:
    return events.withColumns({"p_suspicious": F.expr(P_SUSPICIOUS), "p_malicious": F.expr(P_MALICIOUS)}).withColumn("p_benign", 1 - F.col("p_suspicious") - F.col("p_malicious"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc, source and label, from documents and their quality and toxicity marks."""
    label = F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "suspicious").otherwise("benign")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc"), "source")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "doc", "source", label.alias("label"))


LABELLED_SQL = "ld AS (SELECT d.doc_id, d.text AS doc, d.source, CASE WHEN l.toxic = 1 THEN 'malicious' WHEN l.quality = 0 THEN 'suspicious' ELSE 'benign' END AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def text_or_empty(df: DataFrame, name: str) -> Column:
    """A column as text, null as empty; a missing column reads as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in df.columns else F.lit("")


def code(label: Column) -> Column:
    """0, 1, 2 in the order of LABELS."""
    return F.array_position(F.array(*map(F.lit, LABELS)), label).cast("int") - 1
