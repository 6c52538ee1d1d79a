"""Scans and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlog.operators.requests import REPLY
from siftlog.schema import LABEL_CANDIDATES, LABELS


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A scan of the named columns only; a missing path raises Spark's own error, which names it."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def tolerant(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as text; null and missing ones are empty."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def label_column(df: DataFrame) -> str:
    for name in LABEL_CANDIDATES:
        if name in df.columns:
            return name
    raise ValueError(f"no label column; one of {', '.join(LABEL_CANDIDATES)} is expected")


def unknown_labels(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNull() | ~F.col(label).isin(*LABELS)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def check_labels(df: DataFrame, label: str) -> None:
    bad = [str(r[label]) for r in unknown_labels(df, label).orderBy(label).limit(5).collect()]
    if bad:
        raise ValueError(f"unknown labels: {', '.join(bad)}")


def capped(df: DataFrame, key: str, most: int | None) -> DataFrame:
    return df if most is None else df.orderBy(key).limit(most)


def write_predictions(df: DataFrame, path: str) -> None:
    """event_id and pred_label with a header, as one folder of files."""
    df.select("event_id", "pred_label").write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("event_id string, pred_label string").option("header", True).csv(path)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftlog-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written and read back: it is computed once, however often it is used, and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def derived(spark: SparkSession, path: str, make) -> DataFrame:
    """A derived table: made and written once, then read. Only a folder with the committer's mark counts as finished."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_replies(replies: DataFrame, path: str) -> None:
    replies.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """The newest reply of each key."""
    rows = spark.read.schema(REPLY + ", at timestamp").json(path)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), "text"))).where("_n = 1").drop("_n", "at")


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A small table as one file."""
    one = df.coalesce(1).write.mode("overwrite")
    one.json(path) if form == "json" else one.option("header", True).csv(path)
