"""Scoring and counting of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlog.functions import text
from siftlog.operators import decide, documents
from siftlog.schema import with_probabilities


def read_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def scored(events: DataFrame, miss: float = 10.0) -> DataFrame:
    """Stateless: verdict, source and decision of each event, on a stream as on a table."""
    rows = with_probabilities(events)
    return rows.select("event_id", documents.source_key(rows).alias("source"), text.firewall_verdict(F.col("message_sanitized")).alias("verdict"), decide.min_cost(decide.probabilities(), miss).alias("pred_label"))


def verdict_counts(events: DataFrame, time: str = "at", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Verdicts of each source in tumbling windows. On a stream written by ``write_counts``, events are left out whose
    window had closed when the batch before began, ``late`` after the newest event seen by then, and a window's state is
    dropped when it closes."""
    rows = events.withWatermark(time, late)
    verdict = text.firewall_verdict(F.col("message_sanitized"))
    return rows.groupBy(F.window(time, window).alias("w"), documents.source_key(rows).alias("source"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "source", "verdict", "n")


COUNTS = "start timestamp, source string, verdict string, n long, at string"


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append mode: a window is written when the watermark passes its end, once and with all its counts, and leaves the
    state. Each window is a partition that its batch overwrites, so a batch that is repeated, or a stream that starts
    again from nothing, puts the same windows in their places. Windows that are still open aren't written."""

    def write(batch: DataFrame, n: int) -> None:
        named = batch.withColumn("at", F.date_format("start", "yyyy-MM-dd'T'HH-mm-ss"))
        named.repartition("at").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("at").parquet(path)

    return counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(path).drop("at")


def write_running_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update mode: each batch writes the counts that it changed, of open windows, too, to a folder of its own, so a
    repeated batch replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def read_running_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of each window, source and verdict."""
    rows = spark.read.schema("start timestamp, source string, verdict string, n long, batch long").parquet(path)
    return rows.groupBy("start", "source", "verdict").agg(F.max_by("n", "batch").alias("n"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
