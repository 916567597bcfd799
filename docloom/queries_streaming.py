"""Registered streaming queries: a stream over the events table, run until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.queries_ops import SQL as OPS_SQL
from docloom.sources.tables import KeyedTable
from docloom.storage import shared_folder
from docloom.streaming import state


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table, one file or a folder of files, as a stream; the tables beside it are not looked at."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf}/{name}.parquet")
    return reader.parquet(f"{sf}/{{{name}.parquet}}")  # a stream's own path has to be a folder or a pattern


def _all(stream: DataFrame, label: str) -> DataFrame:
    """What the stream yields, written to the shared folder as an append-only table."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_monitor(spark, sf):
    out = _all(state.monitor(_stream(spark, sf, "events"), "user_id", "event_type", "ts", "event_id"), "monitor")
    return out.select("event_id", "user_id", "body_sha256", "previous_sha256", "changed")


def stream_rate_limit(spark, sf):
    out = _all(state.rate_limit(_stream(spark, sf, "events"), "user_id", "ts", "event_id", rate=0.0005, burst=2), "limit")
    return out.select("user_id", "event_id", F.round("wait_seconds", 3).alias("wait_seconds"), "admitted")


def stream_metadata_latest(spark, sf):
    base = f"{shared_folder(spark)}/metadata-{uuid.uuid4().hex}"
    rows = _stream(spark, sf, "events").select(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), "ts", "event_id")
    table = KeyedTable(spark, f"{base}/table", ["namespace", "key"], ["ts", "event_id"])
    state.keep_last(rows, table, f"{base}/state").awaitTermination()
    return table.read().select("namespace", "key", "payload", "event_id")


def stream_event_counts(spark, sf):
    """Events and their value per hour and type, with late rows up to a day accepted."""
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    grouped = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    spark = grouped.sparkSession
    base = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    table = KeyedTable(spark, f"{base}/table", ["hour", "event_type"], ["n"])
    rows = grouped.select(F.col("w.start").alias("hour"), "event_type", "n")
    query = rows.writeStream.outputMode("update").foreachBatch(lambda df, n: table.merge(df)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read().select("hour", "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_monitor, stream_rate_limit, stream_metadata_latest, stream_event_counts)}
SQL = {
    "stream_monitor": OPS_SQL["monitor_changes"],
    "stream_rate_limit": OPS_SQL["rate_limit"],
    "stream_metadata_latest": OPS_SQL["metadata_latest"],
    "stream_event_counts": "select date_trunc('hour', ts)::timestamptz as hour, event_type, count(*) as n from events group by 1, 2",
}
