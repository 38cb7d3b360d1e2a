"""Keeping a saved index up to date from a stream of documents, and windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import markdown, tree


def stream_index(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Index a stream of documents (doc_name, content, version) into Parquet at `path`, one folder for each micro-batch.

    A batch that is run again overwrites its own folder and nothing else, so that a restart leaves no doubles; older
    versions of a document stay until `current` leaves them out, and no batch reads or rewrites what others wrote."""

    def write(batch: DataFrame, number: int) -> None:
        newest = Window.partitionBy("doc_name").orderBy(F.desc("version"), "content")
        latest = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        nodes = tree.nodes(markdown.sections(latest)).join(latest.select("doc_name", "version"), "doc_name")
        nodes.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark, path: str) -> DataFrame:
    """The nodes of the newest version of each document: greatest version, and of equal ones the latest batch."""
    every = spark.read.parquet(path)
    newest = every.groupBy("doc_name").agg(F.max(F.struct("version", "batch")).alias("_at"))
    return every.join(newest, "doc_name").where((F.col("version") == F.col("_at.version")) & (F.col("batch") == F.col("_at.batch"))).drop("_at", "batch")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Number of events and sum of values by tumbling window and type. On a stream, windows are given out once the
    watermark has passed them; events later than that are dropped by the watermark's contract."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
