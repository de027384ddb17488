"""A watched inbox as a file stream, and windowed counts of an event stream (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.sources.readers import ingest


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """New files of an inbox as documents with the MD5 of their bytes."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content")


def stage(spark: SparkSession, inbox: str, queue: str, checkpoint: str) -> StreamingQuery:
    """Stage new files into a queue table once each; contents that the queue holds already are left out."""
    def one(batch: DataFrame, _: int) -> None:
        hashed = batch.withColumn("content_hash", F.md5("content")).dropDuplicates(["content_hash"])
        try:
            known = spark.read.parquet(queue).select("content_hash").distinct()
            hashed = hashed.join(known, "content_hash", "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        read = ingest(hashed)
        read.join(hashed.select("path", "content_hash"), "path").withColumn("status", F.lit("pending")).write.mode("append").parquet(queue)

    return watch(spark, inbox).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows with a watermark; works on a stream and on a table."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    out = held.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
