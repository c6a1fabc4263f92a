"""Streams of documents: folders of files to node rows, and grouping of event streams by windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nodeloom.sources import xml


def read_documents(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (uri, xml) from the files of a folder; a micro-batch takes whole documents."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.col("path").alias("uri"), F.col("content").alias("xml"))


def shred_stream(docs: DataFrame) -> DataFrame:
    """Node rows of a stream of (uri, xml); doc_id is a hash of the uri."""
    return xml.shred(docs.withColumn("doc_id", F.xxhash64("uri")))


def write_nodes(nodes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the node rows to a Parquet folder, each file once."""
    return nodes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
