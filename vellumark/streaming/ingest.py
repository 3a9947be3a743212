"""Slicing of files as they arrive: the same stateless transforms over a stream, and dedupe across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumark.options import SliceOptions
from vellumark.sources.files import slice_many

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """name, content, modificationTime of files that appear below `path`."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content", "modificationTime")


def slice_stream(documents: DataFrame, options: SliceOptions, dedupe_within: str | None = None) -> DataFrame:
    """Paragraphs of a document stream: name, modificationTime, ok, error, para_idx, title, content.

    With `dedupe_within` a document whose bytes were seen within that time is left out; the state holds hashes no longer
    than the watermark.
    """
    if dedupe_within:
        documents = documents.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", dedupe_within).dropDuplicatesWithinWatermark(["sha256"]).drop("sha256")
    done = slice_many(documents, options)
    rows = done.select("name", "modificationTime", "ok", "error", F.posexplode_outer("paragraphs").alias("para_idx", "p"))
    return rows.select("name", "modificationTime", "ok", "error", "para_idx", "p.title", "p.content")


def write_paragraphs(paragraphs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = paragraphs.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
