"""The library in a few calls: one text or document without Spark, tables of documents with it."""

from __future__ import annotations

import importlib.util
import os
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.operators import kernels, media
from vellumark.options import DEFAULT_CHUNK, ParserLimits, SliceOptions
from vellumark.sources import files, formats, media_scan
from vellumark.sources.dispatch import reader_of, supported_extensions

__all__ = [
    "assemble", "chunk", "detect_reader", "extract_media", "extract_text", "missing_dependencies", "partitions_for", "patterns_for", "slice_bytes", "slice_documents", "slice_multimodal", "slice_paths", "slice_text", "supported_extensions",
]

#: Packages that a reader needs beyond the standard library.
OPTIONAL = {"pdf": "pypdf", "xls": "xlrd", "ppt": "olefile", "msg": "extract_msg", "mobi": "mobi", "7z": "py7zr"}


def _context(options: SliceOptions, limits: ParserLimits | None) -> formats.Context:
    return formats.Context(options.resolved(), limits or ParserLimits.from_environment())


def slice_text(text: str, options: SliceOptions | None = None, name: str = "document.md") -> list[tuple[str, str]]:
    """(title, content) paragraphs of a text; titles fall back to `name`."""
    return kernels.slice_text(text, (options or SliceOptions()).resolved(), name)


def slice_bytes(content: bytes, name: str, options: SliceOptions | None = None, limits: ParserLimits | None = None, fallback_title: str | None = None) -> list[tuple[str, str]]:
    return formats.slice_bytes(content, name, _context(options or SliceOptions(), limits), fallback_title)


def extract_text(content: bytes, name: str, limits: ParserLimits | None = None) -> str:
    return formats.extract_text(content, name, _context(SliceOptions(), limits))


def extract_media(content: bytes, name: str, limits: ParserLimits | None = None) -> media_scan.Scan:
    return media_scan.scan_media(content, name, limits)


def chunk(text: str, size: int = DEFAULT_CHUNK, overlap: int = 0) -> list[str]:
    """Embedding chunks of one text: at marks, or by the budget walk where they overlap."""
    size = max(50, size)
    if not overlap:
        return kernels.mark_chunk(text, size)
    return [p.strip() for p in kernels.budget_split(text, SliceOptions(limit=size, overlap=overlap).resolved()) if p.strip()]


def detect_reader(name: str) -> str | None:
    return reader_of(name)


def missing_dependencies() -> dict[str, str]:
    """Readers whose package is not installed."""
    return {reader: package for reader, package in OPTIONAL.items() if importlib.util.find_spec(package) is None}


def patterns_for(name: str) -> tuple[str, ...]:
    """Heading patterns of a name: none for source files, markdown's otherwise."""
    return () if reader_of(name) == "literal" else kernels.MARKDOWN


def partitions_for(spark: SparkSession, policy: str | int = "auto") -> int:
    """How many documents at once: a number, `cores`, a multiple of them such as `2x`, or auto (all slots of the cluster)."""
    slots = spark.sparkContext.defaultParallelism
    if isinstance(policy, int):
        return max(1, policy)
    policy = os.environ.get("VELLUMARK_CONCURRENCY", policy) if policy == "auto" else policy
    if policy in ("auto", "cores"):
        return slots
    if policy == "serial":
        return 1
    if found := re.fullmatch(r"(\d+(?:\.\d+)?)x", policy):
        return max(1, int(float(found[1]) * slots))
    return max(1, int(policy))


def slice_paths(spark: SparkSession, path: str, options: SliceOptions | None = None, **settings) -> DataFrame:
    """Outcomes of all files below a path."""
    return files.slice_many(files.read_documents(spark, path).select("path", "name", "content"), options or SliceOptions(), **settings)


def slice_documents(outcomes: DataFrame, key: str = "name") -> DataFrame:
    """Paragraphs of the documents that did not fail: doc_id, para_idx, title, content."""
    rows = outcomes.select(F.col(key).alias("doc_id"), F.posexplode("paragraphs").alias("para_idx", "p"))
    return rows.select("doc_id", "para_idx", "p.title", "p.content")


def slice_multimodal(documents: DataFrame, options: SliceOptions | None = None, min_side: int = 20, max_images: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents (doc_id, name, content) to paragraphs, kept assets, and which asset goes to which paragraph.

    Assets are the images of each document, large enough, one for each content; attachments name kept ids.
    """
    paragraphs = slice_documents(files.slice_many(documents, replace(options or SliceOptions())), "doc_id")
    found = media.describe(media_scan.extract_assets(documents))
    found = found.withColumn("_why", media.keep_reasons(min_side)).filter("_why is null").drop("_why").dropDuplicates(["doc_id", "id"])
    attached = media.attach(paragraphs, found)
    # An id is the hash of the bytes, so pictures that several documents share are one asset already.
    kept = found.groupBy("id").agg(F.min_by(F.struct("content", "file_name", "mime", "sha256", "width", "height"), F.struct("doc_id", "idx")).alias("a")).select("id", "a.*")
    if max_images is not None:
        kept = kept.orderBy("id").limit(max_images)
        attached = attached.join(kept.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    return paragraphs, kept, attached


def assemble(paragraphs: DataFrame, attached: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, para_idx, title, content, images: each paragraph with the assets attached to it, best match first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("reference", "heading", "anchor", "document")]), F.col("match"))
    images = attached.filter("para_idx is not null").join(kept.select(F.col("id").alias("asset_id"), "file_name", "mime", "width", "height"), "asset_id")
    gathered = images.groupBy("doc_id", "para_idx").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "asset_id", "match", "file_name", "mime", "width", "height"))).alias("images"))
    return paragraphs.join(gathered, ["doc_id", "para_idx"], "left")
