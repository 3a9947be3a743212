"""Operators that make many rows of one text: budget, heading tree, blank line and embedding chunks.

The two walks that depend on where the last cut fell run as Arrow functions over slices of batches; everything else is
expressions. All of them work document by document: no shuffle, and a filter or a column choice above passes through
to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumark.operators import kernels
from vellumark.operators.rows import each_row
from vellumark.options import DEFAULT_CHUNK, SliceOptions

PARAGRAPHS = "array<struct<title:string,content:string>>"


def split_pieces(text: Column, options: SliceOptions) -> Column:
    """array<string>: the pieces of kernels.budget_split; null for null."""
    options = options.resolved()

    return each_row(lambda t: None if t is None else kernels.budget_split(t, options), "array<string>", text)


def tree_paragraphs(text: Column, options: SliceOptions, fallback: Column | None = None) -> Column:
    """array<struct<title, content>>: the paragraphs of kernels.slice_text; null for null."""
    options = options.resolved()

    return each_row(lambda t, f: None if t is None else kernels.slice_text(t, options, f or ""), PARAGRAPHS, text, F.lit("") if fallback is None else fallback)


def explode_pieces(docs: DataFrame, pieces: Column) -> DataFrame:
    """doc_id, para_idx, content of an array of strings for each document."""
    return docs.select("doc_id", F.posexplode(pieces).alias("para_idx", "content"))


def budget_split(docs: DataFrame, options: SliceOptions) -> DataFrame:
    """docs (doc_id, text) to doc_id, para_idx, content."""
    return explode_pieces(docs, split_pieces(F.col("text"), options))


def slice_documents(docs: DataFrame, options: SliceOptions, fallback: Column | None = None) -> DataFrame:
    """docs (doc_id, text) to doc_id, para_idx, title, content along the heading tree."""
    rows = docs.select("doc_id", F.posexplode(tree_paragraphs(F.col("text"), options, fallback)).alias("para_idx", "p"))
    return rows.select("doc_id", "para_idx", "p.title", "p.content")


def blank_line_pieces(text: Column) -> Column:
    """The parts between runs of blank lines, stripped, without empty ones."""
    parts = F.transform(F.split(text, r"\n\n+"), lambda p: F.btrim(p, F.lit(" \t\n\r\x0b\x0c")))
    return F.filter(parts, lambda p: p != "")


def mark_pieces(text: Column, size: int = DEFAULT_CHUNK) -> Column:
    """kernels.mark_chunk as an expression: matches first, then the leftovers."""
    space = F.lit(" \t\n\r\x0b\x0c")
    pattern = rf"(?s).{{1,{size}}}[。| \\.！;；!\n]"
    matched = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.btrim(m, space))
    rest = F.transform(F.split(text, pattern), lambda p: F.btrim(p, space))
    cut = F.transform(rest, lambda p: F.when(F.length(p) < size, F.array(p)).otherwise(F.transform(F.regexp_extract_all(p, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)), lambda q: F.btrim(q, space))))
    return F.filter(F.concat(matched, F.flatten(cut)), lambda p: p != "")


def chunk_paragraphs(paragraphs: DataFrame, chunk_size: int = DEFAULT_CHUNK, chunk_overlap: int = 0, carry_title: bool = False) -> DataFrame:
    """Re-chunk (doc_id, para_idx, title, content) for embedding: adds chunk_idx, content is the chunk.

    Without overlap paragraphs are cut at marks, by expressions only; with overlap by the budget walk. carry_title puts
    the title before every chunk as a heading. Sizes below 50 count as 50.
    """
    size = max(50, chunk_size)
    if chunk_overlap > 0:
        options = SliceOptions(limit=size, overlap=chunk_overlap)
        pieces = F.filter(F.transform(split_pieces(F.col("content"), options), lambda p: F.btrim(p, F.lit(" \t\n\r\x0b\x0c"))), lambda p: p != "")
    else:
        pieces = mark_pieces(F.col("content"), size)
    rows = paragraphs.select("doc_id", "para_idx", "title", F.posexplode(pieces).alias("chunk_idx", "content"))
    if carry_title:
        rows = rows.withColumn("content", F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("# "), "title", F.lit("\n"), "content")).otherwise(F.col("content")))
    return rows


def line_pieces(text: Column, limit: int) -> Column:
    """array<string>: the pieces of kernels.line_split."""
    return each_row(lambda t: None if t is None else kernels.line_split(t, limit), "array<string>", text)


def chunk_with(paragraphs: DataFrame, handler: Callable[[list[str], int], list[str]], chunk_size: int = DEFAULT_CHUNK, carry_title: bool = False) -> DataFrame:
    """As chunk_paragraphs, with a chunker of the caller's own: handler([text], size) gives the chunks of one paragraph."""
    size = max(50, chunk_size)
    chunks = each_row(lambda t: [] if t is None else [c for c in handler([t], size) if c], "array<string>", F.col("content"))
    rows = paragraphs.select("doc_id", "para_idx", "title", F.posexplode(chunks).alias("chunk_idx", "content"))
    return rows.withColumn("content", F.concat(F.lit("# "), "title", F.lit("\n"), "content")) if carry_title else rows


def map_items(items: DataFrame, worker: Callable[[dict], str], set_up: Callable[[], None] | None = None) -> DataFrame:
    """Any function over rows, in parallel and each by itself: the columns of `items`, ok, value (string), error_type, error.

    The worker gets a row as a dictionary. A row it fails on has the error in place of a value and stops no other;
    set_up is called once in each task before the first row.
    """
    schema = StructType([*items.schema.fields]).add("ok", "boolean").add("value", "string").add("error_type", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if set_up is not None:
            set_up()
        for batch in batches:
            done: list[tuple] = []
            for row in batch.to_pylist():
                try:
                    done.append((True, worker(row), None, None))
                except Exception as error:  # noqa: BLE001
                    done.append((False, None, type(error).__name__, str(error)))
            columns = list(zip(*done, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(columns[0], pa.bool_()), *(pa.array(c, pa.string()) for c in columns[1:])], names=[*batch.schema.names, "ok", "value", "error_type", "error"])

    return items.mapInArrow(run, schema)
