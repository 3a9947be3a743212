"""Documents as DataFrames, and many of them sliced with one outcome each."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.errors import LimitExceeded, SliceError
from vellumark.operators.rows import each_row
from vellumark.options import ParserLimits, SliceOptions
from vellumark.sources import formats

OUTCOME = "ok boolean, error_type string, error_code int, error string, paragraphs array<struct<title:string,content:string>>"


def read_documents(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, name, content, length of the files below `path`."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content", "length")


def jobs(spark: SparkSession, inputs: list) -> DataFrame:
    """idx, name, content of (name, bytes) pairs, mappings, or objects with name and read()."""
    rows = []
    for idx, x in enumerate(inputs):
        if isinstance(x, (bytes, bytearray, str)):
            raise TypeError("a document needs a name: give (name, bytes); for paths use read_documents")
        name, content = (x["name"], x["content"]) if isinstance(x, dict) else (x.name, x.read()) if hasattr(x, "read") else x
        rows.append((idx, str(name), bytes(content)))
    return spark.createDataFrame(rows, "idx int, name string, content binary")


def outcome(name: Column, content: Column, options: SliceOptions, limits: ParserLimits | None = None, fallback: str | None = None, recognise: Callable[[bytes, str], str] | None = None) -> Column:
    """A struct for each document: its paragraphs, or what went wrong. It never raises, so one document cannot fail a job."""
    context = formats.Context(options.resolved(), limits or ParserLimits(), recognise=recognise)

    def run(n: str | None, c: bytes | None) -> tuple:
        try:
            return True, None, None, None, formats.slice_bytes(c or b"", n or "", context, fallback)
        except (SliceError, LimitExceeded) as error:
            return False, type(error).__name__, error.code, str(error), None
        except Exception as error:  # noqa: BLE001
            return False, type(error).__name__, 500, str(error), None

    return each_row(run, OUTCOME, name, content)


def slice_many(documents: DataFrame, options: SliceOptions, **settings) -> DataFrame:
    """`documents` (name, content, ...) with an outcome each: ok, error_type, error_code, error, paragraphs."""
    kept = [c for c in documents.columns if c != "content"]
    return documents.select(*kept, outcome(F.col("name"), F.col("content"), options, **settings).alias("_o")).select(*kept, "_o.*")


def batch_report(outcomes: DataFrame, order: str = "idx") -> DataFrame:
    """One row: n, n_ok, n_failed, n_paragraphs, first_failure (order), first_error."""
    return outcomes.agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.size("paragraphs"))), F.lit(0)).cast("long").alias("n_paragraphs"),
        F.min(F.when(~F.col("ok"), F.col(order))).alias("first_failure"),
        F.min_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.col(order))).alias("first_error"),
    )


def raise_first(outcomes: DataFrame, order: str = "idx") -> None:
    """Raise the error of the first document that failed, if any did."""
    rows = outcomes.filter(~F.col("ok")).orderBy(order).select("error", "error_code").take(1)
    if rows:
        raise SliceError(rows[0]["error"], rows[0]["error_code"])


def document_id(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()
