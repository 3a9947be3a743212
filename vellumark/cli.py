"""Command line: slice, chunk, batch, media, detect, formats. Exit codes: 0 done, 1 some document failed, 2 wrong use."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.functions.text import image_sources
from vellumark.operators import split
from vellumark.options import SliceOptions
from vellumark.sources import dispatch, files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vellumark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("slice", "chunk", "batch", "media"):
        command = commands.add_parser(name)
        command.add_argument("path")
        command.add_argument("-o", "--out")
        command.add_argument("--format", choices=("json", "text", "md", "parquet"), default="json")
        command.add_argument("--limit", type=int, default=4096)
        command.add_argument("--overlap", type=int, default=0)
        command.add_argument("--glob")
        if name == "chunk":
            command.add_argument("--size", type=int, default=256)
            command.add_argument("--carry-title", action="store_true")
    detect = commands.add_parser("detect")
    detect.add_argument("names", nargs="+")
    commands.add_parser("formats")
    return parser


def _write(rows: DataFrame, out: str | None, kind: str) -> None:
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), "content", F.lit("\n")) if kind == "md" else F.col("content")
    if out is None:
        shown = rows.select(F.to_json(F.struct(*rows.columns)).alias("value") if kind in ("json", "parquet") else text.alias("value"))
        for row in shown.toLocalIterator():
            print(row["value"])
    elif kind in ("json", "parquet"):
        getattr(rows.write.mode("overwrite"), kind)(out)
    else:
        rows.select(text.alias("value")).write.mode("overwrite").text(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        given = _parser().parse_args(argv)
    except SystemExit as error:
        return 2 if error.code else 0
    if given.command == "detect":
        found = [dispatch.reader_of(n) for n in given.names]
        for name, reader in zip(given.names, found, strict=True):
            print(f"{name}\t{reader or 'unsupported'}")
        return int(None in found)
    if given.command == "formats":
        for reader, endings in dispatch.READERS.items():
            print(f"{reader}\t{' '.join(endings)}")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    documents = files.read_documents(spark, given.path, given.glob)
    if given.command == "media":
        rows = documents.select("name", F.explode(image_sources(F.decode("content", "UTF-8"))).alias("content")).withColumn("title", F.lit(""))
        _write(rows, given.out, given.format)
        return 0
    outcomes = files.slice_many(documents.select("path", "name", "content"), SliceOptions(limit=given.limit, overlap=given.overlap))
    outcomes = outcomes.persist()
    try:
        if given.command == "batch":
            report = files.batch_report(outcomes, order="path").withColumn("content", F.col("n").cast("string")).withColumn("title", F.lit(""))
            _write(report, given.out, given.format)
        else:
            rows = outcomes.select("name", F.posexplode("paragraphs").alias("para_idx", "p")).select("name", "para_idx", "p.title", "p.content")
            if given.command == "chunk":
                chunks = split.chunk_paragraphs(rows.withColumnRenamed("name", "doc_id"), given.size, given.overlap, given.carry_title)
                rows = chunks.withColumnRenamed("doc_id", "name")
            _write(rows, given.out, given.format)
        return int(not outcomes.filter(~F.col("ok")).isEmpty())
    finally:
        outcomes.unpersist()


if __name__ == "__main__":
    sys.exit(main())
