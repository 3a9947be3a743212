"""A corpus pipeline over `documents`: quality rules, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.llm import linededup, mixing, neardup, packing, rules
from vellumark.llm.queries import TARGETS
from vellumark.llm.shared import cut, delete, discard, shared_folder, table, tidy


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio against labelled good text."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = rules.apply_rules(docs, trusted)
    return judged.filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller id holds already; n_chars follows the text."""
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates by runs of five words: that of the smallest id, rows without an id last; rows without words all stay.

    Rows are judged by their id and text together: a null id is no reason to go, and of one id on different texts each
    stands for itself. Of rows equal in both one stays.
    """
    row = F.xxhash64("doc_id", "text")
    worded = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    with tidy(spark):
        judged = docs.filter(worded).select(row.alias("doc_id"), "text")
        found = neardup.near_duplicates(judged).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group")).distinct()
        ids = docs.filter(worded).select(row.alias("_row"), F.col("doc_id").alias("id")).groupBy("_row").agg(F.first("id").alias("id"), F.count("*").alias("times"))
        members = cut(found.join(ids, "_row"))
        firsts = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row")).alias("first"))
        gone = cut(members.join(firsts, "group").filter("_row != first._row").select(F.col("_row").alias("_gone")))
        repeated = not members.filter("times > 1").isEmpty()
        discard(members)
    # Few rows go, so this side is small, and texts are shuffled only where it is too large to be sent out.
    out = docs.filter(worded).join(gone, row == F.col("_gone"), "left_anti")
    if repeated:
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.filter(~worded)).select(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, at most once."""
    mixed = mixing.mix_documents(docs, mixing.domains_of_labels(table(spark, sf_dir, "labels")), TARGETS)
    return mixed.filter("copies >= 1").select(*docs.columns)


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_dedup),
    ("mixing", mixing_weights),
    ("packing", packing_windows),
]

#: The rules, the classifier and the tokenizer are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder of spark.checkpoint.dir and read again.

    What a stage has read is deleted when the next is written; the input of the last stage stays, as its rows are lazy.
    """
    root = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{root}/{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if k:
                delete(spark, f"{root}/{k - 1}")
    return docs
