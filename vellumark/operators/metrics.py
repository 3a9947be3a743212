"""How well paragraphs keep a document's structure."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.functions.text import is_separator
from vellumark.operators.rows import each_row


def token_recall(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_kept, n_out: words of the documents, those found again as a multiset, and words put out.

    Pieces and texts meet by document, and words are counted inside the row: no word is shuffled by itself.
    """

    def run(texts: list[str], pieces: list[str]) -> tuple[int, int, int]:
        a, b = (Counter(w for t in side if t is not None for w in re.findall(r"\w+", t)) for side in (texts, pieces))
        return a.total(), (a & b).total(), b.total()

    both = docs.select("doc_id", F.lit(0).alias("side"), F.col("text").alias("t")).unionByName(paragraphs.select("doc_id", F.lit(1).alias("side"), F.col("content").alias("t")))
    held = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("t")))
    gathered = both.groupBy("doc_id").agg(held(0).alias("texts"), held(1).alias("pieces"))
    return gathered.select("doc_id", each_row(run, "n_tokens long, n_kept long, n_out long", F.col("texts"), F.col("pieces")).alias("r")).select("doc_id", "r.*").filter("n_tokens + n_out > 0")


def piece_stats(pieces: DataFrame) -> DataFrame:
    """doc_id, n, total, least, most characters of pieces."""
    size = F.length("content")
    return pieces.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.min(size).alias("least"), F.max(size).alias("most"))


def broken_structure(pieces: DataFrame) -> DataFrame:
    """doc_id, broken_fences, orphan_rows: pieces with an odd number of fences, and those that begin amid a table."""
    lines = F.split("content", "\n")
    fences = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("```")))
    orphan = F.ltrim(F.get(lines, F.lit(0))).startswith("|") & ~F.coalesce(is_separator(F.get(lines, F.lit(1))), F.lit(False))
    return pieces.groupBy("doc_id").agg(F.count_if(fences % 2 == 1).alias("broken_fences"), F.count_if(orphan).alias("orphan_rows"))
