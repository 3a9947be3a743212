"""Exact line deduplication over a corpus, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.llm.shared import SPACE, fresh, lower_ascii


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop lines that at least `min_docs` documents hold, except in the smallest `doc_id` holding them.

    All columns of `docs` stay, `text` is rewritten, and n_lines and n_dropped (long) are added; they take the place of
    columns with these names, and no other name can clash. Lines are cut at
    \\n; lines whose key has fewer than `min_chars` code points always stay. Lines travel as two 64-bit hashes, and
    documents per hash are counted with map-side sums, so a line that a third of the documents share costs one row a
    task; the join that marks lines is one that adaptive execution can split.

    Null or empty texts are one empty line and return as empty text. A row whose id is null is compared with none:
    it keeps its lines and counts for no line. Rows with one id are one document for counting; each row's lines are
    marked by its own text. Empty tables give empty tables.
    """
    docs = docs.drop("n_lines", "n_dropped")
    own = ("doc", "text", "pos", "line", "key", "h1", "h2", "first", "last", "one", "docs", "c1", "c2", "gone", "mine", "lines")
    doc, own_text, pos, line, key, h1, h2, least, most, one, n_docs, c1, c2, gone_at, mine, parts = fresh(docs.columns, *own)
    base = docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    lines = (
        base.filter(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias(doc), F.xxhash64(text).alias(own_text), F.posexplode(F.split(text, "\n")).alias(pos, line))
        .select(doc, own_text, pos, line_key(F.col(line)).alias(key))
        .filter(F.length(key) >= min_chars)
        .select(doc, own_text, pos, F.xxhash64(key).alias(h1), F.xxhash64(F.lit(7), key).alias(h2))
    )
    if min_docs <= 2:  # two documents hold it if the smallest and the largest id differ
        common = lines.groupBy(h1, h2).agg(F.min(doc).alias(least), F.max(doc).alias(most))
        common = common.filter((F.col(least) != F.col(most)) | F.lit(min_docs < 2))
    else:
        pairs = lines.groupBy(h1, h2, doc).agg(F.lit(1).alias(one))
        common = pairs.groupBy(h1, h2).agg(F.min(doc).alias(least), F.count(one).alias(n_docs))
        common = common.filter(F.col(n_docs) >= min_docs)
    common = common.select(F.col(h1).alias(c1), F.col(h2).alias(c2), least)
    # Joined on one hash, the other is compared: counts are dealt by both, so they are dealt anew here, and with two plain
    # exchanges below it adaptive execution splits the join where one line is very common.
    same = (F.col(h1) == F.col(c1)) & (F.col(h2).bitwiseXOR(F.col(c2)) == 0)
    marked = lines.join(common, same & (F.col(doc) != F.col(least)))
    gone = marked.groupBy(doc, own_text).agg(F.collect_set(pos).alias(gone_at))
    split = base.withColumn(mine, F.xxhash64(text)).join(gone, (F.col(doc_id) == F.col(doc)) & (F.col(mine) == F.col(own_text)), "left")
    split = split.withColumn(parts, F.split(text, "\n")).withColumn("n_lines", F.size(parts).cast("long"))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col(gone_at)))
    joined = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    return (
        split.withColumn("n_dropped", F.greatest(F.coalesce(F.size(gone_at), F.lit(0)), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col(gone_at).isNull(), F.col(text)).otherwise(joined))
        .select(*docs.columns, "n_lines", "n_dropped")
    )
