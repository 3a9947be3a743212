"""Passes over ordered paragraphs: windows where the frame is plain, Arrow folds where a row needs the one before as changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.functions.text import is_separator
from vellumark.operators import kernels
from vellumark.operators.rows import each_row
from vellumark.options import SliceOptions


def carry_table_headers(paragraphs: DataFrame) -> DataFrame:
    """Put the last table header before a paragraph that goes on with a table cut before it.

    (doc_id, para_idx, content) in and out. The header a paragraph leaves behind doesn't depend on what is put before
    it, so last(ignore nulls) and lag over the document's rows are exact.
    """
    lines = F.split("content", "\n")
    pairs = F.zip_with(lines, F.slice(lines, 2, 2**30), lambda a, b: F.when(F.ltrim(a).startswith("|") & is_separator(b), F.concat(a, F.lit("\n"), b)))
    header = F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), F.filter(pairs, lambda h: h.isNotNull())), lambda h: F.lit(True)), -1)
    filled = F.filter(lines, lambda x: F.btrim(x) != "")
    rows = paragraphs.withColumn("_header", header).withColumn("_in_table", F.coalesce(F.ltrim(F.try_element_at(filled, F.lit(-1))).startswith("|"), F.lit(False)))
    order = Window.partitionBy("doc_id").orderBy("para_idx")
    carried = F.last("_header", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = F.lag("_in_table").over(order) & F.ltrim(F.get(lines, F.lit(0))).startswith("|") & ~F.coalesce(is_separator(F.get(lines, F.lit(1))), F.lit(False))
    rows = rows.withColumn("_carried", carried).withColumn("_goes_on", F.coalesce(goes_on, F.lit(False)))
    return rows.withColumn("content", F.when(F.col("_goes_on") & F.col("_carried").isNotNull(), F.concat("_carried", F.lit("\n"), "content")).otherwise(F.col("content"))).drop("_header", "_in_table", "_carried", "_goes_on")


def overlap_paragraphs(paragraphs: DataFrame, options: SliceOptions) -> DataFrame:
    """(doc_id, para_idx, title, content) with each content led by the end of the extended one before it."""
    options = options.resolved()

    def run(rows: list[dict]) -> list[tuple[int, str, str]]:
        done = kernels.overlap_rows([(r["title"] or "", r["content"] or "") for r in rows], options)
        return [(r["para_idx"], t, c) for r, (t, c) in zip(rows, done, strict=True)]

    grouped = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("para_idx").cast("int").alias("para_idx"), "title", "content"))).alias("rows"))
    return grouped.select("doc_id", F.explode(each_row(run, "array<struct<para_idx:int,title:string,content:string>>", F.col("rows"))).alias("p")).select("doc_id", "p.para_idx", "p.title", "p.content")


def drop_repeats(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    return rows.withColumn("_keep", first | ~before.eqNullSafe(F.col(value))).filter("_keep").drop("_keep")


def ancestor_titles(entries: DataFrame, key: str = "doc_id", order: str = "entry", levels: int = 6) -> DataFrame:
    """Add `chain`: the titles of the open ancestors of each table-of-contents entry (level, title), and its own.

    A title of level k is open until an entry of level k or less; so of the last title of each level those count that
    come after the last entry of every shallower level.
    """
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = entries
    for k in range(1, levels + 1):
        out = out.withColumn(f"_at{k}", F.max(F.when(F.col("level") == k, F.col(order))).over(frame)).withColumn(f"_t{k}", F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(frame))

    def is_open(k: int) -> Column:
        shallower = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"_at{j}", F.lit(-1)) for j in range(1, k)])
        return (F.col("level") >= k) & (F.col(f"_at{k}") > shallower)

    chain = F.concat_ws(" ", *[F.when(is_open(k), F.col(f"_t{k}")) for k in range(1, levels + 1)])
    return out.withColumn("chain", chain).drop(*[f"_{c}{k}" for k in range(1, levels + 1) for c in ("at", "t")])


def page_owners(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """The entry that owns each page: the last one that starts on it or before, as (doc_id, page, entry)."""
    starts = entries.select("doc_id", F.col("page").alias("_page"), "entry")
    both = pages.select("doc_id", F.col("page").alias("_page"), F.lit(None).cast("int").alias("entry")).unionByName(starts.withColumn("entry", F.col("entry").cast("int")))
    # Starts come before pages of the same number; the running last entry is the owner.
    order = Window.partitionBy("doc_id").orderBy("_page", F.col("entry").isNull(), "entry").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("owner", F.last("entry", ignorenulls=True).over(order)).filter("entry is null").select("doc_id", F.col("_page").alias("page"), F.col("owner").alias("entry"))


def font_levels(runs: DataFrame) -> DataFrame:
    """Add `level` to (doc_id, run_idx, size, text): 2 for runs over the body size by more than two, 3 by over half a point, 0.

    The body size is the commonest; of equally common ones that which comes first.
    """
    sizes = runs.groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min("run_idx").alias("first"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    over = F.col("size") - F.col("body")
    return runs.join(body, "doc_id").withColumn("level", F.when(over > 2, 2).when(over > 0.5, 3).otherwise(0))
