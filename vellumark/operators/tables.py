"""Tables, question/answer sheets and rows packed to paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.functions.text import escape_cell, table_row
from vellumark.operators import kernels
from vellumark.operators.rows import each_row
from vellumark.options import SliceOptions


def header_row(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |\n"


def pack_table(table: DataFrame, columns: list[str], order: str, limit: int, key: str | None = None, resplit: bool = False) -> DataFrame:
    """Rows of a table as markdown, packed to paragraphs below `limit` that each repeat the header: key, para_idx, content.

    Which row ends a paragraph depends on all before it, so rows of one key are gathered in order and packed in one Arrow
    call; `key` should split large tables. `resplit` cuts rows that are too long by themselves.
    """
    limit, header = SliceOptions(limit=limit).resolved().limit, header_row(columns)

    group = F.lit(0) if key is None else F.col(key)
    line = F.concat(table_row(*[escape_cell(F.col(c).cast("string")) for c in columns]), F.lit("\n"))
    gathered = table.select(group.alias("key"), F.col(order).alias("o"), line.alias("line")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("rows"))
    return gathered.select("key", F.posexplode(each_row(lambda own: kernels.pack_rows(header, own, limit, resplit), "array<string>", F.col("rows")["line"])).alias("para_idx", "content"))


def markdown_table(table: DataFrame, columns: list[str], order: str, key: str | None = None) -> DataFrame:
    """key, content: the whole table as one markdown table."""
    group = F.lit(0) if key is None else F.col(key)
    line = table_row(*[escape_cell(F.col(c).cast("string")) for c in columns])
    gathered = table.select(group.alias("key"), F.struct(F.col(order).alias("o"), line.alias("line")).alias("r")).groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return gathered.select("key", F.concat(F.lit(header_row(columns)), F.array_join(F.col("rows")["line"], "\n")).alias("content"))


def key_values(columns: list[str], colon: str = ": ") -> Column:
    """`name: value; name: value` of a row; empty and null cells are written as nothing."""
    return F.concat_ws("; ", *[F.concat(F.lit(c + colon), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def naive_csv_rows(text: Column) -> Column:
    """array<string>: `header:value` pairs of every row after the first, cut at plain commas."""
    lines = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: F.btrim(x) != "")
    head = F.split(F.get(lines, F.lit(0)), ",")
    return F.transform(F.slice(lines, 2, 2**30), lambda line: F.array_join(F.zip_with(head, F.split(line, ","), lambda k, v: F.concat(F.coalesce(k, F.lit("")), F.lit(":"), F.coalesce(v, F.lit("")))), "; "))


TITLES, CONTENTS, PROBLEMS = ("分段标题", "title"), ("分段内容", "content"), ("问题", "question", "problem")


def qa_rows(rows: DataFrame, name: str = "name", order: str = "row_no", cells: str = "cells") -> DataFrame:
    """Sheets of cells to questions and answers: name, row_no, title, content, problem_list.

    The first row of a sheet names the columns by how its cells begin; without names one column is the content, two are
    title and content, three add the questions, one a line. Rows without content are left out. Titles and questions
    are held to 255 characters, contents to 102,400.
    """
    first = F.min_by(cells, order)
    heads = rows.groupBy(name).agg(first.alias("_head"), F.min(order).alias("_first"))

    def place(names: tuple[str, ...]) -> Column:
        hit = lambda c: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.lower(F.btrim(c)).startswith(n))
        marks = F.transform("_head", lambda c: F.coalesce(hit(c), F.lit(False)))
        return F.array_position(marks, True).cast("int")

    named = heads.withColumn("_t", place(TITLES)).withColumn("_c", place(CONTENTS)).withColumn("_p", place(PROBLEMS))
    has = F.col("_c") > 0
    wide = F.size("_head")
    named = (
        named.withColumn("_skip", has)
        .withColumn("_title", F.when(has, F.col("_t")).otherwise(F.when(wide >= 2, 1).otherwise(0)))
        .withColumn("_content", F.when(has, F.col("_c")).otherwise(F.when(wide >= 2, 2).otherwise(1)))
        .withColumn("_problems", F.when(has, F.col("_p")).otherwise(F.when(wide >= 3, 3).otherwise(0)))
    )
    both = rows.join(named, name).filter(~(F.col("_skip") & (F.col(order) == F.col("_first"))))
    cell = lambda at: F.get(cells, F.col(at) - 1)
    lines = F.filter(F.transform(F.split(F.coalesce(cell("_problems"), F.lit("")), "\n"), lambda q: F.substring(F.btrim(q), 1, 255)), lambda q: q != "")
    return (
        both.select(
            name,
            F.col(order).alias("row_no"),
            F.substring(F.coalesce(cell("_title"), F.lit("")), 1, 255).alias("title"),
            F.substring(cell("_content"), 1, 102_400).alias("content"),
            F.transform(lines, lambda q: F.struct(q.alias("content"))).alias("problem_list"),
        )
        .filter(F.col("content").isNotNull() & (F.btrim("content") != ""))
    )


def fill_merged(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """(sheet, r, c, value) with every cell of a merged range (sheet, r1, c1, r2, c2) holding its first cell's value.

    Ranges are unrolled to the cells they cover, so this is an equi-join.
    """
    covered = merged.select("sheet", F.col("r1").alias("_r1"), F.col("c1").alias("_c1"), F.explode(F.sequence("r1", "r2")).alias("r"), "c1", "c2").select("sheet", "_r1", "_c1", "r", F.explode(F.sequence("c1", "c2")).alias("c"))
    lead = cells.select("sheet", F.col("r").alias("_r1"), F.col("c").alias("_c1"), F.col("value").alias("_lead"))
    filled = covered.join(lead, ["sheet", "_r1", "_c1"], "left").select("sheet", "r", "c", "_lead")
    return cells.join(filled, ["sheet", "r", "c"], "full").select("sheet", "r", "c", F.coalesce("_lead", "value").alias("value"))


def cached_values(formulas: DataFrame, cached: DataFrame) -> DataFrame:
    """(sheet, r, c, value): the cached value of a formula where there is one, else what the cell says."""
    right = cached.select("sheet", "r", "c", F.col("value").alias("_cached"))
    return formulas.join(right, ["sheet", "r", "c"], "left").select("sheet", "r", "c", F.coalesce("_cached", "value").alias("value"))
