"""Queries that hold every reader against the titled texts its documents were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.options import SliceOptions
from vellumark.plans import compose
from vellumark.sources import files, qa

#: Turns as titled texts: the title of conversation and turn, and the text with and without its line ends.
_TURNS = "SELECT conv_id, turn, 'conv ' || conv_id AS head, role || ' ' || turn AS title, text, replace(text, chr(10), ' ') AS flat, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations"


def composed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One document of `kind` for each conversation: idx, name, content."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    title = F.concat_ws(" ", "role", "turn").alias("title")
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", title, "text"))).alias("t"))
    content = compose.document_column(kind, F.concat(F.lit("conv "), F.col("conv_id").cast("string")), F.col("t")["title"], F.col("t")["text"])
    return gathered.select(F.col("conv_id").alias("idx"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(compose.KINDS[kind][0])).alias("name"), content.alias("content"))


def _read(kind: str, limit: int = 100_000):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = files.slice_many(composed(spark, sf_dir, kind), SliceOptions(limit=limit))
        return done.select("idx", "ok", F.posexplode_outer("paragraphs").alias("para_idx", "p")).select("idx", "ok", "para_idx", "p.title", "p.content")

    return run


def _rows(title: str, content: str, order: str = "n") -> str:
    """One paragraph for each turn."""
    return f"SELECT conv_id AS idx, true AS ok, (row_number() OVER (PARTITION BY conv_id ORDER BY {order}) - 1)::INT AS para_idx, {title} AS title, {content} AS content FROM ({_TURNS})"


def _one(title: str, content: str) -> str:
    """One paragraph for each conversation."""
    return f"SELECT conv_id AS idx, true AS ok, 0 AS para_idx, {title} AS title, {content} AS content FROM ({_TURNS}) GROUP BY conv_id, head"


_NESTED = "head || '  ' || title"
_TABLE = "'| role | text |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || title || ' | ' || replace(text, chr(10), '<br>') || ' |', chr(10) ORDER BY n)"
_PLAIN = "head || chr(10) || string_agg(title || chr(10) || text, chr(10) ORDER BY n)"

ORACLES: dict[str, str] = {
    **{k: _rows(_NESTED, "text") for k in ("md", "utf16", "latin", "docx", "docx_fonts", "wps", "odt", "fodt", "ipynb", "xmind", "xmind_xml")},
    **{k: _rows(_NESTED, "flat") for k in ("html", "mhtml", "fb2", "fb2zip")},
    **{k: _rows("title", "text") for k in ("zip", "tar", "targz", "tarbz2", "mbox")},
    "epub": _rows("title", "flat", "n DESC"),
    "pptx": f"WITH t AS ({_TURNS}) SELECT conv_id AS idx, true AS ok, (2 * (n - 1) + k)::INT AS para_idx, title, CASE k WHEN 0 THEN text ELSE '备注：' || head || ' ' || title END AS content FROM t, (VALUES (0), (1)) v(k)",
    "ics": _rows("title", "'- 地点: ' || head || chr(10) || '- 描述: ' || text"),
    "eml": _one("head", "string_agg(text, chr(10) ORDER BY n)"),
    "rtf": _one("'c' || conv_id || '.rtf'", _PLAIN),
    "literal": _one("'c' || conv_id || '.py'", "'# ' || head || chr(10) || chr(10) || string_agg('## ' || title || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY n)"),
    "svg": _one("'c' || conv_id || '.svg'", "head || ' ' || string_agg(title || ' ' || flat, ' ' ORDER BY n)"),
    "svgz": _one("'c' || conv_id || '.svgz'", "head || ' ' || string_agg(title || ' ' || flat, ' ' ORDER BY n)"),
    "ass": _one("'c' || conv_id || '.ass'", "string_agg(title || ': ' || text, chr(10) ORDER BY n)"),
    "vtt": _one("'c' || conv_id || '.vtt'", "string_agg(text, chr(10) ORDER BY n)"),
    "xlsx": _one("head", _TABLE),
    "et": _one("'c' || conv_id", _TABLE),
}

QUERIES = {f"read_{kind}": _read(kind) for kind in ORACLES}
ORACLE_SQL = {f"read_{kind}": sql for kind, sql in ORACLES.items()}


def _questions(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return qa.question_rows(composed(spark, sf_dir, kind)).select("name", "row_no", "title", "content", F.size("problem_list").alias("n_problems"), F.col("problem_list")[0]["content"].alias("first"))

    return run


for _kind, _sheet in (("qa_md", "'c' || conv_id || '.md/' || head"), ("qa_zip", "'c' || conv_id || '.zip/' || head"), ("qa_csv", "'c' || conv_id || '.csv/c' || conv_id")):
    QUERIES[f"read_{_kind}"] = _questions(_kind)
    ORACLE_SQL[f"read_{_kind}"] = f"SELECT {_sheet} AS name, n::INT AS row_no, title, text AS content, len(string_split(text, chr(10)))::INT AS n_problems, substring(string_split(text, chr(10))[1], 1, 255) AS first FROM ({_TURNS})"
