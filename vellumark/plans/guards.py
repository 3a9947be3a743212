"""Queries of guards, sniffers, filters, walks and bounds that the other catalogues don't hold against SQL."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.functions import text as T
from vellumark.operators import kernels, media, split
from vellumark.operators.rows import each_row
from vellumark.options import ParserLimits, SliceOptions
from vellumark.plans import compose, reading, sql
from vellumark.sources import files, media_scan, pdf, qa

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({}, '\n+', chr(10), 'g'), ' +', ' ', 'g'), '\t+', '', 'g')"
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def query(name: str, oracle: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = function, oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Walks.


@query("title_overflow", "SELECT doc_id, 0 AS para_idx, repeat('t', 253) AS title, repeat('t', 47 + (doc_id % 5)::INT) || chr(10) || replace(substring(text, 1, 200), chr(10), ' ') AS content FROM documents WHERE regexp_matches(substring(text, 1, 200), '^[^|#]*[^|# \n][^|#]*$') AND trim(substring(text, 1, 200), ' ' || chr(10)) = substring(text, 1, 200) AND substring(text, 1, 200) NOT LIKE '%  %'")
def title_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of 300 characters and more: what is over the bound is text."""
    body = F.substring("text", 1, 200)
    docs = table(spark, sf_dir, "documents").filter(body.rlike(r"^[^|#]*[^|# \n][^|#]*$") & (F.btrim(body, F.lit(" \n")) == body) & ~body.contains("  "))
    text = F.concat(F.lit("# "), F.repeat(F.lit("t"), (300 + F.col("doc_id") % 5).cast("int")), F.lit("\n"), F.translate(body, "\n", " "))
    return split.slice_documents(docs.select("doc_id", text.alias("text")), SliceOptions(limit=100_000))


@query("fence_mask", "SELECT conv_id * 1000 + turn AS doc_id, 0 AS para_idx, 'Head' AS title, '```' || chr(10) || '# kept ' || role || chr(10) || '## kept too' || chr(10) || '```' AS content FROM conversations UNION ALL SELECT conv_id * 1000 + turn, 1, 'Next', text FROM conversations")
def fence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings inside closed fences do not cut."""
    text = F.concat(F.lit("# Head\n```\n# kept "), "role", F.lit("\n## kept too\n```\n\n# Next\n"), "text")
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("text"))
    return split.slice_documents(docs, SliceOptions(limit=100_000))


_ROW = "'| row' || lpad((n % 1000)::VARCHAR, 4, '0') || ' | ' || repeat('x', 40) || ' |' || chr(10)"


@query("table_row_guard", f"WITH r AS (SELECT p.p_partkey AS doc_id, n, n // 8 AS k FROM part p, (SELECT unnest(range(0, 40)) AS n) WHERE p.p_partkey % 4 = 0) SELECT doc_id, k::INT AS para_idx, string_agg({_ROW}, '' ORDER BY n) AS content FROM r GROUP BY doc_id, k")
def table_row_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 rows of 54 characters under a limit of 450: a cut inside a row goes back to its start."""
    row = lambda n: F.concat(F.lit("| row"), F.lpad((n % 1000).cast("string"), 4, "0"), F.lit(" | "), F.repeat(F.lit("x"), 40), F.lit(" |\n"))
    docs = table(spark, sf_dir, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), row), "").alias("text"))
    return split.budget_split(docs, SliceOptions(limit=450))


@query(
    "image_reference_guard",
    "WITH d AS (SELECT p_partkey AS doc_id, 470 + (p_partkey % 40)::INT AS a, length('![p](./oss/file/' || p_partkey || '-pic)')::INT AS m, repeat('x', 470 + (p_partkey % 40)::INT) || '![p](./oss/file/' || p_partkey || '-pic)' || repeat('y', 300) AS text FROM part), "
    "c AS (SELECT *, CASE WHEN a < 500 AND a + m > 500 THEN a ELSE 500 END AS cut FROM d) SELECT doc_id, 0 AS para_idx, substring(text, 1, cut) AS content FROM c UNION ALL SELECT doc_id, 1, substring(text, cut + 1) FROM c",
)
def image_reference_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference that lies across the cut goes to the next piece whole."""
    lead = F.repeat(F.lit("x"), (470 + F.col("p_partkey") % 40).cast("int"))
    text = F.concat(lead, F.lit("![p](./oss/file/"), F.col("p_partkey").cast("string"), F.lit("-pic)"), F.repeat(F.lit("y"), 300))
    return split.budget_split(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), SliceOptions(limit=500, boundary=False))


def _token_budget(words: int, lookback: float) -> str:
    """Windows of so many words: each ends where the next word would begin."""
    keep = int(words * lookback)
    rest = "substring(text, ({s}) + 1)"
    whole = f"regexp_extract({rest}, '^\\s*(?:\\S+\\s+){{{{{words}}}}}')"
    end = f"CASE WHEN regexp_matches({rest}, '^\\s*(?:\\S+\\s+){{{{{words}}}}}\\S') THEN ({{s}}) + length({whole}) ELSE length(text) END"
    window = f"substring(text, ({{s}}) + {keep + 2}, greatest(e - 1 - ({{s}}) - {keep + 1}, 0))"
    at = f"strpos(reverse(translate({window}, '。.!！?？', '......')), '.')"
    cut = f"CASE WHEN e >= length(text) THEN length(text) WHEN {at} > 0 THEN e - {at} ELSE e END"
    step = lambda source, s: f"SELECT doc_id, text, k, {s} AS s, ({cut.format(s=s)})::BIGINT AS c FROM (SELECT *, ({end.format(s=s)})::BIGINT AS e FROM {source})"
    return f"""WITH RECURSIVE cur(doc_id, text, k, s, c) AS (
{step("(SELECT doc_id, text, 0 AS k, 0::BIGINT AS s FROM documents)", "s")}
UNION ALL {step("(SELECT doc_id, text, k + 1 AS k, c AS s FROM cur WHERE c < length(text))", "s")})
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS para_idx, substring(text, s + 1, c - s) AS content FROM cur WHERE regexp_matches(substring(text, s + 1, c - s), '\\S') OR (s = 0 AND c = length(text))"""


@query("token_budget_words", _token_budget(120, 0.5))
def token_budget_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.budget_split(table(spark, sf_dir, "documents"), SliceOptions(limit=120, length_fn=lambda s: len(s.split())))


def _tree(limit: int, overlap: int) -> str:
    """Sections cut to the budget, cleaned, and each led by the end of the extended one before it."""
    turns = "SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations"
    rows = f"""SELECT b.doc_id // 100000 AS doc_id, 'conv ' || (b.doc_id // 100000) || '  ' || c.role || ' ' || c.turn AS title, content, row_number() OVER (PARTITION BY b.doc_id // 100000 ORDER BY b.doc_id, b.para_idx) AS n
FROM ({sql.budget(limit, source=turns)}) b JOIN conversations c ON b.doc_id = c.conv_id * 100000 + c.turn"""
    carried = f"right(f.content, {overlap})"
    snapped = rf"CASE WHEN length(f.content) > {overlap} AND regexp_matches({carried}, '^[^。.!！?？ \n\t]*[。.!！?？ \n\t](?s:.*)\S') THEN regexp_replace({carried}, '^[^。.!！?？ \n\t]*[。.!！?？ \n\t]', '') ELSE {carried} END"
    return rf"""WITH RECURSIVE r AS ({rows}),
f AS (SELECT doc_id, n, title, content FROM r WHERE n = 1
  UNION ALL SELECT r.doc_id, r.n, r.title, CASE WHEN regexp_matches({carried}, '\S') THEN {snapped} || ' ' || r.content ELSE r.content END FROM f JOIN r ON r.doc_id = f.doc_id AND r.n = f.n + 1)
SELECT doc_id, (n - 1)::INT AS para_idx, title, trim(content, {_BLANK}) AS content FROM f"""


@query("slice_tree_limit_200", _tree(200, 40))
def slice_tree_limit_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.lit("## "), F.concat_ws(" ", "role", "turn"), F.lit("\n\n"), "text")
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("t"))
    docs = grouped.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("# conv "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.col("t")["p"], "\n\n")).alias("text"))
    return split.slice_documents(docs, SliceOptions(limit=200, overlap=40))


@query("limit_is_held_in_its_bounds", sql.budget(50))
def limit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.budget_split(table(spark, sf_dir, "documents"), SliceOptions(limit=7))


@query("overlap_is_half_the_limit", sql.budget(100, overlap=50))
def overlap_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.budget_split(table(spark, sf_dir, "documents"), SliceOptions(limit=100, overlap_ratio=0.9, overlap_boundary=False))


@query(
    "line_split_300",
    "WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS m FROM documents), "
    "w AS (SELECT doc_id, n, m, CASE WHEN n < m THEN line || chr(10) ELSE line END AS line FROM l), "
    "g AS (SELECT doc_id, n, 0 AS k, length(line) AS size FROM w WHERE n = 1 UNION ALL SELECT w.doc_id, w.n, CASE WHEN w.n < w.m AND g.size > 0 AND g.size + length(w.line) > 300 THEN g.k + 1 ELSE g.k END, CASE WHEN w.n < w.m AND g.size > 0 AND g.size + length(w.line) > 300 THEN 0 ELSE g.size END + length(w.line) FROM g JOIN w ON w.doc_id = g.doc_id AND w.n = g.n + 1), "
    "p AS (SELECT g.doc_id, g.k, string_agg(w.line, '' ORDER BY w.n) AS part FROM g JOIN w USING (doc_id, n) GROUP BY g.doc_id, g.k), "
    "c AS (SELECT doc_id, k, unnest(range(0, length(part), 300)) AS b, part FROM p) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, b) - 1)::INT AS para_idx, substring(part, b + 1, 300) AS content FROM c",
)
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.explode_pieces(table(spark, sf_dir, "documents"), split.line_pieces(F.col("text"), 300))


@query("own_chunker", "WITH c AS (SELECT conv_id AS doc_id, turn::INT AS para_idx, role AS title, list_filter(string_split(text, '. '), lambda x: x <> '') AS parts FROM conversations) SELECT doc_id, para_idx, title, (generate_subscripts(parts, 1) - 1)::INT AS chunk_idx, '# ' || title || chr(10) || unnest(parts) AS content FROM c")
def own_chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("para_idx"), F.col("role").alias("title"), F.col("text").alias("content"))
    return split.chunk_with(paragraphs, lambda texts, size: [p for t in texts for p in t.split(". ")], carry_title=True)


@query("own_worker", "SELECT c_custkey, c_custkey % 7 <> 0 AS ok, CASE WHEN c_custkey % 7 <> 0 THEN reverse(c_name) END AS value, CASE WHEN c_custkey % 7 = 0 THEN 'ZeroDivisionError' END AS error_type FROM customer")
def own_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    def worker(row: dict) -> str:
        1 // (row["c_custkey"] % 7)
        return row["c_name"][::-1]

    return split.map_items(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), worker).drop("c_name", "error")


# Scalars.


@query("anchored_position", "SELECT doc_id, strpos(' ' || translate(text, chr(9) || chr(10) || chr(13), '   '), ' ' || ['the', 'die', 'de', 'la'][doc_id % 4 + 1])::INT AS place FROM documents")
def anchored_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.get(F.array(*[F.lit(x) for x in ("the", "die", "de", "la")]), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.anchored_position(F.col("text"), key).alias("place"))


@query("erase_line_ends", "SELECT doc_id, md5(replace(replace(replace(replace(text, '.', '。'), '。' || chr(10), '。' || chr(1)), chr(10), ''), chr(1), chr(10))) AS erased FROM documents")
def erase_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.erase_line_ends(F.translate("text", ".", "。")).cast("binary")).alias("erased"))


@query("member_safety", "SELECT c_custkey, c_custkey % 6 < 2 AS safe FROM customer")
def member_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(F.col("c_name"), F.concat(F.lit("a/..b/"), "c_name"), F.concat(F.lit("/"), "c_name"), F.concat(F.lit("a/../"), "c_name"), F.concat(F.lit("..\\"), "c_name"), F.concat(F.lit("C:"), "c_name")), (F.col("c_custkey") % 6).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.safe_member(name).alias("safe"))


@query("title_tree", "SELECT c_custkey, repeat('│  ', (c_custkey % 4)::INT) || '├───' || c_name AS line, sha256(c_name) AS id FROM customer")
def title_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.title_tree_line((F.col("c_custkey") % 4).cast("int"), F.col("c_name")).alias("line"), F.sha2(F.col("c_name").cast("binary"), 256).alias("id"))


@query("media_file_names", "SELECT p_partkey, lpad((p_partkey % 900)::VARCHAR, 3, '0') || '-' || replace(p_name, ' ', '_') || '.png' AS name FROM part")
def media_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", media_scan.media_file_name(F.col("p_partkey") % 900, F.concat("p_name", F.lit(".jpeg")), F.lit(".png")).alias("name"))


# Images.


def raster(kind: int, width: int, height: int) -> bytes:
    """The head of an image of each kind."""
    if kind == 0:
        return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", width, height) + b"\x08\2\0\0\0"
    if kind == 1:
        return b"GIF89a" + struct.pack("<HH", width, height) + b"\0\0\0"
    if kind == 2:
        return b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, width, -height) + b"\0" * 8
    if kind == 3:
        return b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    if kind == 4:
        return b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, width, 0) + struct.pack("<HHIHH", 257, 3, 1, height, 0)
    if kind == 5:
        return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, height, width) + b"\0" * 8
    if kind == 6:
        return f'<?xml version="1.0"?><svg xmlns="s" viewBox="0 0 {width} {height}"><g/></svg>'.encode()
    return b"\0\0\0\x18ftypheic\0\0\0\0mif1heic\0\0\0\x14ispe\0\0\0\0" + struct.pack(">II", width, height)


_MIMES = ["image/png", "image/gif", "image/bmp", "image/webp", "image/tiff", "image/jpeg", "image/svg+xml", None]


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("idx"), each_row(raster, "binary", F.col("p_partkey") % 8, F.col("p_partkey") % 300 + 1, F.col("p_size") + 5).alias("content"))


_SIZES = "(p_partkey % 300 + 1)::INT AS width, (p_size + 5)::INT AS height"
_MIME = "[" + ", ".join("NULL" if m is None else f"'{m}'" for m in _MIMES) + "][p_partkey % 8 + 1]"


@query("image_sizes", f"SELECT p_partkey AS id, {_MIME} AS mime, {_SIZES} FROM part")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(_rasters(spark, sf_dir)).select("id", "mime", "width", "height")


@query("image_keep_reasons", f"WITH s AS (SELECT p_partkey AS id, {_MIME} AS mime, {_SIZES} FROM part) SELECT id, CASE WHEN id % 11 = 0 THEN 'external' WHEN mime = 'image/svg+xml' THEN 'vector' WHEN least(width, height) < 20 THEN 'small' WHEN id % 5 = 0 THEN 'large' END AS reason FROM s")
def image_keep_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.when(F.col("id") % 5 == 0, F.concat(F.col("content"), F.lit(bytes(5000)))).otherwise(F.col("content"))
    described = media.describe(_rasters(spark, sf_dir).withColumn("content", wide)).withColumn("content", F.when(F.col("id") % 11 != 0, F.col("content")))
    return described.select("id", media.keep_reasons(min_side=20, max_bytes=4000, vector=False).alias("reason"))


@query("container_kinds", "SELECT c_custkey, ['zip', 'pdf', 'ole', 'image', 'mime', 'markup'][c_custkey % 6 + 1] AS kind FROM customer")
def container_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = [b"PK\3\4", b"%PDF-1.7 ", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"\x89PNG\r\n\x1a\n", b"Subject: x\nMIME-Version: 1.0\n\n", b"<p>"]
    content = F.concat(F.get(F.array(*[F.lit(h) for h in heads]), (F.col("c_custkey") % 6).cast("int")), F.col("c_name").cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey", media.container_kind(content).alias("kind"))


@query("sha_dedupe_most", "WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS kept FROM documents GROUP BY 1), t AS (SELECT h, kept FROM f ORDER BY kept LIMIT 40) SELECT doc_id AS id, t.kept AS kept_id FROM documents d LEFT JOIN t ON t.h = sha256(d.text)")
def sha_dedupe_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("idx"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return media.dedupe(assets, most=40)[1]


@query("held_assets_left_out", "SELECT doc_id AS id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def held_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return media.not_held(assets, assets.filter("id % 3 = 0").select("sha256")).select("id")


@query("recognised_once", "WITH d AS (SELECT doc_id % 20 AS doc, doc_id AS id, text, min(doc_id) OVER (PARTITION BY doc_id % 20, sha256(text)) AS first FROM documents), k AS (SELECT doc, first, dense_rank() OVER (PARTITION BY doc ORDER BY first) AS n FROM (SELECT DISTINCT doc, first FROM d)) SELECT d.doc AS doc_id, d.id, 'recognised text number ' || length(d.text) || ' of this picture here' AS text FROM d JOIN k ON d.doc = k.doc AND d.first = k.first WHERE k.n <= 5")
def recognised_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.col("text").cast("binary")
    assets = docs.select((F.col("doc_id") % 20).alias("doc_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("idx"), content.alias("content"), F.lit("p.png").alias("file_name"), F.sha2(content, 256).alias("sha256"))
    return media.recognise(assets, lambda data, name: f"recognised text number {len(data.decode())} of this picture here", most=5)


def _illustrated(head: str, parts: compose.Parts) -> bytes:
    """A package with a page that shows a picture for every part, one picture nobody shows, and a link to another host."""
    body = "".join(f'<h2>{t}</h2><p>{x}</p><img src="../img/P{k}.PNG?x=1">' for k, (t, x) in enumerate(parts))
    pictures = [(f"img/p{k}.png", raster(0, 10 + k, 20)) for k in range(len(parts))]
    return compose.zipped([("text/page.html", f"<html><body>{body}<img src='http://example.org/far.png'></body></html>"), *pictures, ("cover.png", raster(0, 5, 5))])


compose.KINDS["illustrated"] = (".zip", _illustrated)


@query(
    "media_scan_zip",
    "WITH t AS (SELECT conv_id, role || ' ' || turn AS title, replace(text, chr(10), ' ') AS flat, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations) "
    "SELECT conv_id AS doc_id, k::INT AS idx, 'P' || k || '.PNG' AS file_name, title AS heading, right(trim(title || ' ' || flat), 96) AS tail, NULL AS role, (10 + k)::INT AS width FROM t "
    "UNION ALL SELECT DISTINCT conv_id, m::INT, 'cover.png', NULL, NULL, 'document', 5 FROM t",
)
def media_scan_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reading.composed(spark, sf_dir, "illustrated").withColumnRenamed("idx", "doc_id")
    found = media_scan.extract_assets(docs).withColumn("size", media.dimensions(F.col("content")))
    own = F.right(F.regexp_extract("anchor", r"((?:assistant|user|system) \d+ (?:(?!(?:assistant|user|system) \d+ ).)*)$", 1), F.lit(96))
    tail = F.when(F.col("role").isNull(), F.when(own == "", F.col("anchor")).otherwise(own))
    return found.select("doc_id", "idx", "file_name", "heading", tail.alias("tail"), "role", F.col("size.width").alias("width"))


# Readers' bounds and PDF ways.


@query(
    "refusals",
    "SELECT c_custkey, ['UnsupportedFormat', 'ParseFailure', 'LimitExceeded', 'LimitExceeded', 'ParseFailure', 'UnsupportedFormat', 'ParseFailure', NULL][c_custkey % 8 + 1] AS error_type, [400, 500, 413, 413, 500, 400, 500, NULL][c_custkey % 8 + 1]::INT AS error_code FROM customer",
)
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary, markup with a document type, too long a file, too many members, a broken table, an old workbook, a broken package, and a text."""
    two = compose.zipped([(f"{k}.txt", "x") for k in range(40)])
    made = [("a.txt", b"a\0b"), ("b.svg", b"<!DOCTYPE x><svg/>"), ("c.txt", b"x" * 9000), ("d.zip", two), ("e.csv", b'a,b\n"x"y,1\n'), ("f.doc", b"\xd0\xcf\x11\xe0" + b"x" * 60), ("g.docx", b"PK\3\4junk"), ("h.txt", b"fine")]
    kind = (F.col("c_custkey") % 8).cast("int")
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*[F.lit(n) for n, _ in made]), kind).alias("name"), F.get(F.array(*[F.lit(b) for _, b in made]), kind).alias("content"))
    return files.slice_many(docs, SliceOptions(), limits=ParserLimits(max_bytes=8000, max_members=30)).select("c_custkey", "error_type", "error_code")


@query("question_outcomes", "SELECT 'c' || c_custkey || ['.csv', '.txt', '.csv', '.zip'][c_custkey % 4 + 1] AS name, c_custkey % 4 = 0 AS ok, [NULL, 'UnsupportedFormat', 'UnsupportedFormat', 'ParseFailure'][c_custkey % 4 + 1] AS error_type, [NULL, 400, 400, 500][c_custkey % 4 + 1]::INT AS error_code, CASE WHEN c_custkey % 4 = 0 THEN 2 END AS n_rows FROM customer")
def question_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [(".csv", b"Title,Content\nt,c\n"), (".txt", b"x"), (".csv", b"a\0b"), (".zip", b"PK\3\4junk")]
    kind = (F.col("c_custkey") % 4).cast("int")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.get(F.array(*[F.lit(n) for n, _ in made]), kind))
    docs = table(spark, sf_dir, "customer").select(name.alias("name"), F.get(F.array(*[F.lit(b) for _, b in made]), kind).alias("content"))
    return qa.question_outcomes(docs).drop("error").withColumn("n_rows", F.when(F.col("ok"), F.col("n_rows")))


@query("read_image_names", "SELECT p_partkey AS idx, 'p' || p_partkey || '.png' AS title, 'p' || p_partkey || '.png' AS content FROM part")
def read_image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _rasters(spark, sf_dir).select("idx", F.concat(F.lit("p"), F.col("idx").cast("string"), F.lit(".png")).alias("name"), "content")
    return files.slice_many(docs, SliceOptions()).select("idx", F.explode("paragraphs").alias("p")).select("idx", "p.title", "p.content")


@query("read_vcards", "SELECT c_custkey AS idx, replace(c_name, '#', '') AS title, '- 单位: ' || c_mktsegment || ' Unit' || chr(10) || '- 电话: +' || c_nationkey AS content FROM customer")
def read_vcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.concat(F.lit("BEGIN:VCARD\r\nFN:"), F.substring("c_name", 1, 6), F.lit("\r\n "), F.substring("c_name", 7, 100), F.lit("\r\nORG:"), "c_mktsegment", F.lit(";Unit\r\nTEL;TYPE=cell:+"), F.col("c_nationkey").cast("string"), F.lit("\r\nEND:VCARD\r\n"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.lit("c.vcf").alias("name"), card.cast("binary").alias("content"))
    return files.slice_many(docs, SliceOptions()).select("idx", F.explode("paragraphs").alias("p")).select("idx", "p.title", "p.content")


compose.KINDS["wide_rows"] = (".xlsx", lambda head, parts: compose.workbook([(head, [["role", "text"], *([t, (x * 40)[:900].replace("\n", " ")] for t, x in parts)])]))

_WIDE = f"WITH t AS ({reading._TURNS}), r AS (SELECT conv_id, head, n, '| ' || title || ' | ' || replace(substring(repeat(text, 40), 1, 900), chr(10), ' ') || ' |' || chr(10) AS line FROM t), c AS (SELECT conv_id, head, n, unnest(range(0, length(line), 466)) AS b, line FROM r) SELECT conv_id AS idx, (row_number() OVER (PARTITION BY conv_id ORDER BY n, b) - 1)::INT AS para_idx, head AS title, trim('| role | text |' || chr(10) || '| --- | --- |' || chr(10) || substring(line, b + 1, 466), {_BLANK}) AS content FROM c"


@query("read_wide_rows", _WIDE.replace("466", str(500 - len("| role | text |\n| --- | --- |\n"))))
def read_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows longer than the limit are cut, each part under the header."""
    done = files.slice_many(reading.composed(spark, sf_dir, "wide_rows"), SliceOptions(limit=500))
    return done.select("idx", F.posexplode("paragraphs").alias("para_idx", "p")).select("idx", "para_idx", "p.title", "p.content")


def _paged(spark: SparkSession, sf_dir: str, make: Callable[[str, list[str], list[str]], list[tuple[str, str]]]) -> DataFrame:
    """Paragraphs of a paged document of each conversation, a page for each turn."""

    title = F.concat(F.lit("Part "), F.col("turn").cast("string"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", title.alias("title"), "text"))).alias("t"))
    rows = grouped.select("conv_id", F.posexplode(each_row(make, "array<struct<title:string,content:string>>", F.concat(F.lit("conv "), F.col("conv_id").cast("string")), F.col("t")["title"], F.col("t")["text"])).alias("para_idx", "p"))
    return rows.select(F.col("conv_id").alias("doc_id"), "para_idx", "p.title", "p.content")


_PAGED = "WITH t AS (SELECT conv_id, turn, 'conv ' || conv_id AS head, 'Part ' || turn AS title, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)"


@query("pdf_outline", f"{_PAGED} SELECT conv_id AS doc_id, (n - 1)::INT AS para_idx, head || ' ' || title AS title, replace(text, chr(10), '') || '![i](./oss/file/' || substring(sha256(title), 1, 32) || ')' || chr(10) || chr(10) AS content FROM t UNION ALL SELECT DISTINCT conv_id, -1, head, 'front ' || head FROM t")
def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(head: str, titles: list[str], texts: list[str]) -> list[tuple[str, str]]:
        pages = [f"front\n {head}", *(f"{t}\n{x}" for t, x in zip(titles, texts, strict=True))]
        outline = [(1, head, 0), *((2, t, k) for k, t in enumerate(titles, 1))]
        images = [[], *([("[i]", t.encode())] for t in titles)]
        found = pdf.by_outline(pdf.PagedDocument(pages, outline, images=images), SliceOptions(limit=100_000).resolved())
        return [(found[0][0], "front " + head)] + found[1:]

    return _paged(spark, sf_dir, make).withColumn("para_idx", F.col("para_idx") - 1)


@query("pdf_links", f"{_PAGED} SELECT conv_id AS doc_id, n::INT AS para_idx, title, replace(text, chr(10), '') AS content FROM t UNION ALL SELECT DISTINCT conv_id, 0, '', 'before ' || head FROM t")
def pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(head: str, titles: list[str], texts: list[str]) -> list[tuple[str, str]]:
        pages = [f"before {head}", "\n".join(titles), *(f"{t}\n{x}" for t, x in zip(titles, texts, strict=True))]
        links = [(1, t if k % 2 else "", k + 2) for k, t in enumerate(titles)]
        return pdf.by_links(pdf.PagedDocument(pages, links=links), SliceOptions(limit=100_000).resolved())

    return _paged(spark, sf_dir, make)


@query("pdf_fonts", f"{_PAGED} SELECT conv_id AS doc_id, n::INT AS para_idx, head || '  ' || title AS title, text AS content FROM t UNION ALL SELECT conv_id, 0, head, repeat('intro' || chr(10), count(*)::INT) || 'intro' FROM t GROUP BY conv_id, head")
def pdf_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(head: str, titles: list[str], texts: list[str]) -> list[tuple[str, str]]:
        lines = [[(head, 20.0), *[("intro", 12.0)] * (len(titles) + 1)], *([(t, 13.0), *((line, 12.0) for line in x.split("\n"))] for t, x in zip(titles, texts, strict=True))]
        body = pdf.font_text(pdf.PagedDocument([""] * len(lines), lines=[*lines, [("", 12.0)]]))
        return kernels.slice_text(body, SliceOptions(limit=100_000).resolved())

    return _paged(spark, sf_dir, make)
