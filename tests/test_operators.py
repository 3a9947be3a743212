import struct

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellumark import cli
from vellumark.functions import text as T
from vellumark.operators import kernels, media, metrics, passes, rows, split, tables
from vellumark.options import SliceOptions
from vellumark.sources import dispatch, files
from vellumark.streaming import ingest


def one(spark, value, column):
    kind = "binary" if isinstance(value, bytes) else "string"
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_split_and_tree_keep_nulls_out_and_order(spark):
    docs = spark.createDataFrame([(1, "# A\n\none\n\ntwo"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in split.slice_documents(docs, SliceOptions()).orderBy("doc_id", "para_idx").collect()] == [(1, 0, "A", "one"), (1, 1, "A", "two")]
    assert {r.doc_id for r in split.budget_split(docs, SliceOptions()).collect()} == {1, 3}


def test_mark_expression_equals_the_walk(spark):
    texts = ["", "a", "no marks at all" * 40, "x" * 700, "one. two! three; " * 60, "。中文！" * 200, " \n\n ", "a|b\\c " * 90]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split.mark_pieces(F.col("t"), 50).alias("m"))
    for r in df.collect():
        assert r.m == kernels.mark_chunk(r.t, 50), r.t


def test_chunks_carry_titles(spark):
    rows = spark.createDataFrame([(1, 0, "T", "a. " * 60), (1, 1, None, "b")], "doc_id long, para_idx int, title string, content string")
    got = split.chunk_paragraphs(rows, 60, carry_title=True).collect()
    assert all(r.content.startswith("# T\n") == (r.para_idx == 0) for r in got)
    assert split.chunk_paragraphs(rows, 60, chunk_overlap=20).count() > 3


def test_window_header_carry_equals_the_walk(spark):
    blocks = ["| h |\n| - |\n| 1 |\n", "| 2 |\n| 3 |", "text", "| 4 |", "| k |\n| --- |\n| 5 |\n\n", "| 6 |", "| 7 |\n|-|\n| 8 |", "| 9 |"]
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate(blocks)] + [(2, 0, "| a |")], "doc_id long, para_idx int, content string")
    got = passes.carry_table_headers(rows.repartition(3)).orderBy("doc_id", "para_idx").collect()
    assert [r.content for r in got] == [*kernels.carry_headers(blocks), "| a |"]


def test_text_functions(spark):
    assert one(spark, "# a\n```\n# b\n```\n## c", T.strip_markers) == kernels.strip_markers("# a\n```\n# b\n```\n## c")
    assert one(spark, "<b>Hello</b>  World\n", T.plain) == "hello world"
    assert one(spark, "![a](./oss/file/1-a) ![b](./oss/file/2) ![c](./oss/file/1-a)", T.references) == ["1-a", "2"]
    assert [one(spark, x, T.safe_member) for x in ("a/b", "../a", "/a", "a/../b", "C:\\x")] == [True, False, False, False, False]
    assert [one(spark, x, T.numbering_stripped) for x in ("1.2.3 Name", "第二章 标题", "(3) x", "三、y", "2nd place")] == ["Name", "标题", "x", "y", "2nd place"]
    assert one(spark, b"\x00\xff" * 60, lambda c: T.data_uri_bytes(T.data_uri(c, F.lit("a/b")))) == bytearray(b"\x00\xff" * 60)
    assert one(spark, "#a\nb\\s", T.clean_title) == "ab"
    assert one(spark, "a\r\nb\rc\0", T.normalise_line_ends) == "a\nb\nc"


def test_dispatch_expression_equals_the_function(spark):
    names = ["a.HTML", "b.fb2.zip", "c.tar.xz", "d", "e.mp4", "f.ts", "g.MD", "h.webp", "i.weird", "j.7z"] + [f"x{e}" for e in dispatch.supported_extensions()]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", dispatch.reader_column(F.col("n")).alias("r"))
    assert all(r.r == dispatch.reader_of(r.n) for r in df.collect())


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 40, 30) + b"\0" * 9
GIF = b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0" * 9
JPG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 20


def test_images_are_described_and_deduped(spark):
    rows = [("a", 0, PNG), ("b", 1, GIF), ("c", 2, PNG), ("d", 3, JPG), ("e", 4, None), ("f", 5, b"<svg xmlns='x'></svg>")]
    assets = media.describe(spark.createDataFrame(rows, "id string, idx int, content binary"))
    got = {r.id: (r.mime, r.width, r.height, r.suffix) for r in assets.collect()}
    assert got == {"a": ("image/png", 40, 30, ".png"), "b": ("image/gif", 5, 6, ".gif"), "c": ("image/png", 40, 30, ".png"), "d": ("image/jpeg", 9, 7, ".jpg"), "e": (None, None, None, None), "f": ("image/svg+xml", None, None, ".svg")}
    reasons = {r.id: r.why for r in assets.select("id", media.keep_reasons(vector=False).alias("why")).collect()}
    assert reasons == {"a": None, "b": "small", "c": None, "d": "small", "e": "external", "f": "vector"}
    kept, mapping = media.dedupe(assets)
    assert {r.id for r in kept.collect()} == {"a", "b", "d", "e", "f"} and {r.id: r.kept_id for r in mapping.collect()}["c"] == "a"
    kept, mapping = media.dedupe(assets, most=2)
    assert {r.id for r in kept.collect()} == {"a", "b"} and {r.id: r.kept_id for r in mapping.collect()} == {"a": "a", "b": "b", "c": "a", "d": None, "e": None, "f": None}


def test_attach_tries_each_way_in_order(spark):
    paragraphs = spark.createDataFrame([(1, 0, "Intro", "see ![x](./oss/file/r) now"), (1, 1, "The <b>Plan</b>", "some words that stand near the picture"), (1, 2, "The plan in detail", "r again ./oss/file/r")], "doc_id long, para_idx int, title string, content string")
    assets = [(1, "r", 0, "Intro", None, None), (1, "h", 1, "the  plan", None, None), (1, "a", 2, None, "x" * 40 + "some words that stand near the picture", None), (1, "d", 3, None, "short", "document"), (1, "n", 4, None, None, None), (2, "o", 5, "Intro", None, "document")]
    got = media.attach(paragraphs, spark.createDataFrame(assets, "doc_id long, id string, idx int, heading string, anchor string, role string")).collect()
    assert sorted((r.asset_id, r.para_idx, r.match) for r in got if r.asset_id != "r") == [("a", 1, "anchor"), ("d", 0, "document"), ("h", 1, "heading"), ("n", None, None), ("o", None, None)]
    assert sorted(r.para_idx for r in got if r.asset_id == "r") == [0, 2]


def test_recognised_text_goes_after_its_reference(spark):
    assets = spark.createDataFrame([(1, "a", 0, "s1", b"1", "x.png"), (1, "b", 1, "s1", b"1", "y.png"), (1, "c", 2, "s2", b"2", "z.png")], "doc_id long, id string, idx int, sha256 string, content binary, file_name string")
    texts = media.recognise(assets, lambda content, name: "enough letters to be worth keeping here" if content == b"1" else "-- ..")
    assert {r.id for r in texts.collect()} == {"a", "b"}
    paragraphs = spark.createDataFrame([(1, 0, "![p](./oss/file/a) and ![q](./oss/file/c)"), (1, 1, "none")], "doc_id long, para_idx int, content string")
    got = {r.para_idx: r.content for r in media.inject_text(paragraphs, texts).collect()}
    assert got == {0: "![p](./oss/file/a)\nenough letters to be worth keeping here\n and ![q](./oss/file/c)", 1: "none"}


def test_question_sheets_by_header_and_by_place(spark):
    rows = [("s", 0, ["问题", "分段内容", "分段标题"]), ("s", 1, ["q1\n\nq2", "answer", "title"]), ("s", 2, ["q", None, "t"]), ("p", 0, ["t", "c", "q"]), ("w", 0, ["only"])]
    got = {(r.name, r.row_no): (r.title, r.content, [q.content for q in r.problem_list]) for r in tables.qa_rows(spark.createDataFrame(rows, "name string, row_no int, cells array<string>")).collect()}
    assert got == {("s", 1): ("title", "answer", ["q1", "q2"]), ("p", 0): ("t", "c", ["q"]), ("w", 0): ("", "only", [])}


def test_metrics_count_multisets(spark):
    docs = spark.createDataFrame([(1, "a a b c")], "doc_id long, text string")
    pieces = spark.createDataFrame([(1, "a b"), (1, "b d")], "doc_id long, content string")
    assert tuple(metrics.token_recall(docs, pieces).first()) == (1, 4, 2, 4)


def test_batches_report_each_document(spark):
    inputs = [("a.txt", b"fine"), {"name": "b.mp4", "content": b"x"}, ("c.csv", b'a,b\n"x"y,1\n'), ("d.md", b"# T\n\none\n\ntwo")]
    done = files.slice_many(files.jobs(spark, inputs), SliceOptions())
    got = {r.idx: (r.ok, r.error_type, r.error_code) for r in done.collect()}
    assert got == {0: (True, None, None), 1: (False, "UnsupportedFormat", 400), 2: (False, "ParseFailure", 500), 3: (True, None, None)}
    assert tuple(files.batch_report(done).first())[:5] == (4, 2, 2, 3, 1)
    with pytest.raises(files.SliceError):
        files.raise_first(done)
    with pytest.raises(TypeError):
        files.jobs(spark, [b"raw"])


def test_files_streams_and_the_command_line(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_text("# T\n\none\n\ntwo")
    (source / "b.txt").write_text("![i](pic.png) text")
    (source / "c.txt").write_text("![i](pic.png) text")
    assert {r["name"]: r.length for r in files.read_documents(spark, str(source)).collect()} == {"a.md": 13, "b.txt": 18, "c.txt": 18}
    stream = ingest.slice_stream(ingest.document_stream(spark, str(source)), SliceOptions(), dedupe_within="1 hour")
    query = ingest.write_paragraphs(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.content for r in rows) == ["![i](pic.png) text", "one", "two"]
    assert cli.main(["slice", str(source)], spark) == 0 and '"title":"T"' in capsys.readouterr().out
    assert cli.main(["chunk", str(source), "--size", "50", "--carry-title", "--format", "md"], spark) == 0
    assert cli.main(["batch", str(source)], spark) == 0 and cli.main(["media", str(source)], spark) == 0
    assert "pic.png" in capsys.readouterr().out
    (source / "d.mp4").write_text("x")
    assert cli.main(["slice", str(source), "-o", str(tmp_path / "json")], spark) == 1
    assert cli.main(["detect", "a.md", "b.rar"]) == 1 and cli.main(["formats"]) == 0 and cli.main(["nothing"]) == 2


def test_plans_prune_columns_and_do_not_shuffle(spark, capsys):
    entry.queries()["budget_split_1000"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_entry_and_registered_queries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


CHECKED = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_batch_report_counts_a_text_over_the_largest_limit_once(spark, tmp_path):
    texts = [(1, "word. " * 20_000), (2, "# a heading\n\nits text\n\nmore"), (3, "   "), (10, "not read")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["batch_report"](spark, str(tmp_path)).first()
    assert tuple(got) == (4, 3, 1, 2, 10, "unsupported file format: 10.mp4")


def test_a_batch_is_worked_on_in_slices_of_bounded_size(spark):
    import pyarrow as pa

    texts = pa.array(["x" * 100_000] * 40 + ["y" * 3_000_000] + ["z"] * 2_000)
    parts = [p for (p,) in rows.slices((texts,))]
    assert sum(map(len, parts)) == len(texts) and pa.concat_arrays(parts).equals(texts)
    assert all(len(p) == 1 or (p.nbytes <= rows.SLICE_BYTES and len(p) <= rows.SLICE_ROWS) for p in parts)
    assert list(rows.slices((texts[:0],))) == []


def test_functions_over_rows_keep_order_and_nulls_and_put_out_slices(spark):
    plans = [split.split_pieces(F.col("t"), SliceOptions(limit=50)), files.outcome(F.lit("a.txt"), F.col("t").cast("binary"), SliceOptions(limit=50))]
    docs = spark.range(0, 5_000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("t"))
    for row in docs.select("id", "t", plans[0].alias("pieces"), plans[1].alias("o")).collect():
        assert row.pieces == (None if row.t is None else [row.t]) and row.o.ok and [p.content for p in row.o.paragraphs] == [row.t] * (row.t is not None)
