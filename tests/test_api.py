import struct

from vellumark import api
from vellumark.options import SliceOptions

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 40, 30) + b"\0" * 9


def test_single_documents():
    assert api.slice_text("# A\n\none") == [("A", "one")]
    assert api.slice_bytes(b"one", "a.txt", fallback_title="T") == [("T", "one")]
    assert api.extract_text(b"<h1>x</h1>", "a.html") == "# x"
    assert api.extract_media(PNG, "p.png").scanned == 1
    assert api.chunk("One. Two. " * 40, 60)[0].startswith("One.") and len(api.chunk("x" * 500, 100, 20)) > 5
    assert api.detect_reader("a.docx") == "docx" and api.patterns_for("a.py") == () and ".md" in api.supported_extensions()
    assert set(api.missing_dependencies()) <= {"pdf", "xls", "ppt", "msg", "mobi", "7z"}


def test_widths(spark):
    slots = spark.sparkContext.defaultParallelism
    assert [api.partitions_for(spark, p) for p in ("auto", "cores", "serial", "2x", 3, "5")] == [slots, slots, 1, 2 * slots, 3, 5]


def test_documents_with_images(spark, tmp_path):
    page = b"# Head\n\nSome words before the picture.\n\n![p](data:image/png;base64," + __import__("base64").b64encode(PNG) + b")\n"
    docs = spark.createDataFrame([("a", "a.md", page), ("b", "b.mp4", b"x")], "doc_id string, name string, content binary")
    paragraphs, kept, attached = api.slice_multimodal(docs, SliceOptions(limit=1000))
    assert kept.count() == 1 and [(r.doc_id, r.match) for r in attached.collect()] == [("a", "heading")]
    rows = api.assemble(paragraphs, attached, kept).collect()
    assert [len(r.images) for r in rows if r.images] == [1]
    (tmp_path / "x.md").write_text("one")
    assert [(r.title, r.content) for r in api.slice_documents(api.slice_paths(spark, str(tmp_path))).collect()] == [("x.md", "one")]
