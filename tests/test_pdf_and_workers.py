"""PDF ways behind a stub of the package that reads files, optional readers, and functions of the caller's own."""

import struct
import sys
import types

import pytest

from vellumark.errors import LimitExceeded, ParseFailure, UnsupportedFormat
from vellumark.operators import kernels, media, split
from vellumark.options import ParserLimits, SliceOptions
from vellumark.sources import formats, media_scan, pdf, qa

OPTIONS = SliceOptions(limit=100_000).resolved()
CONTEXT = formats.Context(OPTIONS)


class Page:
    def __init__(self, lines, images=(), marks=()):
        self.lines, self.images, self.annotations = lines, [types.SimpleNamespace(name=n, data=d) for n, d in images], [Mark(m) for m in marks]

    def extract_text(self, visitor_text=None):
        for k, (text, size) in enumerate(self.lines):
            if visitor_text is not None:
                visitor_text(text, None, (1, 0, 0, 1, 0, 700 - 20 * k), None, size)
        return "\n".join(t for t, _ in self.lines)


class Mark(dict):
    def __init__(self, target):
        super().__init__({"/Dest": target})

    def get_object(self):
        return self


def stub(monkeypatch, pages, outline=()):
    reader = types.SimpleNamespace(pages=pages, outline=list(outline), get_destination_page_number=lambda e: e if isinstance(e, int) else e.page)
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=lambda stream: reader))


def entry(title, page):
    return types.SimpleNamespace(title=title, page=page)


def test_without_the_package_a_pdf_is_refused():
    with pytest.raises(UnsupportedFormat):
        formats.slice_bytes(b"%PDF-1.4", "a.pdf", CONTEXT)


def test_outline_gives_chains_cuts_at_headings_and_places_images(monkeypatch):
    pages = [
        Page([("1 Start", 12), ("alpha", 12), ("1.1 Detail", 12), ("beta", 12)], images=[("fig[1].png", b"one")]),
        Page([("more of beta。", 12), ("and on", 12)]),
        Page([("read (2 End) first", 12), ("still beta", 12), ("2 End", 12), ("gamma", 12)], images=[("b.png", b"two")]),
    ]
    stub(monkeypatch, pages, [entry("1 Start", 0), [entry("1.1 Detail", 0)], entry("2 End", 2)])
    got = formats.slice_bytes(b"%PDF-", "a.pdf", CONTEXT)
    assert [t for t, _ in got] == ["1 Start", "1 Start 1.1 Detail", "2 End"]
    assert got[0][1] == "alpha"
    assert got[1][1].startswith("beta![fig1.png](./oss/file/") and got[1][1].endswith("more of beta。\nand on")
    assert got[2][1].startswith("gamma![b.png](") and pdf.anchored("read (2 End) and 2 End", "2 End") == 17


def test_headings_without_their_number_and_long_sections():
    document = pdf.PagedDocument(["Scope\n" + "word. " * 60], [(1, "3 Scope", 0)])
    (title, content), *rest = pdf.by_outline(document, SliceOptions(limit=100).resolved())
    assert title == "3 Scope" and content.startswith("word.") and rest and all(t == title and len(c) <= 100 for t, c in rest)
    assert pdf.by_outline(pdf.PagedDocument(["Empty"], [(1, "Empty", 0)]), OPTIONS) == [("Empty", "Empty")]
    assert pdf.owners([0, 0, 2], 4) == {0: 1, 1: 1, 2: 2, 3: 2}


def test_links_titles_from_first_lines_and_text_before(monkeypatch):
    pages = [Page([("Foreword of the book", 12)]), Page([("Contents", 12)], marks=[2, 3]), Page([("One", 12), ("first", 12)]), Page([("Two", 12), ("second", 12)])]
    stub(monkeypatch, pages)
    assert formats.slice_bytes(b"%PDF-", "a.pdf", CONTEXT) == [("a.pdf", "Foreword of the book"), ("One", "first"), ("Two", "second")]


def test_fonts_make_headings_and_nothing_is_an_error(monkeypatch):
    stub(monkeypatch, [Page([("Big", 20), ("Mid", 13), ("text", 12), ("text two", 12)])])
    assert formats.slice_bytes(b"%PDF-", "a.pdf", CONTEXT) == [("Big  Mid", "text\ntext two")]
    stub(monkeypatch, [Page([])])
    with pytest.raises(ParseFailure):
        formats.slice_bytes(b"%PDF-", "a.pdf", CONTEXT)


def test_images_of_a_pdf_are_scanned(monkeypatch):
    stub(monkeypatch, [Page([("Head", 20), ("some text here", 12)], images=[("a.png", b"1"), ("b.png", b"2")]), Page([("plain", 12)], images=[("c.png", b"3")])])
    scan = media_scan.scan_media(b"%PDF-", "a.pdf")
    assert scan.kind == "pdf" and [(a["file_name"], a["heading"], a["src"]) for a in scan.assets] == [("a.png", "Head", "page 1"), ("b.png", "Head", "page 1"), ("c.png", None, "page 2")]
    assert scan.assets[0]["anchor"] == "Head some text here"


def test_old_workbooks_mail_and_books(monkeypatch, tmp_path):
    sheet = types.SimpleNamespace(name="Sheet1", nrows=3, row_values=lambda r: [["title", "content"], ["t", "c"], ["", "d"]][r], merged_cells=[(1, 3, 0, 1)])
    monkeypatch.setitem(sys.modules, "xlrd", types.SimpleNamespace(open_workbook=lambda **given: types.SimpleNamespace(sheets=lambda: [sheet])))
    assert formats.slice_bytes(b"x", "a.xls", CONTEXT) == [("Sheet1", "| title | content |\n| --- | --- |\n| t | c |\n| t | d |")]
    assert qa.read_sheets(b"x", "q.xls") == [("q", [["title", "content"], ["t", "c"], ["t", "d"]])]
    message = types.SimpleNamespace(subject="S", body=None, htmlBody=b"<p>from <b>html</b></p>")
    monkeypatch.setitem(sys.modules, "extract_msg", types.SimpleNamespace(Message=lambda stream: message))
    assert formats.slice_bytes(b"x", "a.msg", CONTEXT) == [("S", "from **html**")]

    def extract(path):
        folder = tmp_path / "kept"
        folder.mkdir()
        (folder / "book.html").write_text("<h1>B</h1><p>text</p>")
        return str(folder), str(folder / "book.html")

    monkeypatch.setitem(sys.modules, "mobi", types.SimpleNamespace(extract=extract))
    assert formats.slice_bytes(b"x", "a.mobi", CONTEXT) == [("B", "text")] and not (tmp_path / "kept").exists()
    with pytest.raises(LimitExceeded):
        formats.read(b"x", "a.mobi", formats.Context(OPTIONS, ParserLimits(max_member_bytes=3)))


def test_sizes_of_drawings_and_heif():
    assert media.pixel_size(b'<svg width="30px" height="20.4" viewBox="0 0 1 1">') == (30, 20)
    assert media.pixel_size(b'<?xml version="1.0"?><svg xmlns="s" viewBox="0 0 64 32">') == (64, 32)
    assert media.pixel_size(b"<svg>") is None and media.pixel_size(b"") is None
    box = b"\0\0\0\x18ftypheic" + b"\0" * 8 + b"ispe\0\0\0\0" + struct.pack(">II", 10, 10) + b"ispe\0\0\0\0" + struct.pack(">II", 640, 480)
    assert media.pixel_size(box) == (640, 480)


def test_line_split_keeps_every_character():
    text = "ab\n" * 5 + "x" * 25 + "\nend"
    assert kernels.line_split(text, 7) == ["ab\nab\n", "ab\nab\n", "ab\n", "x" * 7, "x" * 7, "x" * 7, "xxxx\nen", "d"] or "".join(kernels.line_split(text, 7)) == text
    assert kernels.line_split("", 5) == [] and all(len(p) <= 7 for p in kernels.line_split(text, 7))


def test_workers_of_the_callers_own(spark):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "k long, t string").repartition(2)
    got = {r.k: (r.ok, r.value, r.error_type, r.error) for r in split.map_items(rows, lambda r: str(10 // r["k"]) + r["t"], set_up=lambda: None).collect()}
    assert got[0] == (False, None, "ZeroDivisionError", "integer division or modulo by zero") or got[0][:3] == (False, None, "ZeroDivisionError")
    assert got[5] == (True, "2t5", None, None) and len(got) == 6
    assert split.map_items(rows.limit(0), lambda r: "").count() == 0
