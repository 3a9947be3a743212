import gzip
import io
import json
import tarfile
import zipfile

import pytest

from vellumark.errors import LimitExceeded, ParseFailure, SliceError, UnsupportedFormat
from vellumark.options import ParserLimits, SliceOptions
from vellumark.sources import dispatch, formats

CONTEXT = formats.Context(SliceOptions(limit=500).resolved())


def rows(content, name, **given):
    return formats.slice_bytes(content if isinstance(content, bytes) else content.encode(), name, CONTEXT, **given)


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name.replace("__", "/").replace("_DOT_", "."), data)
    return out.getvalue()


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def test_markdown_and_titles():
    assert rows("# A\n\none\n\n## B\n\ntwo", "x.md") == [("A", "one"), ("A  B", "two")]
    assert rows("plain", "x.txt") == [("x.txt", "plain")]
    assert rows("plain", "x.txt", fallback_title="T") == [("T", "plain")]
    assert rows("def f():\n\n    return 1\n# c", "x.py") == [("x.py", "def f():\n\n    return 1\n# c")]


def test_text_decoding():
    assert formats.decode("﻿é".encode()) == "é"
    assert formats.decode("é".encode("utf-16")) == "é"
    assert "cin" in formats.decode("Médecin à la forêt élève".encode("cp1252"))
    for bad in (b"PK\3\4", b"a\0b", b"a\x01b"):
        with pytest.raises(UnsupportedFormat):
            formats.decode(bad)
    with pytest.raises(LimitExceeded):
        formats.decode(b"abc", ParserLimits(max_bytes=2))


def test_html():
    page = "<html><head><title>t</title></head><body><h1>Head</h1><p>One <b>two</b><a href='#x'>in</a> <a href='/y'>out</a></p><script>no</script><ul><li>a</li><li>b</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>x|y</td></tr></table></body></html>"
    ((title, content),) = rows(page, "p.html")
    assert title == "Head" and "One **two**in [out](/y)" in content and "* a\n* b" in content and "| k | v |\n| --- | --- |\n| 1 | x&#124;y |" in content and "no" not in content


def test_csv_and_limits():
    content = 'a,b\r\n"x, y","1\n2"\r\n' + "".join(f"r{i},{i}\r\n" for i in range(80))
    got = rows(content, "t.csv")
    assert len(got) > 1 and all(c.startswith("| a | b |\n| --- | --- |") and len(c) <= 500 for _, c in got) and "| x, y | 1<br>2 |" in got[0][1]
    assert rows("a\tb\n1\t2\n", "t.tsv")[0][1].endswith("| 1 | 2 |")
    with pytest.raises(ParseFailure):
        rows('a,b\n"x"y,1\n', "t.csv")


def test_subtitles():
    assert rows("1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\n\n2\n00:00:03,000 --> 00:00:04,000\nWorld\n", "a.srt") == [("a.srt", "Hello\nWorld")]
    assert rows("WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.000\nHi\n", "a.vtt") == [("a.vtt", "Hi")]
    assert rows("[Events]\nDialogue: 0,0:00,0:01,Default,,0,0,0,,{\\b1}One, two\\Nthree\n", "a.ass") == [("a.ass", "One, two\nthree")]


def test_notebook_calendar_card_and_mail():
    book = {"metadata": {"title": "T"}, "cells": [{"cell_type": "markdown", "source": ["## Sub\n", "text"]}, {"cell_type": "code", "source": "x = 1", "outputs": [{"text": ["out"]}]}]}
    text = formats.extract_text(json.dumps(book).encode(), "n.ipynb", CONTEXT)
    assert text == "# T\n\n## Sub\ntext\n\n```python\nx = 1\n```\n\n```\nout\n```"
    event = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Meet\\, all\r\nLOCATION:Room\r\n  1\r\nBEGIN:VALARM\r\nDESCRIPTION:x\r\nEND:VALARM\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    assert rows(event, "c.ics")[0][0] == "Meet, all" and "Room 1" in rows(event, "c.ics")[0][1]
    assert rows("BEGIN:VCARD\nFN:Ann\nORG:Org;Unit\nTEL;TYPE=cell:1\nEND:VCARD\n", "c.vcf") == [("Ann", "- 单位: Org Unit\n- 电话: 1")]
    mail = "Subject: Hi\nContent-Type: text/plain; charset=utf-8\n\nBody é\n"
    assert rows(mail, "m.eml") == [("Hi", "Body é")]
    box = f"From a@b Mon\n{mail}\nFrom c@d Tue\nSubject: Two\n\nSecond\n"
    assert [t for t, _ in rows(box, "m.mbox")] == ["Hi", "Two"]
    page = 'MIME-Version: 1.0\nContent-Type: multipart/related; boundary="B"; type="text/html"\n\n--B\nContent-Type: text/html\n\n<h1>P</h1><p>q</p>\n--B--\n'
    assert rows(page, "p.mhtml") == [("P", "q")]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
WORD = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
BOOK = {
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><t>value</t></si><si><r><t>me</t></r><r><t>rged</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><f>1+1</f><v>2</v></c></row><row r="3"><c r="B3"><f>X()</f></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>',
}


def test_office_packages():
    assert rows(zipped({"word/document.xml": WORD}), "d.docx")[0] == ("Head", "Text")
    assert "| k |\n| --- |\n| v |" in rows(zipped({"word/document.xml": WORD}), "d.wps")[-1][1]
    assert rows(zipped(BOOK), "b.xlsx") == [("One", "| name | value |\n| --- | --- |\n| merged | 2 |\n| merged | =X() |")]
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Slide</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>body</a:t></a:r></a:p></p:sp></p:sld>'
    assert rows(zipped({"ppt/slides/slide1.xml": slide, "ppt/slides/slide10.xml": slide, "ppt/slides/slide2.xml": slide}), "s.pptx") == [("Slide", "body")] * 3
    odt = '<o:document-content xmlns:o="o" xmlns:t="t" xmlns:b="b"><o:body><o:text><t:h t:outline-level="2">H</t:h><t:p>a<t:s t:c="2"/>b</t:p><b:table><b:table-row b:number-rows-repeated="2"><b:table-cell b:number-columns-repeated="2"><t:p>x</t:p></b:table-cell></b:table-row></b:table></o:text></o:body></o:document-content>'
    text = formats.extract_text(zipped({"content.xml": odt}), "d.odt", CONTEXT)
    assert text.startswith("## H\n\na  b\n\n") and text.count("| x | x |") == 2
    with pytest.raises(UnsupportedFormat):
        rows(b"\xd0\xcf\x11\xe0" + b"x" * 50, "d.doc")


def test_books_maps_and_drawings():
    opf = '<package xmlns="o"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
    epub = zipped({"META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": opf, "o/a.xhtml": "<h1>A</h1><p>1</p>", "o/b.xhtml": "<h1>B</h1><p>2</p>"})
    assert rows(epub, "e.epub") == [("B", "2"), ("A", "1")]
    fb2 = '<FictionBook xmlns="f"><body><section><title><p>One</p></title><p>text</p><section><title><p>Two</p></title><p>more</p></section></section></body><body><p>notes</p></body></FictionBook>'
    assert rows(fb2, "b.fb2") == [("One", "text"), ("One  Two", "more")] == rows(zipped({"b.fb2": fb2}), "b.fb2.zip")
    svg = '<svg xmlns="s"><title>no</title><text>Hello <tspan>there</tspan></text><style>x</style></svg>'
    assert rows(svg, "d.svg") == [("d.svg", "Hello there")] == [("d.svg", c) for _, c in rows(gzip.compress(svg.encode()), "d.svgz")]
    xmind = [{"rootTopic": {"title": "Root", "children": {"attached": [{"title": "Child", "notes": {"plain": {"content": "note"}}}]}}}]
    assert "note" in rows(zipped({"content.json": json.dumps(xmind)}), "m.xmind")[-1][1]
    assert rows(b"{\\rtf1{\\fonttbl{\\f0 Arial;}}Hello \\b bold\\b0\\par caf\\'e9 \\u8364?}", "r.rtf") == [("r.rtf", "Hello bold\ncafé €")]


def test_archives_skip_what_they_cannot_read():
    members = {"a.md": "# A\n\none", "b/c.txt": "two", "inner.zip": zipped({"x.txt": "no"}), "v.mp4": b"x", "bad.docx": b"junk", "__MACOSX/a.txt": "no"}
    assert rows(zipped(members), "z.zip") == [("A", "one"), ("c.txt", "two")]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for name, data in (("ok.txt", b"fine"), ("../evil.txt", b"no"), ("/abs.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    assert rows(out.getvalue(), "t.tar.gz") == [("ok.txt", "fine")]


def test_bounds_and_refusals():
    small = formats.Context(CONTEXT.options, ParserLimits(max_members=1, max_xml_depth=2))
    with pytest.raises(LimitExceeded):
        formats.read(zipped({"a.txt": "1", "b.txt": "2"}), "z.zip", small)
    with pytest.raises(LimitExceeded):
        formats.read(b"<svg><a><b/></a></svg>", "d.svg", small)
    with pytest.raises(ParseFailure):
        rows('<!DOCTYPE x [<!ENTITY a "b">]><svg>&a;</svg>', "d.svg")
    for name in ("v.mp4", "a.rar", "x.pages", "a.pdf", "a.7z", "a.msg", "a.xls"):
        with pytest.raises(SliceError):
            rows(b"%PDF-1.4", name)


def test_dispatch_takes_the_first_claim():
    assert [dispatch.reader_of(n) for n in ("A.HTML", "x.fb2.zip", "x.zip", "x.tar.gz", "none", "x.ts", "x.rar", "x.heic")] == ["html", "fb2", "zip", "tar", "text", "literal", None, "image"]
    assert {".docx", ".tar.xz", ".md"} <= set(dispatch.supported_extensions())


@pytest.mark.parametrize("mark", [b"\0", b"\x01"])
def test_decode_refuses_control_characters_anywhere(mark):
    with pytest.raises(UnsupportedFormat):
        formats.decode(b"a plain line\n" * 10_000 + mark + b"end")
