"""Documents of every format made of titled texts, so that readers can be held against the texts they were made of."""

from __future__ import annotations

import bz2
import gzip
import html
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable
from email.message import EmailMessage

from pyspark.sql import Column

from vellumark.operators.rows import each_row

Parts = list[tuple[str, str]]
_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_LINKS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def zipped(members: list[tuple[str, str | bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members:
            archive.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def tarred(members: list[tuple[str, bytes]], squeeze: Callable[[bytes], bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return squeeze(out.getvalue())


def markdown(head: str, parts: Parts) -> str:
    return "\n\n".join([f"# {head}", *(f"## {t}\n\n{x}" for t, x in parts)])


def page(head: str, parts: Parts) -> str:
    body = "".join(f"<h2>{html.escape(t)}</h2><p>{html.escape(x)}</p>" for t, x in parts)
    return f"<html><head><title>not this</title><style>p{{}}</style></head><body><h1>{html.escape(head)}</h1><script>var no = 1;</script>{body}</body></html>"


def mail(subject: str, text: str, kind: str = "plain") -> EmailMessage:
    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = subject, "a@example.org", "b@example.org"
    message.set_content(text, subtype=kind)
    return message


def _docx(head: str, parts: Parts) -> bytes:
    run = lambda text: "<w:br/>".join(f'<w:t xml:space="preserve">{html.escape(x)}</w:t>' for x in text.split("\n"))
    heading = lambda level, text: f'<w:p><w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr><w:r>{run(text)}</w:r></w:p>'
    body = "".join(heading(2, t) + f"<w:p><w:r>{run(x)}</w:r></w:p>" for t, x in parts)
    return zipped([("word/document.xml", f"<w:document {_WORD}><w:body>{heading(1, head)}{body}</w:body></w:document>")])


def _fonts(head: str, parts: Parts) -> bytes:
    """Headings by bold runs of 36 and 26 points, no styles."""
    run = lambda text, mark="": f"<w:p><w:r>{mark}" + "<w:br/>".join(f'<w:t xml:space="preserve">{html.escape(x)}</w:t>' for x in text.split("\n")) + "</w:r></w:p>"
    bold = lambda half: f'<w:rPr><w:b/><w:sz w:val="{half}"/></w:rPr>'
    return zipped([("word/document.xml", f"<w:document {_WORD}><w:body>{run(head, bold(72))}{''.join(run(t, bold(52)) + run(x) for t, x in parts)}</w:body></w:document>")])


def workbook(sheets: list[tuple[str, list[list[str]]]], merged: str = "") -> bytes:
    """Every third cell is a shared string, every third an inline one, and the others are plain values."""
    shared: list[str] = []
    members, names, links = [], "", ""
    for k, (name, rows) in enumerate(sheets, 1):
        lines = ""
        for r, row in enumerate(rows, 1):
            cells = ""
            for c, value in enumerate(row):
                place, safe = f"{chr(65 + c)}{r}", html.escape(value)
                if (r + c) % 3 == 0:
                    shared.append(safe)
                    cells += f'<c r="{place}" t="s"><v>{len(shared) - 1}</v></c>'
                elif (r + c) % 3 == 1:
                    cells += f'<c r="{place}" t="inlineStr"><is><t>{safe}</t></is></c>'
                else:
                    cells += f'<c r="{place}" t="str"><f>X{r}</f><v>{safe}</v></c>'
            lines += f'<row r="{r}">{cells}</row>'
        span = f'<mergeCells><mergeCell ref="{merged}"/></mergeCells>' if merged else ""
        members.append((f"xl/worksheets/sheet{k}.xml", f"<worksheet {_SHEET}><sheetData>{lines}</sheetData>{span}</worksheet>"))
        names += f'<sheet name="{html.escape(name)}" sheetId="{k}" r:id="r{k}"/>'
        links += f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>'
    strings = "".join(f"<si><t>{x}</t></si>" for x in shared)
    return zipped([("xl/workbook.xml", f"<workbook {_SHEET}><sheets>{names}</sheets></workbook>"), ("xl/_rels/workbook.xml.rels", f"<Relationships {_LINKS}>{links}</Relationships>"), ("xl/sharedStrings.xml", f"<sst {_SHEET}>{strings}</sst>"), *members])


def _pptx(head: str, parts: Parts) -> bytes:
    paragraphs = lambda text: "".join(f"<a:p><a:r><a:t>{html.escape(x)}</a:t></a:r></a:p>" for x in text.split("\n"))
    slide = lambda t, x: f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr>{paragraphs(t)}</p:sp><p:sp>{paragraphs(x)}</p:sp></p:sld>'
    note = lambda x: f'<p:notes xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="body"/></p:nvPr>{paragraphs(x)}</p:sp></p:notes>'
    slides = [(f"ppt/slides/slide{k}.xml", slide(t, x)) for k, (t, x) in enumerate(parts, 1)]
    return zipped([*reversed(slides), *((f"ppt/notesSlides/notesSlide{k}.xml", note(f"{head} {t}")) for k, (t, _) in enumerate(parts, 1))])


def _rtf(head: str, parts: Parts) -> bytes:
    def code(c: str) -> str:
        return c if " " <= c <= "~" and c not in "\\{}" else f"\\'{c.encode('cp1252').hex()}" if c in "\xe9\xe8\xe0\xfc\xf6\xe4\xdf" else f"\\u{ord(c)}?" if c != "\n" else "\\par "

    text = lambda x: "".join(map(code, x))
    return ("{\\rtf1{\\fonttbl{\\f0 Arial;}}{\\*\\generator no;}" + "\\par ".join([f"\\b {text(head)}\\b0", *(f"{text(t)}\\par {text(x)}" for t, x in parts)]) + "}").encode("latin-1")


def _odt(head: str, parts: Parts) -> str:
    text = lambda x: html.escape(x).replace("\n", "<t:line-break/>")
    return '<o:document-content xmlns:o="o" xmlns:t="t"><o:body><o:text>' + f'<t:h t:outline-level="1">{text(head)}</t:h>' + "".join(f'<t:h t:outline-level="2">{text(t)}</t:h><t:p>{text(x)}</t:p>' for t, x in parts) + "</o:text></o:body></o:document-content>"


def _epub(head: str, parts: Parts) -> bytes:
    chapter = lambda t, x: f"<html><body><h1>{html.escape(t)}</h1><p>{html.escape(x)}</p></body></html>"
    items = "".join(f'<item id="i{k}" href="text/c{k}.xhtml"/>' for k in range(len(parts)))
    order = "".join(f'<itemref idref="i{k}"/>' for k in reversed(range(len(parts))))
    opf = f'<package xmlns="o"><manifest>{items}</manifest><spine>{order}</spine></package>'
    return zipped([("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="book/p.opf"/></rootfiles></container>'), ("book/p.opf", opf), *((f"book/text/c{k}.xhtml", chapter(t, x)) for k, (t, x) in enumerate(parts))])


def _fb2(head: str, parts: Parts) -> str:
    inner = "".join(f"<section><title><p>{html.escape(t)}</p></title><p>{html.escape(x)}</p></section>" for t, x in parts)
    return f'<FictionBook xmlns="f"><body><section><title><p>{html.escape(head)}</p></title>{inner}</section></body><body><p>notes</p></body></FictionBook>'


def _xmind(head: str, parts: Parts) -> bytes:
    topic = {"title": head, "children": {"attached": [{"title": t, "notes": {"plain": {"content": x}}} for t, x in parts]}}
    return zipped([("content.json", json.dumps([{"rootTopic": topic}]))])


def _xmind_xml(head: str, parts: Parts) -> bytes:
    topics = "".join(f"<topic><title>{html.escape(t)}</title><notes><plain>{html.escape(x)}</plain></notes></topic>" for t, x in parts)
    return zipped([("content.xml", f'<xmap-content xmlns="x"><sheet><topic><title>{html.escape(head)}</title><children><topics type="attached">{topics}</topics></children></topic></sheet></xmap-content>')])


def _mhtml(head: str, parts: Parts) -> bytes:
    message = EmailMessage()
    message["MIME-Version"] = "1.0"
    message.add_header("Content-Type", "multipart/related", start="<root>")
    for cid, text in (("other", "<h1>other</h1><p>not the start</p>"), ("root", page(head, parts))):
        part = EmailMessage()
        part.set_content(text, subtype="html")
        part["Content-ID"] = f"<{cid}>"
        message.attach(part)
    return message.as_bytes()


def _ipynb(head: str, parts: Parts) -> str:
    cells = [{"cell_type": "markdown", "source": [f"## {t}\n", "\n", *x.splitlines(True)]} for t, x in parts]
    return json.dumps({"metadata": {"title": head}, "cells": cells})


def _ics(head: str, parts: Parts) -> str:
    put = lambda x: x.replace("\\", "\\\\").replace(",", "\\,").replace(";", "\\;").replace("\n", "\\n")

    def fold(line: str) -> str:
        return "\r\n ".join(line[k : k + 60] for k in range(0, len(line), 60))

    events = "".join("BEGIN:VEVENT\r\n" + fold(f"SUMMARY:{put(t)}") + "\r\n" + fold(f"DESCRIPTION;LANGUAGE=xx:{put(x)}") + f"\r\nLOCATION:{put(head)}\r\nBEGIN:VALARM\r\nDESCRIPTION:no\r\nEND:VALARM\r\nEND:VEVENT\r\n" for t, x in parts)
    return f"BEGIN:VCALENDAR\r\n{events}END:VCALENDAR\r\n"


def _ass(head: str, parts: Parts) -> str:
    return "[Script Info]\nTitle: no\n[Events]\n" + "".join(f"Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{{\\b1}}{t}: " + x.replace("\n", "\\N") + "\n" for t, x in parts)


def _vtt(head: str, parts: Parts) -> str:
    return "WEBVTT\n\nNOTE no\n\n" + "\n\n".join(f"{k}\n00:01.000 --> 00:02.000\n<v {t}>{x}" for k, (t, x) in enumerate(parts))


def _svg(head: str, parts: Parts) -> str:
    return f'<svg xmlns="s"><title>no</title><style>x</style><text>{html.escape(head)}</text>' + "".join(f"<g><desc>no</desc><text>{html.escape(t)} <tspan>{html.escape(x)}</tspan></text></g>" for t, x in parts) + "</svg>"


def _pages_of(parts: Parts) -> list[tuple[str, bytes]]:
    return [(f"{k:03d}.md", f"# {t}\n\n{x}".encode()) for k, (t, x) in enumerate(parts)]


#: By kind: the ending of the name, and the bytes of a head and its titled texts.
KINDS: dict[str, tuple[str, Callable[[str, Parts], str | bytes]]] = {
    "md": (".md", markdown),
    "utf16": (".txt", lambda h, p: markdown(h, p).encode("utf-16")),
    "latin": (".txt", lambda h, p: b"\xef\xbb\xbf" + markdown(h, p).replace("\n", "\r\n").encode()),
    "literal": (".py", markdown),
    "html": (".html", page),
    "mhtml": (".mhtml", _mhtml),
    "docx": (".docx", _docx),
    "docx_fonts": (".docm", _fonts),
    "wps": (".wps", _docx),
    "xlsx": (".xlsx", lambda h, p: workbook([(h, [["role", "text"], *map(list, p)])])),
    "et": (".et", lambda h, p: workbook([("Sheet1", [["role", "text"], *map(list, p)])])),
    "fb2": (".fb2", _fb2),
    "fb2zip": (".fb2.zip", lambda h, p: zipped([("b.fb2", _fb2(h, p))])),
    "zip": (".zip", lambda h, p: zipped([*_pages_of(p), ("v.mp4", b"x"), ("bad.docx", b"junk"), ("__MACOSX/a.txt", "no"), ("in.zip", zipped([("x.txt", "no")]))])),
    "tar": (".tar", lambda h, p: tarred([("../evil.md", b"no"), *_pages_of(p), ("/abs.md", b"no")], lambda b: b)),
    "targz": (".tar.gz", lambda h, p: tarred([("../evil.md", b"no"), *_pages_of(p)], gzip.compress)),
    "tarbz2": (".tar.bz2", lambda h, p: tarred(_pages_of(p), bz2.compress)),
    "xmind": (".xmind", _xmind),
    "xmind_xml": (".xmind", _xmind_xml),
    "pptx": (".pptx", _pptx),
    "rtf": (".rtf", _rtf),
    "odt": (".odt", lambda h, p: zipped([("content.xml", _odt(h, p))])),
    "fodt": (".fodt", _odt),
    "epub": (".epub", _epub),
    "eml": (".eml", lambda h, p: mail(h, "\n".join(x for _, x in p)).as_bytes()),
    "mbox": (".mbox", lambda h, p: b"".join(b"From a@example.org Mon Jan 1 00:00:00 2024\n" + re.sub(rb"(?m)^(>*From )", rb">\1", mail(t, x).as_bytes()) + b"\n" for t, x in p)),
    "svg": (".svg", _svg),
    "svgz": (".svgz", lambda h, p: gzip.compress(_svg(h, p).encode())),
    "ipynb": (".ipynb", _ipynb),
    "ass": (".ass", _ass),
    "vtt": (".vtt", _vtt),
    "ics": (".ics", _ics),
    "qa_md": (".md", lambda h, p: f"## {h}\n\n| Title | Content | Question |\n| --- | --- | --- |\n" + "".join(f"| {t} | {x.replace(chr(10), '<br>')} | {x.replace(chr(10), '<br>')} |\n" for t, x in p)),
    "qa_zip": (".zip", lambda h, p: zipped([("q.xlsx", workbook([(h, [["Title", "Content", "Question"], *([t, x, x] for t, x in p)])])), ("no.txt", "no")])),
    "qa_csv": (".csv", lambda h, p: "Title,Content,Question\n" + "".join(f'{t},"{x}","{x}"\n' for t, x in p)),
}


def document_column(kind: str, head: Column, titles: Column, texts: Column) -> Column:
    """The bytes of one document for each row."""
    make = KINDS[kind][1]

    def document(head: str, titles: list[str], texts: list[str]) -> bytes:
        made = make(head, list(zip(titles, texts, strict=True)))
        return made if isinstance(made, bytes) else made.encode()

    return each_row(document, "binary", head, titles, texts)
