"""Readers: bytes of one document to named groups of paragraphs. Standard library only; others are optional imports.

Every reader takes (content, name, Context) and returns groups. A group is a name and either text, to be cut along its
headings, or finished paragraphs. Bounds of ParserLimits hold everywhere; markup with a document type is refused.
"""

from __future__ import annotations

import bz2
import csv
import email
import email.policy
import gzip
import importlib
import io
import json
import lzma
import os
import posixpath
import re
import shutil
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

from vellumark.errors import LimitExceeded, ParseFailure, SliceError, UnsupportedFormat
from vellumark.operators import kernels
from vellumark.options import ParserLimits, SliceOptions
from vellumark.sources import pdf
from vellumark.sources.dispatch import reader_of


@dataclass(frozen=True)
class Context:
    options: SliceOptions = field(default_factory=lambda: SliceOptions().resolved())
    limits: ParserLimits = field(default_factory=ParserLimits)
    depth: int = 0
    recognise: Callable[[bytes, str], str] | None = None


@dataclass
class Group:
    name: str
    text: str = ""
    rows: list[tuple[str, str]] | None = None
    patterns: tuple[str, ...] | None = None
    literal: bool = False


def decode(content: bytes, limits: ParserLimits | None = None) -> str:
    """Text of bytes: by byte order mark, as UTF-8, or by detection; refuses what holds control characters."""
    if limits and len(content) > limits.max_bytes:
        raise LimitExceeded(f"{len(content)} bytes")
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    if content[:4] in (b"PK\3\4", b"%PDF", b"\x89PNG", b"\xd0\xcf\x11\xe0") or content[:3] in (b"\xff\xd8\xff", b"GIF") or b"\0" in content:
        raise UnsupportedFormat("binary content")
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = _detected(content)
    if re.search(r"[\x01-\x08\x0e-\x1a\x1c-\x1f]", text):
        raise UnsupportedFormat("control characters")
    return text


def _detected(content: bytes) -> str:
    try:
        best = importlib.import_module("charset_normalizer").from_bytes(content[: 1 << 20]).best()
    except ImportError:
        best = None
    name = best.encoding if best is not None and not best.encoding.startswith(("utf_16", "utf_32")) else "cp1252"
    return content.decode(name, "replace")


def xml(content: bytes, limits: ParserLimits) -> ET.Element:
    if len(content) > limits.max_xml_bytes:
        raise LimitExceeded(f"{len(content)} bytes of XML")
    if b"<!DOCTYPE" in content[:4096] or b"<!ENTITY" in content:
        raise ParseFailure("XML with a document type")
    depth = count = 0
    root = None
    try:
        for event, element in ET.iterparse(io.BytesIO(content), events=("start", "end")):
            if event == "start":
                root = element if root is None else root
                depth, count = depth + 1, count + 1
                if depth > limits.max_xml_depth or count > limits.max_xml_elements:
                    raise LimitExceeded("XML too deep or too large")
            else:
                depth -= 1
    except ET.ParseError as error:
        raise ParseFailure(str(error)) from error
    return root


def local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def attribute(element: ET.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def children(element: ET.Element, *names: str) -> list[ET.Element]:
    return [e for e in element if local(e) in names]


def descendants(element: ET.Element, *names: str) -> list[ET.Element]:
    return [e for e in element.iter() if local(e) in names]


def package(content: bytes, limits: ParserLimits) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as error:
        raise ParseFailure(str(error)) from error
    members = archive.infolist()
    if len(members) > limits.max_members or sum(m.file_size for m in members) > limits.max_member_bytes:
        raise LimitExceeded("archive too large")
    if len({m.filename for m in members}) != len(members):
        raise ParseFailure("duplicate member names")
    if any(m.flag_bits & 1 for m in members):
        raise ParseFailure("encrypted archive")
    return archive


def member(archive: zipfile.ZipFile, name: str) -> bytes:
    try:
        return archive.read(name)
    except (KeyError, zlib.error, zipfile.BadZipFile) as error:
        raise ParseFailure(f"no member {name}") from error


class _Markdown(HTMLParser):
    """HTML to markdown: headings, lists, quotes, tables, code, links, images and emphasis."""

    _SKIP = {"script", "style", "iframe", "object", "embed", "noscript", "template", "head"}
    _BREAK = set("p div section article header footer main aside nav ul ol table form fieldset figure figcaption address dl dt dd hr body html".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.lists: list[list] = []
        self.links: list[str | None] = []
        self.row: list[str] | None = None
        self.rows = 0

    def blank(self) -> None:
        if self.row is None:
            self.out.append("\n\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in self._SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.blank()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag == "br":
            self.out.append("<br>" if self.row is not None else "\n")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "a":
            href = given.get("href")
            self.links.append(None if not href or href.startswith("#") else href)
            if self.links[-1]:
                self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{given.get('alt') or ''}]({given.get('src') or ''})")
        elif tag == "table":
            self.blank()
            self.rows = 0
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(str(len(self.out)))
        elif tag in self._BREAK:
            self.blank()

    def handle_endtag(self, tag: str) -> None:
        if tag in self._SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag) or (tag in self._BREAK and tag not in ("ul", "ol", "table")):
            self.blank()
        elif tag in ("ul", "ol"):
            self.lists = self.lists[:-1]
            self.out.append("\n" if self.lists else "\n\n")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "blockquote":
            self.out.append("\n\n")
        elif tag == "a" and self.links:
            href = self.links.pop()
            if href:
                self.out.append(f"]({href})")
        elif tag == "tr" and self.row is not None:
            edges = [*map(int, self.row), len(self.out)]
            cells = [re.sub(r"\s+", " ", "".join(self.out[a:b])).strip().replace("|", "&#124;") for a, b in zip(edges, edges[1:], strict=False)]
            if self.row:
                del self.out[edges[0] :]
            self.row = None
            if cells:
                self.out.append(f"| {' | '.join(cells)} |\n")
                if not self.rows:
                    self.out.append(f"| {' | '.join('---' for _ in cells)} |\n")
                self.rows += 1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n +(?=\S)(?![*\d])", "\n", text)).strip()


def html_text(content: bytes) -> str:
    found = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", content[:4096], re.I)
    if found:
        try:
            return content.decode(found[1].decode("ascii"), "replace")
        except LookupError:
            pass
    try:
        return decode(content)
    except SliceError:
        return content.decode("cp1252", "replace")


def read_html(content: bytes, name: str, context: Context) -> list[Group]:
    return [Group(name, html_to_markdown(html_text(content)), patterns=kernels.MARKDOWN[:6])]


def read_mhtml(content: bytes, name: str, context: Context) -> list[Group]:
    message = email.message_from_bytes(content, policy=email.policy.default)
    if message.get_content_type() != "multipart/related":
        raise ParseFailure("not multipart/related")
    parts = list(message.walk())
    if len(parts) > context.limits.max_parts:
        raise LimitExceeded("too many parts")
    start = (message.get_param("start") or "").strip("<>")
    pages = [p for p in parts if p.get_content_type() == "text/html"]
    root = next((p for p in pages if start and (p.get("Content-ID") or "").strip("<>") == start), pages[0] if pages else None)
    if root is None:
        raise ParseFailure("no HTML part")
    return [Group(name, html_to_markdown(_part_text(root)), patterns=kernels.MARKDOWN[:6])]


def _part_text(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return html_text(data)


def mail_text(content: bytes) -> str:
    message = email.message_from_bytes(content, policy=email.policy.default)
    bodies = [p for p in message.walk() if not p.is_multipart() and p.get_content_disposition() != "attachment"]
    plain = next((p for p in bodies if p.get_content_type() == "text/plain"), None)
    page = next((p for p in bodies if p.get_content_type() == "text/html"), None)
    body = _part_text(plain) if plain is not None else html_to_markdown(_part_text(page)) if page is not None else ""
    return f"# {(str(message.get('Subject') or '')).strip() or '(无主题)'}\n\n{body.strip()}"


def read_eml(content: bytes, name: str, context: Context) -> list[Group]:
    return [Group(name, mail_text(content))]


def read_mbox(content: bytes, name: str, context: Context) -> list[Group]:
    if not content.startswith(b"From "):
        raise UnsupportedFormat("not a mailbox")
    parts = re.split(rb"(?m)^From [^\n]*\n", content.replace(b"\r\n", b"\n"))[1:]
    return [Group(name, mail_text(re.sub(rb"(?m)^>(>*From )", rb"\1", p))) for p in parts]


def read_csv(content: bytes, name: str, context: Context) -> list[Group]:
    text = decode(content, context.limits)
    mark = "," if name.lower().endswith(".csv") else "\t"
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=mark, strict=True) if any(c.strip() for c in r)]
    return [Group(name, rows=_packed(rows, context.options.limit, False))]


def _packed(rows: list[list[str]], limit: int, resplit: bool) -> list[tuple[str, str]]:
    if not rows:
        return []
    cell = lambda c: re.sub("\r\n|\r|\n", "<br>", c).replace("|", "&#124;")
    line = lambda r: f"| {' | '.join(map(cell, r))} |\n"
    header = line(rows[0]) + f"| {' | '.join('---' for _ in rows[0])} |\n"
    return [("", p) for p in kernels.pack_rows(header, map(line, rows[1:]), limit, resplit)]


def sheets(content: bytes, limits: ParserLimits) -> list[tuple[str, list[list[str]]]]:
    """(sheet name, rows) of an OOXML workbook: cached values of formulas first, merged ranges filled with their first cell."""
    archive = package(content, limits)
    names = archive.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in descendants(item, "t")) for item in children(xml(member(archive, "xl/sharedStrings.xml"), limits), "si")]
    links = {attribute(r, "Id"): attribute(r, "Target") for r in xml(member(archive, "xl/_rels/workbook.xml.rels"), limits)}
    out = []
    for sheet in descendants(xml(member(archive, "xl/workbook.xml"), limits), "sheet"):
        target = links.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), "") or ""
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        root = xml(member(archive, path), limits)
        cells: dict[tuple[int, int], str] = {}
        for c in descendants(root, "c"):
            r, k = _place(attribute(c, "r") or "A1")
            value = next((v.text or "" for v in children(c, "v")), None)
            kind = attribute(c, "t")
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in descendants(c, "t"))
            elif kind == "b" and value is not None:
                value = "True" if value == "1" else "False"
            if value is None:
                value = next(("=" + (f.text or "") for f in children(c, "f")), None)
            if value is not None:
                cells[r, k] = value
        if len(cells) > limits.max_cells:
            raise LimitExceeded("too many cells")
        for m in descendants(root, "mergeCell"):
            a, _, b = (attribute(m, "ref") or "A1").partition(":")
            (r1, k1), (r2, k2) = _place(a), _place(b or a)
            if (r2 - r1 + 1) * (k2 - k1 + 1) > limits.max_cells:
                raise LimitExceeded("merged range too large")
            lead = cells.get((r1, k1), "")
            cells |= {(r, k): lead for r in range(r1, r2 + 1) for k in range(k1, k2 + 1)}
        width = max((k for _, k in cells), default=-1) + 1
        rows = [[cells.get((r, k), "") for k in range(width)] for r in sorted({r for r, _ in cells})]
        out.append((attribute(sheet, "name") or "", [r for r in rows if any(x.strip() for x in r)]))
    return out


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def read_xlsx(content: bytes, name: str, context: Context) -> list[Group]:
    found = sheets(content, context.limits)
    stem = name.rpartition(".")[0] or name
    return [Group(stem if len(found) == 1 and title == "Sheet1" else title, rows=_packed(rows, context.options.limit, True)) for title, rows in found]


def read_docx(content: bytes, name: str, context: Context) -> list[Group]:
    if content[:4] == b"\xd0\xcf\x11\xe0":
        raise UnsupportedFormat("old Word file")
    archive = package(content, context.limits)
    body = next(iter(descendants(xml(member(archive, "word/document.xml"), context.limits), "body")), None)
    parts = []
    for element in [] if body is None else body:
        if local(element) == "p":
            parts.append(_word_paragraph(element))
        elif local(element) == "tbl":
            rows = [[" ".join(filter(None, (_word_text(p) for p in descendants(c, "p")))) for c in children(r, "tc")] for r in children(element, "tr")]
            parts += [c for _, c in _packed([r for r in rows if r], 1 << 30, False)]
    return [Group(name, "\n\n".join(p for p in parts if p.strip()))]


def _word_text(paragraph: ET.Element) -> str:
    return "".join(e.text or "" if local(e) == "t" else "\t" if local(e) == "tab" else "\n" for e in descendants(paragraph, "t", "tab", "br"))


def _word_paragraph(paragraph: ET.Element) -> str:
    text = _word_text(paragraph).strip()
    style = next((attribute(s, "val") or "" for s in descendants(paragraph, "pStyle")), "")
    found = re.search(r"(?:heading|标题)\s*(\d)", style, re.I)
    level = min(int(found[1]), 6) if found else 1 if style.lower() == "title" else 0
    if not level and text:
        run = next(iter(descendants(paragraph, "r")), None)
        if run is not None and descendants(run, "b"):
            half = next((attribute(s, "val") for s in descendants(run, "sz")), None)
            size = int(half) / 2 if half and half.isdigit() else 0
            level = next((lv for edge, lv in ((36, 1), (26, 2), (24, 3), (22, 4), (18, 5), (16, 6)) if size >= edge), 0)
    return f"{'#' * level} {text}" if level and text else text


def read_pptx(content: bytes, name: str, context: Context) -> list[Group]:
    archive = package(content, context.limits)
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
    out = []
    for k, path in enumerate(slides, 1):
        root, title, texts = xml(member(archive, path), context.limits), "", []
        for shape in descendants(root, "sp", "tbl"):
            if local(shape) == "tbl":
                texts += [c for _, c in _packed([["".join(t.text or "" for t in descendants(c, "t")) for c in children(r, "tc")] for r in children(shape, "tr")], 1 << 30, False)]
                continue
            lines = "\n".join("".join(t.text or "" for t in descendants(p, "t")) for p in descendants(shape, "p")).strip()
            if not title and any(attribute(p, "type") in ("title", "ctrTitle") for p in descendants(shape, "ph")):
                title = lines.replace("\n", " ")
            elif lines:
                texts.append(lines)
        notes = f"ppt/notesSlides/notesSlide{number(path)}.xml"
        if notes in archive.namelist():
            said = " ".join("".join(t.text or "" for t in descendants(s, "t")).strip() for s in descendants(xml(member(archive, notes), context.limits), "sp") if any(attribute(p, "type") == "body" for p in descendants(s, "ph"))).strip()
            if said:
                texts.append(f"备注：{said}")
        out.append(f"# {title or f'第{k}页'}\n\n" + "\n\n".join(texts))
    return [Group(name, "\n\n".join(out))]


def read_wps(content: bytes, name: str, context: Context) -> list[Group]:
    if content[:4] != b"PK\3\4":
        raise UnsupportedFormat("old office file")
    return (read_xlsx if name.lower().endswith(".et") else read_docx)(content, name, context)


def read_ppt(content: bytes, name: str, context: Context) -> list[Group]:
    if content[:4] == b"PK\3\4":
        return read_pptx(content, name, context)
    ole = _optional("olefile", name)
    with ole.OleFileIO(io.BytesIO(content)) as file:
        data = file.openstream("PowerPoint Document").read()
    texts, at = [], 0
    while at + 8 <= len(data):
        kind, size = int.from_bytes(data[at + 2 : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        if kind in (0x0FA0, 0x0FA8, 0x0FBA):
            text = data[at + 8 : at + 8 + size].decode("cp1252" if kind == 0x0FA8 else "utf-16-le", "replace").replace("\r", "\n").strip()
            if text and (not texts or texts[-1] != text):
                texts.append(text)
        at += 8 if data[at] & 15 == 15 else 8 + size
    return [Group(name, "\n\n".join(texts))]


_RTF = re.compile(r"\\'([0-9a-f]{2})|\\u(-?\d+) ?.?|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I | re.S)


def read_rtf(content: bytes, name: str, context: Context) -> list[Group]:
    if not content.startswith(b"{\\rtf"):
        raise UnsupportedFormat("not RTF")
    out, stack, skip = [], [], False
    for m in _RTF.finditer(content.decode("latin-1")):
        code, point, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or (word or "").lower() in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator"):
            skip = True
        elif not skip:
            if code:
                out.append(bytes.fromhex(code).decode("cp1252", "replace"))
            elif point:
                out.append(chr(int(point) % 65536))
            elif word:
                out.append({"par": "\n", "line": "\n", "tab": "\t", "page": "\n"}.get(word.lower(), ""))
            elif sign:
                out.append(sign if sign in "{}\\" else {"~": " "}.get(sign, ""))
            elif plain:
                out.append(plain)
    return [Group(name, "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))]


def read_odf(content: bytes, name: str, context: Context) -> list[Group]:
    flat = not content.startswith(b"PK\3\4")
    root = xml(content if flat else member(package(content, context.limits), "content.xml"), context.limits)
    most = context.limits.max_repeat
    out: list[str] = []

    def text_of(e: ET.Element) -> str:
        parts = [e.text or ""]
        for c in e:
            kind = local(c)
            parts.append(" " * min(int(attribute(c, "c") or 1), most) if kind == "s" else "\t" if kind == "tab" else "\n" if kind == "line-break" else text_of(c))
            parts.append(c.tail or "")
        return "".join(parts)

    def cell_text(c: ET.Element) -> str:
        said = "\n".join(text_of(p) for p in children(c, "p"))
        return said or next((v for k in ("string-value", "date-value", "time-value", "boolean-value", "value") if (v := attribute(c, k))), "")

    def walk(e: ET.Element) -> None:
        for c in e:
            kind = local(c)
            if kind == "h":
                out.append("#" * min(int(attribute(c, "outline-level") or 1), 6) + " " + text_of(c).strip())
            elif kind == "p":
                out.append(text_of(c).strip())
            elif kind == "table":
                rows = []
                for r in descendants(c, "table-row"):
                    cells: list[str] = []
                    for x in children(r, "table-cell", "covered-table-cell"):
                        times = int(attribute(x, "number-columns-repeated") or 1)
                        value = cell_text(x)
                        cells += [value] * (min(times, most) if value else min(times, 1))
                    if any(v.strip() for v in cells):
                        rows += [cells] * min(int(attribute(r, "number-rows-repeated") or 1), most)
                out.extend(c2.rstrip("\n") for _, c2 in _packed(rows, 1 << 30, False))
            else:
                walk(c)

    for body in descendants(root, "body")[:1]:
        walk(body)
    return [Group(name, "\n\n".join(x for x in out if x))]


def read_epub(content: bytes, name: str, context: Context) -> list[Group]:
    archive = package(content, context.limits)
    holder = xml(member(archive, "META-INF/container.xml"), context.limits)
    path = next((attribute(r, "full-path") for r in descendants(holder, "rootfile")), None)
    if not path:
        raise ParseFailure("no package document")
    root = xml(member(archive, path), context.limits)
    items = {attribute(i, "id"): attribute(i, "href") for i in descendants(root, "item")}
    texts = []
    for ref in descendants(root, "itemref"):
        href = items.get(attribute(ref, "idref"))
        at = posixpath.normpath(posixpath.join(posixpath.dirname(path), href)) if href else None
        if at and at in archive.namelist():
            texts.append(html_to_markdown(html_text(member(archive, at))))
    return [Group(name, "\n\n".join(t for t in texts if t))]


def read_fb2(content: bytes, name: str, context: Context) -> list[Group]:
    if content.startswith(b"PK\3\4"):
        archive = package(content, context.limits)
        content = member(archive, next((n for n in archive.namelist() if n.lower().endswith(".fb2")), ""))
    out: list[str] = []

    def walk(section: ET.Element, depth: int) -> None:
        for e in section:
            kind, text = local(e), re.sub(r"\s+", " ", "".join(e.itertext())).strip()
            if kind == "title":
                out.append("#" * min(max(depth, 1), 6) + " " + text)
            elif kind == "section":
                walk(e, depth + 1)
            elif kind != "image" and text:
                out.append(text)

    for body in descendants(xml(content, context.limits), "body")[:1]:
        walk(body, 0)
    return [Group(name, "\n\n".join(out))]


def read_svg(content: bytes, name: str, context: Context) -> list[Group]:
    if content[:2] == b"\x1f\x8b":
        content = gzip.GzipFile(fileobj=io.BytesIO(content)).read(context.limits.max_xml_bytes + 1)
    words: list[str] = []

    def walk(e: ET.Element) -> None:
        if local(e) in ("script", "style", "defs", "metadata", "title", "desc"):
            return
        words.append(e.text or "")
        for c in e:
            walk(c)
            words.append(c.tail or "")

    walk(xml(content, context.limits))
    return [Group(name, " ".join(" ".join(words).split()))]


def read_ipynb(content: bytes, name: str, context: Context) -> list[Group]:
    try:
        book = json.loads(decode(content, context.limits))
    except ValueError as error:
        raise ParseFailure(str(error)) from error
    whole = lambda s: "".join(s) if isinstance(s, list) else str(s or "")
    title = (book.get("metadata") or {}).get("title")
    out = [f"# {title}"] if title else []
    for cell in book.get("cells") or []:
        source = whole(cell.get("source"))
        out.append(source if cell.get("cell_type") == "markdown" else f"```python\n{source}\n```")
        for output in cell.get("outputs") or []:
            said = whole(output.get("text") or (output.get("data") or {}).get("text/plain"))
            if said:
                out.append(f"```\n{said}\n```")
    return [Group(name, "\n\n".join(x for x in out if x.strip()))]


def read_subtitle(content: bytes, name: str, context: Context) -> list[Group]:
    out = []
    styled = name.lower().endswith((".ass", ".ssa"))
    for line in decode(content, context.limits).replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if styled:
            if not line.startswith("Dialogue:"):
                continue
            line = (line.partition(":")[2].split(",", 9) + [""] * 10)[9].replace("\\N", "\n").replace("\\n", "\n")
        elif re.search(r"-->|^\s*\d+\s*$|^WEBVTT|^NOTE\b", line.lstrip("﻿")):
            continue
        line = re.sub(r"<[^>]*>|\{[^}]*\}", "", line).strip()
        if line:
            out.append(line)
    return [Group(name, "\n".join(out))]


def _content_lines(content: bytes, context: Context) -> list[tuple[str, str]]:
    text = re.sub(r"\n[ \t]", "", decode(content, context.limits).replace("\r\n", "\n").replace("\r", "\n"))
    out = []
    for line in text.split("\n"):
        head, mark, value = line.partition(":")
        if mark:
            for a, b in (("\\n", "\n"), ("\\N", "\n"), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
                value = value.replace(a, b)
            out.append((head.split(";")[0].rpartition(".")[2].upper(), value.strip()))
    return out


_EVENT = {"DTSTART": "开始", "DTEND": "结束", "DUE": "截止", "LOCATION": "地点", "ORGANIZER": "组织者", "ATTENDEE": "参与者", "STATUS": "状态", "DESCRIPTION": "描述"}
_CARD = {"ORG": "单位", "TITLE": "职位", "TEL": "电话", "EMAIL": "邮箱", "ADR": "地址", "URL": "网址", "BDAY": "生日", "NOTE": "备注"}


def read_ics(content: bytes, name: str, context: Context) -> list[Group]:
    if b"BEGIN:VCALENDAR" not in content:
        raise UnsupportedFormat("not a calendar")
    out, now, inner = [], None, 0
    for key, value in _content_lines(content, context):
        if key == "BEGIN" and value in ("VEVENT", "VTODO", "VJOURNAL"):
            now = {}
        elif key == "END" and now is not None and value in ("VEVENT", "VTODO", "VJOURNAL"):
            rows = [f"- {label}: {v}" for k, label in _EVENT.items() for v in now.get(k, [])]
            out.append(f"# {(now.get('SUMMARY') or ['(无标题)'])[0]}\n\n" + "\n".join(rows))
            now = None
        elif key in ("BEGIN", "END"):
            inner += 1 if key == "BEGIN" else -1
        elif now is not None and inner <= 1:
            now.setdefault(key, []).append(value)
    return [Group(name, "\n\n".join(out))]


def read_vcf(content: bytes, name: str, context: Context) -> list[Group]:
    if b"BEGIN:VCARD" not in content:
        raise UnsupportedFormat("not a card")
    out, now = [], {}
    for key, value in _content_lines(content, context):
        if key == "BEGIN":
            now = {}
        elif key == "END":
            parts = [p for p in (now.get("N") or [""])[0].split(";") if p]
            title = (now.get("FN") or [""])[0] or " ".join(parts) or "(无名)"
            rows = [f"- {label}: {' '.join(p for p in v.split(';') if p)}" for k, label in _CARD.items() for v in now.get(k, [])]
            out.append(f"# {title}\n\n" + "\n".join(rows))
        else:
            now.setdefault(key, []).append(value)
    return [Group(name, "\n\n".join(out))]


def read_xmind(content: bytes, name: str, context: Context) -> list[Group]:
    archive = package(content, context.limits)
    out: list[str] = []

    def put(title: str, note: str, depth: int) -> None:
        if title.strip():
            out.append(f"{'#' * (depth + 1)} {title.strip()}\n" if depth < 5 else f"{'  ' * (depth - 5)}- {title.strip()}")
        if note.strip():
            out.append(note.strip() + "\n")

    if "content.json" in archive.namelist():

        def walk(topic: dict, depth: int) -> None:
            put(str(topic.get("title") or ""), str(((topic.get("notes") or {}).get("plain") or {}).get("content") or ""), depth)
            if depth < context.limits.max_xml_depth:
                for kind in ("attached", "detached"):
                    for c in (topic.get("children") or {}).get(kind) or []:
                        walk(c, depth + 1)

        for sheet in json.loads(member(archive, "content.json")):
            walk(sheet.get("rootTopic") or {}, 0)
    else:

        def walk_xml(topic: ET.Element, depth: int) -> None:
            note = "".join("".join(p.itertext()) for n in children(topic, "notes") for p in descendants(n, "plain"))
            put("".join(t.text or "" for t in children(topic, "title")[:1]), note, depth)
            for c in children(topic, "children"):
                for group in children(c, "topics"):
                    for t in children(group, "topic"):
                        walk_xml(t, depth + 1)

        for sheet in descendants(xml(member(archive, "content.xml"), context.limits), "sheet"):
            for topic in children(sheet, "topic"):
                walk_xml(topic, 0)
    return [Group(name, "\n".join(out))]


def _members(found: list[tuple[str, bytes]], context: Context) -> list[Group]:
    """Groups of archive members; one that cannot be read is left out, and archives inside archives are not opened."""
    out: list[Group] = []
    for name, data in found:
        base = posixpath.basename(name)
        if not base or base.startswith(".") or name.startswith("__MACOSX/"):
            continue
        if reader_of(base) in ("zip", "tar", "7z", "xmind", "image", "raster"):
            continue
        try:
            out += read(data, base, replace(context, depth=context.depth + 1))
        except (SliceError, LimitExceeded):
            continue
    return out


def read_zip(content: bytes, name: str, context: Context) -> list[Group]:
    archive = package(content, context.limits)
    return _members([(m.filename if m.flag_bits & 0x800 else _repaired(m.filename), archive.read(m)) for m in archive.infolist() if not m.is_dir()], context)


def _repaired(name: str) -> str:
    """Member names without the UTF-8 flag, read as the code page they were most likely written in."""
    try:
        raw = name.encode("cp437")
    except UnicodeEncodeError:
        return name
    for page in ("utf-8", "gbk"):
        try:
            return raw.decode(page)
        except UnicodeDecodeError:
            continue
    return name


def read_tar(content: bytes, name: str, context: Context) -> list[Group]:
    opened = {b"\x1f\x8b": lambda f: gzip.GzipFile(fileobj=f), b"BZ": bz2.BZ2File, b"\xfd7": lzma.LZMAFile}.get(content[:2])
    found, total = [], 0
    try:
        with tarfile.open(fileobj=opened(io.BytesIO(content)) if opened else io.BytesIO(content), mode="r|") as archive:
            for m in archive:
                if not m.isfile() or m.name.startswith("/") or ".." in m.name.split("/"):
                    continue
                total += m.size
                if total > context.limits.max_member_bytes or len(found) >= context.limits.max_members:
                    raise LimitExceeded("archive too large")
                found.append((m.name, archive.extractfile(m).read()))
    except (tarfile.TarError, OSError, EOFError, lzma.LZMAError) as error:
        raise ParseFailure(str(error)) from error
    return _members(found, context)


def read_image(content: bytes, name: str, context: Context) -> list[Group]:
    text = (context.recognise(content, name) if context.recognise else "") or name
    return [Group(name, rows=[(text[:256], text)])]


def read_text(content: bytes, name: str, context: Context) -> list[Group]:
    return [Group(name, decode(content, context.limits))]


def read_literal(content: bytes, name: str, context: Context) -> list[Group]:
    if name.lower().endswith(".ts") and len(content) >= 376 and content[0] == content[188] == content[376 if len(content) > 376 else 188] == 0x47:
        raise UnsupportedFormat("MPEG transport stream")
    return [Group(name, decode(content, context.limits), literal=True)]


def _optional(module: str, name: str):
    try:
        return importlib.import_module(module)
    except ImportError as error:
        raise UnsupportedFormat(f"{name} needs the package {module}") from error


def read_pdf(content: bytes, name: str, context: Context) -> list[Group]:
    document = pdf.open_document(content, name)
    found = pdf.paragraphs(document, context.options)
    return [Group(name, pdf.font_text(document)) if found is None else Group(name, rows=found)]


def read_xls(content: bytes, name: str, context: Context) -> list[Group]:
    book = _optional("xlrd", name).open_workbook(file_contents=content)
    return [Group(s.name, rows=_packed(old_rows(s), context.options.limit, True)) for s in book.sheets()]


def old_rows(sheet) -> list[list[str]]:
    """Rows of a sheet of an old workbook, merged ranges filled with their first cell."""
    rows = [[str(c) for c in sheet.row_values(r)] for r in range(sheet.nrows)]
    for top, bottom, left, right in getattr(sheet, "merged_cells", ()):
        for r in range(top, min(bottom, len(rows))):
            for c in range(left, min(right, len(rows[r]))):
                rows[r][c] = rows[top][left]
    return [r for r in rows if any(x.strip() for x in r)]


def read_msg(content: bytes, name: str, context: Context) -> list[Group]:
    message = _optional("extract_msg", name).Message(io.BytesIO(content))
    page = getattr(message, "htmlBody", None)
    body = message.body or (html_to_markdown(html_text(page if isinstance(page, bytes) else str(page).encode())) if page else "")
    return [Group(name, f"# {message.subject or '(无主题)'}\n\n{body}")]


def read_7z(content: bytes, name: str, context: Context) -> list[Group]:
    with _optional("py7zr", name).SevenZipFile(io.BytesIO(content)) as archive:
        return _members([(k, v.read()) for k, v in (archive.readall() or {}).items()], context)


def read_mobi(content: bytes, name: str, context: Context) -> list[Group]:
    """The package unpacks to a folder of this worker's own, which is read at once and removed."""
    unpack = _optional("mobi", name).extract
    with tempfile.TemporaryDirectory() as folder:
        source = os.path.join(folder, "book.mobi")
        with open(source, "wb") as file:
            file.write(content)
        kept, path = unpack(source)
        try:
            if os.path.getsize(path) > context.limits.max_member_bytes:
                raise LimitExceeded("book too large")
            with open(path, "rb") as file:
                data = file.read()
        finally:
            shutil.rmtree(kept, ignore_errors=True)
    if path.lower().endswith(".epub"):
        return read_epub(data, name, context)
    if path.lower().endswith((".html", ".htm", ".xhtml")):
        return read_html(data, name, context)
    raise UnsupportedFormat(f"{name} unpacks to {os.path.basename(path)}")


_READ: dict[str, Callable[[bytes, str, Context], list[Group]]] = {
    "html": read_html, "mhtml": read_mhtml, "docx": read_docx, "pdf": read_pdf, "xlsx": read_xlsx, "xls": read_xls, "csv": read_csv, "fb2": read_fb2, "zip": read_zip, "xmind": read_xmind,
    "pptx": read_pptx, "ppt": read_ppt, "wps": read_wps, "rtf": read_rtf, "odf": read_odf, "epub": read_epub, "eml": read_eml, "msg": read_msg, "mobi": read_mobi, "tar": read_tar, "7z": read_7z,
    "svg": read_svg, "ipynb": read_ipynb, "subtitle": read_subtitle, "mbox": read_mbox, "ics": read_ics, "vcf": read_vcf, "image": read_image, "raster": read_image, "literal": read_literal, "text": read_text,
}


def read(content: bytes, name: str, context: Context) -> list[Group]:
    reader = reader_of(name)
    if reader is None:
        raise UnsupportedFormat(f"unsupported file format: {name}")
    if len(content) > context.limits.max_bytes:
        raise LimitExceeded(f"{len(content)} bytes")
    try:
        return _READ[reader](content, name, context)
    except (SliceError, LimitExceeded):
        raise
    except Exception as error:
        raise ParseFailure(f"{type(error).__name__}: {error}") from error


def slice_bytes(content: bytes, name: str, context: Context, fallback_title: str | None = None) -> list[tuple[str, str]]:
    """(title, content) paragraphs of a document; titles fall back to the group's name, or to `fallback_title` if given."""
    name = name.replace("\0", "")
    out: list[tuple[str, str]] = []
    for group in read(content, name, context):
        title = fallback_title if fallback_title is not None else group.name
        if group.rows is not None:
            rows = group.rows
        else:
            patterns = () if group.literal else group.patterns if group.patterns is not None else context.options.patterns
            rows = kernels.slice_text(group.text, replace(context.options, patterns=patterns))
        out += [((t.strip() or title)[:256], c.replace("\0", "").strip()) for t, c in rows if c.replace("\0", "").strip()]
    return out


def extract_text(content: bytes, name: str, context: Context) -> str:
    """The text of a document, not sliced."""
    return "\n\n".join(g.text if g.rows is None else "".join(c for _, c in g.rows) for g in read(content, name, context))
