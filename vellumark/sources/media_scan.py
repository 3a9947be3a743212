"""Images inside documents: members of packages, parts of mail, data URIs and references of markup, or the document itself."""

from __future__ import annotations

import base64
import binascii
import email
import email.policy
import posixpath
import re
import urllib.parse
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.errors import SliceError
from vellumark.operators.rows import each_row
from vellumark.options import ParserLimits
from vellumark.sources import pdf
from vellumark.sources.formats import decode, html_text, package

_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".ico", ".svg", ".emf", ".wmf", ".heic")
_REFERENCE = re.compile(r"!\[[^\]]*?\]\([ \t]*<?([^\s()<>]+)[^()]*\)|<img\b[^>]*?\bsrc\s*=\s*[\"']?([^\"'\s>]+)[^>]*>|xlink:href=[\"']([^\"']+)[\"']", re.I)
_HEADING = re.compile(r"^#{1,6}[ \t]+([^\n]+)$|<h[1-6][^>]*>(.*?)</h[1-6]>", re.I | re.M | re.S)
_TAG = re.compile(r"<[^>]*>")
ASSETS = "kind string, scanned int, skipped map<string,int>, assets array<struct<idx:int,file_name:string,src:string,content:binary,heading:string,anchor:string,role:string>>"


@dataclass
class Scan:
    """What was found: assets in order, how many candidates were looked at, and why some were left out."""

    kind: str
    scanned: int = 0
    skipped: dict[str, int] = field(default_factory=dict)
    assets: list[dict] = field(default_factory=list)

    def add(self, name: str, content: bytes | None, src: str = "", heading: str = "", anchor: str = "", role: str = "") -> None:
        self.scanned += 1
        if content is None:
            self.skip("external")
            return
        self.assets.append({"idx": len(self.assets), "file_name": name, "src": src, "content": content, "heading": heading or None, "anchor": anchor or None, "role": role or None})

    def skip(self, reason: str) -> None:
        self.skipped[reason] = self.skipped.get(reason, 0) + 1


def context(text: str, at: int) -> tuple[str, str]:
    """The nearest heading before a place (within 20,000 characters), and the last 96 visible characters."""
    before = text[max(0, at - 20_000) : at]
    found = [m[1] or m[2] for m in _HEADING.finditer(before)]
    clean = lambda s: re.sub(r"\s+", " ", _TAG.sub(" ", s)).strip()
    return clean(found[-1]) if found else "", clean(_REFERENCE.sub(" ", before[-4_000:]))[-96:]


def data_uri(uri: str) -> bytes | None:
    head, mark, body = uri.partition(",")
    if not mark or not head.startswith("data:"):
        return None
    try:
        return base64.b64decode(urllib.parse.unquote(body), validate=False) if head.endswith(";base64") else urllib.parse.unquote_to_bytes(body)
    except (binascii.Error, ValueError):
        return None


def resolve(src: str, base: str, names: dict[str, str]) -> str | None:
    """The member a relative reference means: by its place below the page, as written, in lower case, then by its last part."""
    src = urllib.parse.unquote(src.split("#")[0].split("?")[0])
    for key in (posixpath.normpath(posixpath.join(posixpath.dirname(base), src)), posixpath.normpath(src)):
        if key in names:
            return names[key]
        if key.lower() in names:
            return names[key.lower()]
    return names.get("*" + posixpath.basename(src).lower())


def _markup(scan: Scan, text: str, base: str, find) -> None:
    for m in _REFERENCE.finditer(text):
        src = m[1] or m[2] or m[3]
        heading, anchor = context(text, m.start())
        content = data_uri(src) if src.startswith("data:") else find(src, base)
        scan.add(posixpath.basename(src.split("?")[0])[:200] if not src.startswith("data:") else "inline", content, src[:200], heading, anchor)


def scan_media(content: bytes, name: str, limits: ParserLimits | None = None) -> Scan:
    """The images of a document, each reference once; packages first through their pages, then the members no page uses."""
    limits = limits or ParserLimits()
    low = name.lower()
    if content[:4] == b"PK\3\4":
        scan, archive = Scan("zip"), package(content, limits)
        members = [n for n in archive.namelist() if not n.endswith("/")]
        names = {"*" + posixpath.basename(n).lower(): n for n in reversed(members)} | {n.lower(): n for n in members} | {n: n for n in members}
        used: set[str] = set()

        def find(src: str, base: str) -> bytes | None:
            hit = resolve(src, base, names)
            if hit is None or "://" in src:
                return None
            used.add(hit)
            return archive.read(hit)

        for n in members:
            if n.lower().endswith((".html", ".htm", ".xhtml", ".md", ".markdown")):
                _markup(scan, html_text(archive.read(n)), n, find)
        for n in members:
            if n.lower().endswith(_SUFFIXES) and n not in used:
                scan.add(posixpath.basename(n), archive.read(n), n, role="document" if "cover" in n.lower() else "")
        return scan
    if content[:4] == b"%PDF":
        scan, document = Scan("pdf"), pdf.open_document(content, name)
        for number, images in enumerate(document.images):
            lines = document.lines[number] if number < len(document.lines) else []
            heading = max(lines, key=lambda x: x[1])[0] if len({s for _, s in lines}) > 1 else ""
            for file_name, data in images:
                scan.add(file_name, data, f"page {number + 1}", heading, re.sub(r"\s+", " ", document.pages[number]).strip()[-96:])
        return scan
    if low.endswith((".eml", ".mht", ".mhtml", ".mbox")):
        scan, message = Scan("mime"), email.message_from_bytes(content, policy=email.policy.default)
        parts, pages = {}, []
        for k, part in enumerate(message.walk()):
            if k > limits.max_parts:
                scan.skip("parts")
                break
            if part.get_content_maintype() == "image":
                data = part.get_payload(decode=True) or b""
                key = (part.get("Content-ID") or "").strip("<>") or (part.get("Content-Location") or "") or part.get_filename() or f"part{k}"
                parts[key] = (part.get_filename() or posixpath.basename(key), data)
            elif part.get_content_type() == "text/html":
                pages.append(html_text(part.get_payload(decode=True) or b""))
        used = set()

        def of_mail(src: str, base: str) -> bytes | None:
            key = urllib.parse.unquote(src.removeprefix("cid:"))
            hit = key if key in parts else next((k for k in parts if posixpath.basename(k) == posixpath.basename(key)), None)
            if hit is None:
                return None
            used.add(hit)
            return parts[hit][1]

        for page in pages:
            _markup(scan, page, "", of_mail)
        for key, (file_name, data) in parts.items():
            if key not in used:
                scan.add(file_name, data, key)
        return scan
    if low.endswith(_SUFFIXES) and not low.endswith(".svg"):
        scan = Scan("image")
        scan.add(name, content, role="document")
        return scan
    scan = Scan("markup")
    try:
        _markup(scan, decode(content, limits), name, lambda src, base: None)
    except SliceError:
        scan.kind = "none"
    return scan


def scan_column(name: Column, content: Column) -> Column:
    """scan_media of each document as a struct; a document that cannot be read has kind `error`."""

    def run(n: str | None, c: bytes | None) -> tuple:
        try:
            found = scan_media(c or b"", n or "")
        except Exception:  # noqa: BLE001
            found = Scan("error")
        return found.kind, found.scanned, list(found.skipped.items()), found.assets

    return each_row(run, ASSETS, name, content)


def extract_assets(documents: DataFrame) -> DataFrame:
    """documents (doc_id, name, content) to assets: doc_id, id (of the bytes), idx, file_name, src, content, sha256, heading, anchor, role."""
    rows = documents.select("doc_id", F.explode(scan_column(F.col("name"), F.col("content"))["assets"]).alias("a")).select("doc_id", "a.*")
    return rows.withColumn("sha256", F.sha2("content", 256)).withColumn("id", F.substring("sha256", 1, 32))


def media_file_name(idx: Column, stem: Column, suffix: Column) -> Column:
    """`000-name.png`: the name an image is written under."""
    safe = F.regexp_replace(F.regexp_replace(stem, r"\.[^.]*$", ""), r"[^\p{L}\p{N}_.-]+", "_")
    return F.concat(F.lpad(idx.cast("string"), 3, "0"), F.lit("-"), safe, F.coalesce(suffix, F.lit("")))
