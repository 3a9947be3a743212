"""Scalar functions and predicates over text, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"\./oss/file/([0-9A-Za-z_-]+)"
IMAGE = r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)"
LINK = r"(?<!!)\[([^\]]*)\]\(([^)\s]*)[^)]*\)"


def heading_lines(text: Column) -> Column:
    """array<struct<line_no, level, title>> of lines that begin with hashes and a blank."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("line_no"), F.length(F.regexp_extract(line, "^(#+) ", 1)).alias("level"), F.btrim(F.regexp_replace(line, "^#+", "")).alias("title")))
    return F.filter(lines, lambda x: x["level"] > 0)


def strip_markers(text: Column) -> Column:
    """Heading marks off lines outside fences: the text is cut before every fence line, and every other part is outside."""
    parts = F.split(F.concat(F.lit("x\n"), text), r"(?=\n *(?:```|~~~))")
    kept = F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).otherwise(F.regexp_replace(p, r"(?dm)^#+[ \t]*", "")))
    return F.substring(F.array_join(kept, ""), 3, 2**31 - 1)


def collapse(text: Column) -> Column:
    """Runs of line ends to one, runs of blanks to one, tabs away."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n+", "\n"), " +", " "), r"\t+", "")


def normalise_line_ends(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\0", "")


def plain(text: Column) -> Column:
    """Tags to blanks, white space collapsed, trimmed, in lower case: the form in which headings are compared."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " ")))


def clean_title(title: Column) -> Column:
    out = title
    for mark in ("#", "\n", "\r", "\\s"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def is_separator(line: Column) -> Column:
    return F.btrim(line).rlike(r"^[|\-: ]*-[|\-: ]*$")


def is_filled(text: Column) -> Column:
    return text.rlike(r"\S")


def escape_cell(value: Column, line_end: str = "<br>") -> Column:
    """A cell of a markdown table: line ends and bars replaced."""
    ends = F.regexp_replace(F.coalesce(value, F.lit("")), "\r\n|\r|\n", line_end)
    return F.replace(ends, F.lit("|"), F.lit("&#124;"))


def unescape_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("<br>"), F.lit("\n")), F.lit("&#124;"), F.lit("|"))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def references(text: Column) -> Column:
    """Ids of stored images that a text refers to, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)))


def image_sources(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2))


def html_noise_removed(html: Column) -> Column:
    """HTML without comments and without script, style, iframe, object and embed elements."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    return F.regexp_replace(out, r"(?is)<(script|style|iframe|object|embed)\b[^>]*>.*?</\1\s*>", "")


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def numbering_stripped(title: Column) -> Column:
    """A title without leading numbers: 1.2.3, (3), 第二章, 二、 and the like."""
    out = F.regexp_replace(F.btrim(title), r"^第[0-9一二三四五六七八九十百千]+[章节篇部条][\s、.:：]*", "")
    return F.btrim(F.regexp_replace(out, r"^[(（]?(?:[0-9]+(?:\.[0-9]+)*|[一二三四五六七八九十百]+)[)）]?(?:[、.．:：]\s*|\s+)", ""))


def ocr_gate(text: Column, least: int = 30, share: float = 0.5) -> Column:
    """Whether recognised text is worth keeping: enough letters and digits, and enough of them among what is not blank."""
    effective = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    return F.coalesce((effective >= least) & (effective >= share * F.greatest(visible, F.lit(1))), F.lit(False))


def data_uri(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def data_uri_bytes(uri: Column) -> Column:
    """Bytes of a base64 data URI; null if it isn't one."""
    return F.when(uri.rlike("^data:[^,]*;base64,"), F.try_to_binary(F.substring_index(uri, ",", -1), F.lit("base64")))


def subtitle_text(text: Column) -> Column:
    """Spoken lines of SRT or VTT: without numbers, times, notes, head lines and tags."""
    lines = F.transform(F.split(normalise_line_ends(text), "\n"), lambda x: F.btrim(F.regexp_replace(x, r"<[^>]*>|\{[^}]*\}", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$|-->|^WEBVTT|^NOTE\b")), "\n")


def unfold(text: Column) -> Column:
    """iCalendar and vCard lines, folded ones put together."""
    return F.regexp_replace(normalise_line_ends(text), "\n[ \t]", "")


def safe_member(name: Column) -> Column:
    return ~name.rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def title_tree_line(depth: Column, title: Column) -> Column:
    return F.concat(F.repeat(F.lit("│  "), depth), F.lit("├───"), title)


def anchored_position(text: Column, key: Column) -> Column:
    """Where a heading stands at the start of the text or after white space, from 1; 0 if nowhere."""
    return F.regexp_instr(text, F.concat(F.lit(r"(?<![^ \t\r\n\x{3000}])\Q"), key, F.lit(r"\E")))


def erase_line_ends(text: Column) -> Column:
    """Lines put together, but for those that end with a full stop `。`."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<!。)\n+", ""), r"^\n+", "")
