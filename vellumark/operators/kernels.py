"""Sequential walks over one text, in plain Python: they are the bodies of Arrow functions and know nothing of Spark.

Length is counted in code points unless a measure is given. Positions are carried as offsets all the way, so repeated
headings or repeated text cannot be mistaken for each other.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator

from vellumark.options import SliceOptions

SENTENCE_ENDS = "。.!！?？"
_REFERENCE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_REFERENCE_REACH = 1024
_FENCE = re.compile(r"^(?P<f>```|~~~)[^\n]*\n.*?^(?P=f)[^\n]*$", re.M | re.S)
_SEPARATOR = re.compile(r"[|\-: ]*-[|\-: ]*")
BLANK_LINES = r"(?<!\n)\n\n+"
MARKDOWN = (r"^# (?!-\*- coding:).*", *(rf"^{'#' * k} (?!#).*" for k in range(2, 7)), BLANK_LINES)


def uncut(text: str) -> int:
    """A measure by which every text is one unit long, so that none is beyond a limit."""
    return 1


def _widest(text: str, start: int, limit: int, measure: Callable[[str], int]) -> int:
    """The furthest end such that the measure of text[start:end] is within the limit; at least one character."""
    low, high = start + 1, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        if measure(text[start:middle]) <= limit:
            low = middle
        else:
            high = middle - 1
    return low


def _cut(text: str, start: int, end: int, floor: int, boundary: bool) -> int:
    cut = end
    if boundary:
        last = max(text.rfind(c, floor + 1, end - 1) for c in SENTENCE_ENDS)
        cut = last + 1 if last >= 0 else end
    line = text.rfind("\n", start, cut) + 1
    if line > start and text[line:cut].lstrip().startswith("|"):
        cut = line  # not inside a table row
    for reference in _REFERENCE.finditer(text, start, min(len(text), cut + _REFERENCE_REACH)):
        if reference.start() >= cut:
            break
        if reference.end() > cut:  # not inside an image reference
            return reference.start() if reference.start() > start else cut
    return cut


def budget_split(text: str, options: SliceOptions) -> list[str]:
    """Pieces of at most `limit`, cut after the last sentence end of each window; blank pieces are left out."""
    measure, limit, overlap = options.length_fn or len, options.limit, options.overlap
    if measure(text) <= limit:
        return [text]
    pieces, start = [], 0
    while start < len(text):
        end = start + limit if options.length_fn is None else _widest(text, start, limit, measure)
        if end >= len(text):
            pieces.append(text[start:])
            break
        cut = _cut(text, start, end, start + int(limit * options.lookback), options.boundary)
        pieces.append(text[start:cut])
        begin = cut - overlap
        if overlap and begin > start:
            if options.overlap_boundary:
                line = text.find("\n", begin, cut - 1)
                ends = [i for c in SENTENCE_ENDS if (i := text.find(c, begin, cut - 1)) >= 0]
                begin = line + 1 if line >= 0 else min(ends) + 1 if ends else begin
            start = max(begin, start + 1)
        else:
            start = cut
    if options.min_chunk:
        joined: list[str] = []
        for piece in pieces:
            if joined and len(piece) < options.min_chunk:
                joined[-1] += piece
            else:
                joined.append(piece)
        pieces = joined
    return [p for p in pieces if p.strip()]


def mask_fences(text: str) -> str:
    """The text with everything inside closed code fences blanked, line ends and length kept."""
    if "```" not in text and "~~~" not in text:
        return text
    return _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_HEADING = re.compile(r"^(#{1,6}) (.*)", re.M)
_BLANK_RUN = re.compile(BLANK_LINES)


class _Cuts:
    """Where each pattern occurs, outermost first. Markdown's are found in two scans of the whole text, others by a scan of each part."""

    def __init__(self, masked: str, patterns: tuple[str, ...]) -> None:
        self.masked, self.levels = masked, len(patterns)
        self.patterns = [re.compile(p, re.M) for p in patterns]
        self.known = patterns in (MARKDOWN, MARKDOWN[:6])
        if self.known:
            self.starts: list[list[int]] = [[] for _ in patterns]
            self.ends: list[list[int]] = [[] for _ in patterns]
            for m in _HEADING.finditer(masked):
                level, rest = len(m[1]), m[2]
                if rest.replace("#", "").strip() and not rest.startswith("-*- coding:" if level == 1 else "#"):
                    self.starts[level - 1].append(m.start())
                    self.ends[level - 1].append(min(m.end(), m.start() + 255))
            if self.levels == 7:
                for m in _BLANK_RUN.finditer(masked):
                    self.starts[6].append(m.start())
                    self.ends[6].append(min(m.end(), m.start() + 255))

    def first(self, level: int, a: int, b: int) -> list[tuple[int, int]]:
        """(start, end) of the outermost pattern from `level` on that occurs in [a, b); headings without text do not count."""
        for k in range(level, self.levels):
            if self.known:
                i, j = bisect.bisect_left(self.starts[k], a), bisect.bisect_left(self.starts[k], b)
                found = list(zip(self.starts[k][i:j], self.ends[k][i:j], strict=True))
            else:
                found = [(m.start(), min(m.end(), m.start() + 255)) for m in self.patterns[k].finditer(self.masked, a, b) if m[0].replace("#", "").strip() or m[0].startswith("\n")]
            if found:
                return found
        return []


def _walk(text: str, cuts: _Cuts, a: int, b: int, level: int, chain: tuple[str, ...], options: SliceOptions) -> Iterator[tuple[tuple[str, ...], str]]:
    """(chain of headings, block) of text[a:b], cut along the outermost pattern from `level` on that occurs there."""
    found = cuts.first(level, a, b)
    if not found:
        yield from ((chain, piece) for piece in budget_split(text[a:b], options))
        return
    if text[a : found[0][0]].strip() or (level == 0 and found[0][0] > a and text[a : found[0][0]]):
        if level == 0:
            yield from _walk(text, cuts, a, found[0][0], 1, (*chain, ""), options)
        else:
            yield from ((chain, piece) for piece in budget_split(text[a : found[0][0]], options))
    for (start, end), after in zip(found, [*(s for s, _ in found[1:]), b], strict=True):
        if end == after:
            continue
        inner = list(_walk(text, cuts, end, after, level + 1, (*chain, text[start:end]), options))
        yield from inner or [((*chain, text[start:end]), text[end:after])]


def is_separator(line: str) -> bool:
    return bool(_SEPARATOR.fullmatch(line.strip()))


def carry_headers(blocks: Iterable[str]) -> Iterator[str]:
    """Blocks in order; one that goes on with a table cut before it gets the table's last header in front."""
    header, inside = None, False
    for block in blocks:
        if "|" not in block:
            inside = False
            yield block
            continue
        lines = block.split("\n")
        if inside and header and lines[0].lstrip().startswith("|") and not (len(lines) > 1 and is_separator(lines[1])):
            block = f"{header}\n{block}"
            lines = block.split("\n")
        for first, second in zip(lines, lines[1:], strict=False):
            if first.lstrip().startswith("|") and is_separator(second):
                header = f"{first}\n{second}"
        filled = [x for x in lines if x.strip()]
        inside = bool(filled) and filled[-1].lstrip().startswith("|")
        yield block


def strip_markers(text: str) -> str:
    """Heading marks off the lines outside code fences."""
    out, fenced = [], False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        out.append(line if fenced else re.sub(r"^#+[ \t]*", "", line))
    return "\n".join(out)


def clean(text: str) -> str:
    return strip_markers(re.sub(r"\t+", "", re.sub(r" +", " ", re.sub(r"\n+", "\n", text))))


def snap_forward(carried: str) -> str:
    """What follows the first sentence end or blank, if that isn't blank."""
    for i, c in enumerate(carried):
        if (c in SENTENCE_ENDS or c in " \n\t") and carried[i + 1 :].strip():
            return carried[i + 1 :]
    return carried


def overlap_rows(rows: list[tuple[str, str]], options: SliceOptions, separator: str = " ") -> list[tuple[str, str]]:
    """Each paragraph led by the end of the one before it, as that one stands after the same step."""
    if options.overlap <= 0:
        return rows
    out: list[tuple[str, str]] = []
    for title, content in rows:
        if out and content:
            before_title, before = out[-1]
            if before and (before_title == title or not options.overlap_within_section):
                carried = before[-options.overlap :]
                if options.overlap_boundary and len(before) > options.overlap:
                    carried = snap_forward(carried)
                if carried.strip():
                    content = carried + separator + content
        out.append((title, content))
    return out


def slice_text(text: str, options: SliceOptions, fallback_title: str = "") -> list[tuple[str, str]]:
    """(title, content) paragraphs of one text along its heading tree."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    patterns = MARKDOWN if options.patterns is None else tuple(options.patterns)
    pieces = options if options.overlap == 0 else SliceOptions(limit=options.limit, boundary=options.boundary, lookback=options.lookback, min_chunk=options.min_chunk, length_fn=options.length_fn)
    found = list(_walk(text, _Cuts(mask_fences(text), patterns), 0, len(text), 0, (), pieces))
    contents = carry_headers(block for _, block in found)
    rows = [(" ".join(chain), clean(c) if options.with_filter else c) for (chain, _), c in zip(found, contents, strict=True)]
    titles = {title for title, _ in rows}
    out = []
    for title, content in rows:
        if not content.strip() and title:  # a heading without text is text, unless another heading goes on from it
            content = "" if any(title in t and t != title for t in titles) else title
            title = ""
        for mark in ("#", "\n", "\r", "\\s"):
            title = title.replace(mark, "")
        if len(title) > 255:
            title, content = title[:255], title[255:] + content
        if content.strip():
            out.append((title, content))
    out = overlap_rows(out, options)
    return [((title.strip() or fallback_title)[:256], content.strip()) for title, content in out]


def mark_chunk(text: str, size: int) -> list[str]:
    """Runs of up to `size` characters that end at a mark, then what lies between them, in pieces of `size`."""
    pattern = re.compile(rf".{{1,{size}}}[。| \\.！;；!\n]", re.S)
    out = [m.strip() for m in pattern.findall(text)]
    for rest in pattern.split(text):
        rest = rest.strip()
        out += [rest] if 0 < len(rest) < size else [rest[i : i + size].strip() for i in range(0, len(rest), size)]
    return [x for x in out if x]


def pack_rows(header: str, rows: Iterable[str], limit: int, resplit: bool) -> list[str]:
    """Table rows joined under a repeated header while they stay below the limit; a row too long is cut if `resplit`."""
    out, now = [], header
    for row in rows:
        if resplit and len(header) + len(row) >= limit:
            if now != header:
                out.append(now)
                now = header
            width = max(limit - len(header), 50)
            out += [header + row[i : i + width] for i in range(0, len(row), width)]
        elif len(now) + len(row) < limit:
            now += row
        else:
            if now != header:
                out.append(now)
            now = header + row
    return [*out, now] if now != header or not out else out


def line_split(text: str, limit: int) -> list[str]:
    """Whole lines gathered up to `limit`, and what is longer cut every `limit` characters."""
    gathered, now = [], ""
    lines = text.split("\n")
    for line in (x + "\n" for x in lines[:-1]):
        if now and len(now) + len(line) > limit:
            gathered.append(now)
            now = ""
        now += line
    now += lines[-1]
    return [part[i : i + limit] for part in [*gathered, now] for i in range(0, len(part), limit)]
