"""Packing documents into token windows of one length by multiway differencing."""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm.shared import cut

WINDOW = 2048
#: Remainders of documents are cut to pieces of at most this many ids, so that differencing has small parts to level with.
PART = 512
#: About so many remainder pieces are packed together in one task.
GROUP = 2048
CACHE = 200_000
END_ID = 1
_BEYOND = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f]")


def latin(pattern: str) -> str:
    """The pattern for the standard library's re, letters and numbers written out: right for texts that _BEYOND doesn't find in."""
    chars = [chr(c) for c in range(0x250)]
    letters, numbers = ("".join(c for c in chars if unicodedata.category(c)[0] == kind) for kind in "LN")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    if r"\p" in out:
        raise ValueError("a pattern with other classes than letters and numbers")
    return out


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, equal to those of the tokenizers file.

    Texts are cut by the tokenizer's own pattern, and each different piece is encoded once and kept in a table of at
    most CACHE pieces. Texts with characters beyond the Latin blocks, where regex libraries may differ about
    character classes, go to the tokenizers library whole.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pieces = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile(latin(pattern)).findall
        self.known = _Known(self.pieces._core_bpe.encode_single_piece)

    def __call__(self, text: str) -> bytes:
        if _BEYOND.search(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, self.cut(text)))


class _Known(dict):
    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.encode(piece.encode())).tobytes()
        if len(self) < CACHE:
            self[piece] = out
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, ranks_path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = Encoder(path, ranks_path, pattern)
    return _encoders[path, ranks_path]


def cuts(n: int, window: int = WINDOW, part: int = PART) -> list[int]:
    """Lengths of the pieces of n ids: whole windows, parts of the remainder, and its last part in three of falling size.

    The small pieces come last in differencing and level what the large ones leave uneven.
    """
    full, rest = divmod(n, window)
    parts, last = divmod(rest, part)
    tail = [last - last // 4, last // 4 - last // 16, last // 16]
    return [window] * full + [part] * parts + [x for x in tail if x]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: split items 0.. of the given sizes into k groups with near-equal sums.

    Every item begins as a partial partition (its size, and zeros that aren't written down). The two partial
    partitions with the largest imbalance are merged, the largest group of one with the smallest of the other, until
    one is left. Ties go to the lower item.
    """
    if not sizes:
        return [[] for _ in range(k)]
    # A partition is (sums in falling order, nodes); groups that aren't listed are empty, and sums are relative to the
    # least. A node is an item or, from len(sizes) on, a pair of nodes.
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    made = len(sizes)
    first = [(np.asarray([s]), np.asarray([i])) for i, s in enumerate(sizes)]
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        (a, x), (b, y) = first[i], first[j]
        over = max(0, len(a) + len(b) - k)  # so many of the smallest groups of a meet the largest of b
        if over:
            pairs.append((x[len(a) - over :][::-1], y[:over]))
            sums = np.concatenate((a[: len(a) - over], a[len(a) - over :][::-1] + b[:over], b[over:]))
            nodes = np.concatenate((x[: len(a) - over], np.arange(made, made + over), y[over:]))
            made += over
        else:
            sums, nodes = np.concatenate((a, b)), np.concatenate((x, y))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = int(sums[-1]) if len(sums) == k else 0
        i = min(i, j)
        first[i] = sums - low, nodes
        heapq.heappush(heap, (low - int(sums[0]), i))
    left, right = (np.concatenate([p[t] for p in pairs]).tolist() if pairs else [] for t in (0, 1))
    groups = []
    for node in first[heap[0][1]][1].tolist():
        stack, members = [node], []
        while stack:
            at = stack.pop()
            if at < len(sizes):
                members.append(at)
            else:
                stack += (left[at - len(sizes)], right[at - len(sizes)])
        groups.append(members)
    return groups + [[] for _ in range(k - len(groups))]


def windows(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Groups of items whose sums fit the window: as few as the total asks for, and more while any is over capacity."""
    k = -(-sum(sizes) // window)
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= window for g in groups):
            return [g for g in groups if g]
        k += 1


def tokenize(docs: DataFrame, path: str, ranks_path: str, pattern: str, window: int = WINDOW, part: int = PART, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for every piece of every document; one pass, texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks_path, pattern)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py() or "") + end
                at, total = 0, len(ids) // 4
                for n in cuts(total, window, part):
                    for column, v in zip(rows, (doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total), strict=True):
                        column.append(v)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, ranks_path: str, pattern: str, window: int = WINDOW, part: int = PART, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id. It is cut into whole windows, which are sequences by themselves, and a
    remainder in parts of at most `part` ids. Parts are dealt by hash into groups of about `group`, and each
    group is packed by multiway differencing into near-equal windows. Sequences lie gapless from offset 0, the longest
    piece first. Pieces are dealt by id, start and checksum, so neither a long document nor a repeated row burdens one
    task, and the number of groups follows the number of parts.

    Null texts are empty: one piece with the end id. Null ids and repeated rows are packed as they are, a repeated row
    once for each time. Other columns are ignored; an empty table gives no rows.
    """
    pieces = cut(tokenize(docs, path, ranks_path, pattern, window, part, doc_id, text))
    number = pieces.filter(F.col("length") < window).count()
    n_groups = max(1, round(number / group))
    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length"), F.lit(n_groups)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sizes = rows["length"].tolist()
        full = sum(n == window for n in sizes)
        sequence, offset = np.arange(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for k, members in enumerate(windows(sizes[full:], window) if full < len(sizes) else []):
            at = 0
            for i in sorted(members):
                sequence[full + i], offset[full + i] = full + k, at
                at += sizes[full + i]
        rows["sequence_id"] = sequence * n_groups + int(key[0])
        rows["offset"] = offset
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("bin").applyInPandas(run, schema)
