"""What the operators of this subpackage share: reading, checkpoints, words and hashes of whole Arrow batches.

Texts are handled as the UTF-8 buffer of an Arrow batch. All word positions and word hashes of many documents come
from a few numpy passes over that buffer, in slices of bounded size, so memory follows the slice and not the table.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
#: Code points that count as white space in every contract of this subpackage.
SPACE = " \t\n\x0b\x0c\r"

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode a temporary one if it is unset, on a cluster an error then."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder that the driver and all executors share")
        named = getattr(spark.sparkContext, "_vellumark_folder", None) or tempfile.mkdtemp(prefix="vellumark-")
        spark.sparkContext._vellumark_folder = named
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def discard(*frames: DataFrame) -> None:
    """Delete the checkpoints of frames that cut() made and nothing will read again."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        file = frame._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            delete(frame.sparkSession, file.get())


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def tidy(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Within it Spark deletes the shuffle files of each query as it ends (what goes on is checkpointed), and at most `rows` rows, if given, go to Python at once."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for own columns that no column has, whatever its case."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + w for w in wanted]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else. lower() has a fast path for ASCII; translate() is kept for the rest."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, small))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about `most` bytes; a longer text is a slice by itself."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    pa.default_memory_pool().release_unused()  # an idle worker shall not hold what a batch has needed


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words each text has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    closes[edges] = inside[edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        out = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        if n > 4 * SLICE_BYTES:  # not kept: one huge word shall not hold memory for good
            return out[0], out[1]
        _powers = out[0], out[1]
    return _powers


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of data[start:end] for ordered spans, with A-Z folded to lower case if `fold`."""
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        if ends[k] - starts[k] > 2 * SLICE_BYTES:
            out[k] = _long_hash(data[starts[k] : ends[k]], fold)
            k += 1
            continue
        end = max(k + 1, int(np.searchsorted(ends, starts[k] + 2 * SLICE_BYTES, side="right")))
        a, b = int(starts[k]), int(ends[end - 1])
        chunk = data[a:b]
        power, inverse = _power(b - a + 1)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((_LOWER[chunk] if fold else chunk).astype(np.uint64) * power[: b - a] + power[: b - a], out=total[1:])
        s, e = starts[k:end] - a, ends[k:end] - a
        out[k:end] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        k = end
    return mix(out)


def _long_hash(span: np.ndarray, fold: bool) -> np.uint64:
    """The same sum for one long span, block by block."""
    total, power = 0, _power(SLICE_BYTES)[0]
    for at in range(0, len(span), SLICE_BYTES):
        block = span[at : at + SLICE_BYTES]
        part = ((_LOWER[block] if fold else block).astype(np.uint64) + np.uint64(1)) * power[: len(block)]
        total += int(part.sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return np.uint64((total + len(span)) % (1 << 64))


def segments(data: np.ndarray, size: int = 4 * SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of about `size` bytes of one text that cut no word; a longer word is a part by itself."""
    start = 0
    while start < len(data):
        end = min(len(data), start + size)
        while end < len(data):
            free = np.flatnonzero(~_IS_WORD[data[end : end + size]])
            end = min(len(data), end + size) if not len(free) else end + int(free[0]) + 1
            if len(free):
                break
        yield start, end
        start = end


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words that lie in one text, and how many each text has; a text with fewer words has one."""
    factors = constants(size, 77)
    first = np.concatenate(([0], np.cumsum(counts)))
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.repeat(first[:-1], number) + _within(number)
    left = np.repeat(counts, number)
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate((hashes, np.zeros(size, dtype=np.uint64)))
    for j in range(size):
        out += np.where(left > j, padded[at + j] * factors[j], np.uint64(0))
    return mix(out + np.minimum(left, size).astype(np.uint64)), number


def _within(number: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each group of the given sizes."""
    return np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
