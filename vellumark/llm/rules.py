"""Quality rules: per-text counts and a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumark.llm.shared import _IS_WORD, SLICE_BYTES, _within, hash_spans, mix, segments, slices, tidy, windows, words

BUCKETS = 1 << 16
#: Raw counts that each bucket is given beforehand.
PRIOR = 20.0
#: Below this mean log-likelihood ratio a text is rejected. Trusted text lies above it, text with junk in its words below.
THRESHOLD = -0.15
#: Longer texts are measured part by part, and so many windows of theirs at once.
LONG_BYTES, PART = 4 << 20, 2_000_000
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each owner has."""
    mixed = mix(keys + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(mixed, return_index=True)
    return np.bincount(owner[at], minlength=n)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all word and word-pair hashes of the texts, in text order, and how many each text has."""
    single = hash_spans(data, starts, ends)
    pairs, n_pairs = windows(single, counts, 2)
    n_pairs = np.where(counts >= 2, n_pairs, 0)
    first = np.concatenate(([0], np.cumsum(np.minimum(counts, np.maximum(counts - 1, 1)))))
    keep = np.repeat(first[:-1], n_pairs) + _within(n_pairs)
    out = np.empty(len(single) + len(keep), dtype=np.int64)
    number = counts + n_pairs
    place = np.cumsum(number) - number
    out[np.repeat(place, counts) + _within(counts)] = (single % np.uint64(BUCKETS)).astype(np.int64)
    out[np.repeat(place + counts, n_pairs) + _within(n_pairs)] = (pairs[keep] % np.uint64(BUCKETS)).astype(np.int64)
    return out, number


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a slice."""
    n = len(offsets) - 1
    starts, ends, counts = words(data, offsets)
    inside = _IS_WORD[data] if len(data) else np.zeros(0, bool)
    out = {"n_words": counts, "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _sums(_SYMBOLS[data], offsets)}
    # Lines with a word: from a line's start to its end, texts being cut at \n and at their own ends.
    breaks = np.flatnonzero(data == 10)
    heads = np.union1d(offsets[:-1], breaks + 1)
    heads = heads[heads < len(data)]
    owner = np.searchsorted(offsets, heads, side="right") - 1
    tails = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, heads)], offsets[owner + 1])
    filled = np.searchsorted(starts, tails) > np.searchsorted(starts, heads)
    heads, tails, owner = heads[filled], tails[filled], owner[filled]
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - _distinct(owner, hash_spans(data, heads, tails, fold=False), n)
    # Words in windows of five that the text holds twice or more.
    exact = hash_spans(data, starts, ends, fold=False)
    runs, number = windows(exact, counts, 5)
    number = np.where(counts >= 5, number, 0)
    first = np.cumsum(counts) - counts
    whole = np.repeat(counts >= 5, np.where(counts >= 5, counts - 4, np.minimum(counts, 1)))
    runs, owner = runs[whole], np.repeat(np.arange(n), number)
    at = np.repeat(first, number) + _within(number)
    mixed = mix(runs + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(mixed, return_inverse=True, return_counts=True)
    twice = at[times[back] > 1] if len(mixed) else at
    edge = np.bincount(twice, minlength=len(starts) + 5)[: len(starts) + 5] - np.bincount(twice + 5, minlength=len(starts) + 5)[: len(starts) + 5]
    covered = np.cumsum(edge)[: len(starts)] > 0
    out["n_repeat_words"] = _sums(covered, np.concatenate(([0], np.cumsum(counts))))
    out["_features"] = features(data, starts, ends, counts)
    return out


def long_features(data: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of features() of one long text, part by part."""
    last = np.zeros(0, np.uint64)
    for a, b in segments(data):
        starts, ends, _ = words(data[a:b], np.array([0, b - a]))
        single = hash_spans(data[a:b], starts, ends)
        if not len(single):
            continue
        chain = np.concatenate((last, single))
        pairs, number = windows(chain, np.array([len(chain)]), 2)
        yield np.concatenate((single, pairs if len(chain) >= 2 else pairs[:0])) % np.uint64(BUCKETS)
        last = single[-1:]


def long_measures(data: np.ndarray, weights: np.ndarray) -> tuple[dict[str, int], float]:
    """measures() of one long text, and the mean of `weights` over its features, in memory of a few parts.

    What is repeated is found in turns, each for the windows whose hashes lie in one range, so no more than about PART
    windows are held at once.
    """
    out = {"n_words": 0, "word_chars": 0, "n_symbols": int(np.count_nonzero(_SYMBOLS[data])), "n_dup_lines": 0, "n_repeat_words": 0}
    for a, b in segments(data):
        inside = _IS_WORD[data[a:b]]
        out["word_chars"] += int(np.count_nonzero(inside & ((data[a:b] & 0xC0) != 0x80)))
        out["n_words"] += int(np.count_nonzero(inside & ~np.concatenate(([False], inside[:-1]))))
    total, number = 0.0, 0
    for buckets in long_features(data):
        total, number = total + float(weights[buckets.astype(np.int64)].sum()), number + len(buckets)
    # Lines with a word, by their hashes.
    lines: list[np.ndarray] = []
    start = 0
    while start <= len(data):
        breaks = np.flatnonzero(data[start : start + 4 * SLICE_BYTES] == 10) + start
        size = 4 * SLICE_BYTES
        while not len(breaks) and start + size < len(data):  # a line longer than a part
            breaks = np.flatnonzero(data[start + size : start + 2 * size] == 10)[:1] + start + size
            size *= 2
        heads, tails = np.concatenate(([start], breaks[:-1] + 1)) if len(breaks) else np.array([start]), breaks if len(breaks) else np.array([len(data)])
        part = data[start : int(tails[-1])]
        filled = np.add.reduceat(np.concatenate((_IS_WORD[part], [False])).astype(np.int64), heads - start) > 0 if len(part) else np.zeros(len(heads), bool)
        filled &= tails > heads
        lines.append(hash_spans(data, heads[filled], tails[filled], fold=False))
        start = int(tails[-1]) + 1
    hashes = np.sort(np.concatenate(lines))
    out["n_dup_lines"] = int(np.count_nonzero(hashes[1:] == hashes[:-1]))
    turns = max(1, -(-out["n_words"] // PART))
    covered = np.zeros(out["n_words"], bool)
    for turn in range(turns):
        held, places = [], []
        carry, before = np.zeros(0, np.uint64), 0
        for a, b in segments(data):
            starts, ends, _ = words(data[a:b], np.array([0, b - a]))
            chain = np.concatenate((carry, hash_spans(data[a:b], starts, ends, fold=False)))
            if len(chain) >= 5:
                runs, _ = windows(chain, np.array([len(chain)]), 5)
                mine = np.flatnonzero(runs % np.uint64(turns) == turn)
                held.append(runs[mine])
                places.append(mine + before)
                before += len(chain) - 4
                carry = chain[-4:]
            else:
                carry = chain
        runs, at = np.concatenate(held) if held else np.zeros(0, np.uint64), np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(runs, kind="stable")
        same = np.zeros(len(runs), bool)
        same[1:] = runs[order][1:] == runs[order][:-1]
        same[:-1] |= same[1:]
        for k in range(5):
            covered[at[order[same]] + k] = True
    out["n_repeat_words"] = int(np.count_nonzero(covered))
    return out, total / max(1, number)


def fit(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log-likelihood ratios of the buckets, from every document (raw) and those whose id is in `trusted` (target).

    `trusted` has a column of ids. The counts cover all of them and all documents: ids and texts meet by a shuffle,
    as the ids may be too many to be sent out, and only ids are held in memory. Both multinomials are smoothed with
    PRIOR raw counts a bucket, in the target by its share of the raw features: a bucket that is rare says little, and
    text that is clean but not among the trusted rows is not held against its rare words. Without trusted text all
    ratios are 0.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("_words"))
    rows = rows.join(ids.hint("shuffle_hash"), F.col("_doc") == F.col("_id"), "left").select(F.col("_id").isNotNull().alias("trusted"), "_words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            chosen = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in slices(batch.column(1)):
                if len(data) > LONG_BYTES:
                    for buckets in long_features(data):
                        own = np.bincount(buckets.astype(np.int64), minlength=BUCKETS)
                        raw += own
                        target += own if chosen[first] else 0
                    continue
                starts, ends, counts = words(data, offsets)
                buckets, number = features(data, starts, ends, counts)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[np.repeat(chosen[first:end], number)], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "raw": raw, "target": target})

    with tidy(docs.sparkSession):
        table = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table["bucket"]], target[table["bucket"]] = table["raw"], table["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    share = target.sum() / raw.sum()
    p, q = (target + PRIOR * share) / (target.sum() + PRIOR * share * BUCKETS), (raw + PRIOR) / (raw.sum() + PRIOR * BUCKETS)
    return np.log(p) - np.log(q)


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, llr (double) and kept to `docs`.

    base_failed: fewer than ten words, or over a fifth of the words in repeated windows of five. Otherwise a text is
    kept if llr, the mean over its hashed words and word pairs of log target over raw probability, is at least
    `threshold`. Every document gets its verdict from its own text and the counts alone, so repeated rows get the
    same one. Null texts are empty: no words, llr 0, base_failed. Added columns take the place of columns that have
    these names; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ratios = spark.sparkContext.broadcast(fit(docs, trusted, doc_id, text))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in {*names, "base_failed", "llr", "kept"}]
    source = docs.select(*kept)
    at = kept.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = ratios.value
        for batch in batches:
            out: dict[str, list[np.ndarray]] = {k: [] for k in (*names, "llr")}
            for _, _, data, offsets in slices(batch.column(at)):
                if len(data) > LONG_BYTES:
                    found, llr = long_measures(data, weights)
                    for k, v in (found | {"llr": llr}).items():
                        out[k].append(np.array([v]))
                    continue
                got = measures(data, offsets)
                buckets, number = got.pop("_features")
                owner = np.repeat(np.arange(len(number)), number)
                llr = np.bincount(owner, weights=weights[buckets], minlength=len(number)) / np.maximum(number, 1)
                for k, v in (got | {"llr": llr}).items():
                    out[k].append(v)
            columns = [np.concatenate(out[k]) if out[k] else np.zeros(0) for k in (*names, "llr")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.float64())], names=[*batch.schema.names, *names, "llr"])

    schema = StructType(list(source.schema.fields))
    for k in names:
        schema = schema.add(k, "long")
    judged = source.mapInArrow(judge, schema.add("llr", "double"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
