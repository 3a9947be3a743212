"""A quality classifier: a linear-chain conditional random field labels lines, their marginals make a text's score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.llm import crf
from vellumark.llm.brown import held_out
from vellumark.llm.rules import _SYMBOLS
from vellumark.llm.shared import _IS_WORD, _within, hash_spans, segments, slices, words

#: Labelled rows the model is fitted on, at most (those with the smallest id hashes).
LABELLED_ROWS = 3000
#: Of a labelled text at most so many lines go to the driver; longer texts than this are scored block by block.
TEXT_LINES, LONG_BYTES = 2000, 4 << 20
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LINE, _REPEATED = 17, 12
WIDTH = 3 * _LINE + 2 + 1


def _span_sums(flags: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[tails] - total[heads]).astype(np.float64)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, code points and numbers of the lines of all texts; an empty text is one empty line.

    A line brings counts and shares of its own, those of the lines before and after it, and whether these exist.
    """
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    after = np.searchsorted(offsets, breaks, side="right") - 1
    number = np.bincount(after, minlength=n) + 1
    first = np.cumsum(number) - number
    heads = np.empty(int(number.sum()), np.int64)
    tails = heads.copy()
    heads[first] = offsets[:-1]
    tails[first + number - 1] = offsets[1:]
    inner = np.ones(len(heads), bool)
    inner[first] = False
    heads[inner] = breaks + 1
    inner = np.ones(len(heads), bool)
    inner[first + number - 1] = False
    tails[inner] = breaks
    starts, ends, _ = words(data, offsets)
    a, b = np.searchsorted(starts, heads), np.searchsorted(starts, tails)
    count = (b - a).astype(np.float64)
    hashes = hash_spans(data, starts, ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[a[a < len(same)]] = False
    twice = np.zeros(len(hashes), bool)
    twice[2:] = hashes[2:] == hashes[:-2]
    for begin in (a, a + 1):  # the first two words of a line have none two before them
        twice[begin[begin < len(twice)]] = False
    chars = _span_sums((data & 0xC0) != 0x80, heads, tails)
    size = np.maximum(tails - heads, 1)
    word = np.maximum(count, 1)
    letters = np.maximum(_span_sums(_LETTER[data], heads, tails), 1)
    last = np.zeros(len(hashes), bool)
    last[:] = _SYMBOLS[data[ends - 1]] if len(ends) else False
    owner = np.repeat(np.arange(n), number)
    keys = hash_spans(data, heads, tails, fold=False) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = (times[at] > 1) & (count > 0)
    share = lambda flags, whole: _span_sums(flags, heads, tails) / whole
    per_word = lambda flags: _span_sums(flags, a, b) / word
    symbols, bars, shouts, upper, digits = share(_SYMBOLS[data], size), share(data == ord("|"), size), share(data == ord("!"), size), share(_UPPER[data], letters), share(_DIGIT[data], size)
    total_length = np.concatenate(([0], np.cumsum((ends - starts).astype(np.float64))))
    mean_length = (total_length[b] - total_length[a]) / word
    own = _own(count, symbols, bars, shouts, upper, digits, per_word(same), per_word(twice), repeated, per_word(last), mean_length)
    before, behind = np.zeros_like(own), np.zeros_like(own)
    has_before, has_behind = _within(number) > 0, _within(number) < np.repeat(number, number) - 1
    before[has_before] = own[np.flatnonzero(has_before) - 1]
    behind[has_behind] = own[np.flatnonzero(has_behind) + 1]
    return np.column_stack([own, before, behind, has_before, has_behind, np.ones(len(own))]), chars, number


def _own(count, symbols, bars, shouts, upper, digits, same, twice, repeated, last, mean_length) -> np.ndarray:
    """The features of lines themselves from their measures."""
    return np.column_stack(
        [
            np.log1p(count) / 5,
            count == 0,
            np.minimum(symbols * 8, 2),
            symbols > 0.02,
            np.minimum(bars * 20, 2),
            np.minimum(shouts * 10, 2),
            upper,
            upper > 0.5,
            np.minimum(digits * 5, 2),
            same * 2,
            same > 0.3,
            twice,
            repeated,
            last,
            mean_length / 10,
            (mean_length > 15) | ((mean_length < 2) & (count > 3)),
            count < 3,
        ]
    ).astype(np.float64)


def _long_line(data: np.ndarray, repeated: bool) -> tuple[np.ndarray, int]:
    """The features and code points of one very long line, part by part."""
    sums = np.zeros(10)
    carry = np.zeros(0, np.uint64)
    count = 0
    for a, b in segments(data):
        part = data[a:b]
        starts, ends, _ = words(part, np.array([0, b - a]))
        hashes = np.concatenate((carry, hash_spans(part, starts, ends)))
        new = np.arange(len(hashes)) >= len(carry)
        same, twice = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        same[1:], twice[2:] = hashes[1:] == hashes[:-1], hashes[2:] == hashes[:-2]
        flags = (_SYMBOLS[part], part == ord("|"), part == ord("!"), _UPPER[part], _DIGIT[part], _LETTER[part], (part & 0xC0) != 0x80)
        sums += [*(np.count_nonzero(f) for f in flags), np.count_nonzero(same & new), np.count_nonzero(twice & new), np.count_nonzero(_SYMBOLS[part[ends - 1]]) if len(ends) else 0]
        count += len(starts)
        carry = hashes[-2:]
    symbols, bars, shouts, upper, digits, letters, chars, same, twice, last = sums
    size, word = max(len(data), 1), max(count, 1)
    inside = sum(int(np.count_nonzero(_IS_WORD[data[a:b]])) for a, b in segments(data))
    measures = (count, symbols / size, bars / size, shouts / size, upper / max(letters, 1), digits / size, same / word, twice / word, float(repeated and count > 0), last / word, inside / word)
    return _own(*(np.array([float(m)]) for m in measures)), int(chars)


def long_score(data: np.ndarray, model: crf.Model, size: int = 4 << 20) -> float:
    """The score of one long text: its lines are turned into label scores block by block, and only these are held."""
    breaks = np.concatenate([np.flatnonzero(data[a : a + size] == 10) + a for a in range(0, len(data), size)])
    heads, tails = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(data)]))
    keys = np.concatenate([hash_spans(data, heads[k : k + 50_000], tails[k : k + 50_000], fold=False) for k in range(0, len(heads), 50_000)])
    order = np.argsort(keys, kind="stable")
    repeated = np.zeros(len(keys), bool)
    repeated[order[1:]] = keys[order][1:] == keys[order][:-1]
    repeated[order[:-1]] |= keys[order][1:] == keys[order][:-1]
    del keys, order
    scores, weight = np.empty((len(heads), 2)), np.empty(len(heads))
    at = 0
    while at < len(heads):
        end = max(at + 1, int(np.searchsorted(tails, heads[at] + size)))
        first, last = max(0, at - 1), min(len(heads), end + 1)
        own, chars = [], []
        k = first
        while k < last:  # runs of usual lines in one go, a very long line by itself
            long = tails[k] - heads[k] > size
            stop = k + 1 if long else k + int(np.argmax(np.append(tails[k:last] - heads[k:last], size + 1) > size))
            if long:
                x, n = _long_line(data[heads[k] : tails[k]], bool(repeated[k]))
                own.append(x)
                chars.append(np.array([n]))
            else:
                part = data[heads[k] : tails[stop - 1]]
                x, n, _ = lines(part, np.array([0, len(part)]))
                x = x[:, :_LINE]
                x[:, _REPEATED] = repeated[k:stop] & (x[:, 1] == 0)
                own.append(x)
                chars.append(n)
            k = stop
        x, chars = np.concatenate(own), np.concatenate(chars)
        zero = np.zeros((1, _LINE))
        place = np.arange(first, last)
        x = np.column_stack([x, np.vstack([zero, x[:-1]]), np.vstack([x[1:], zero]), place > 0, place < len(heads) - 1, np.ones(len(x))])
        mine = slice(at - first, at - first + end - at)
        scores[at:end], weight[at:end] = x[mine] @ model.weights, chars[mine] + 1
        at = end
    return float((crf.chain_marginals(scores, model)[:, 1] * weight).sum() / weight.sum())


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, parts: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> crf.Model:
    """Fit the field on at most `most` labelled texts outside the held-out part; every line has its text's label.

    Lines are turned into features on the executors; the driver gets those of the chosen texts only, of each at most
    TEXT_LINES lines from its middle, and texts over LONG_BYTES are not learnt from.
    """
    chosen = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(doc_id, parts)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    # Half of the rows for either label, so that a rare one is learnt too.
    few = [chosen.filter(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(most // 2) for v in (0, 1)]
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(few[0].union(few[1])), F.col("_doc") == F.col("_id")).filter(F.octet_length("text") <= LONG_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                x, _, number = lines(data, offsets)
                ends = np.cumsum(number)
                middle = [(e - k + max(0, k - TEXT_LINES) // 2, min(k, TEXT_LINES)) for e, k in zip(ends.tolist(), number.tolist(), strict=True)]
                own = [x[a : a + n, :_LINE].astype(np.float32).tobytes() for a, n in middle]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(own, pa.binary())], names=["id", "label", "lines"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.select("_id", "text", "_label").mapInArrow(run, f"id {kind}, label int, lines binary").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    own = [np.frombuffer(got.column("lines")[int(i)].as_py(), np.float32).reshape(-1, _LINE).astype(np.float64) for i in order]
    number = np.asarray([len(x) for x in own], dtype=np.int64)
    y = np.repeat(got.column("label").to_numpy()[order], number).astype(np.int64) if len(own) else np.zeros(0, np.int64)
    return crf.fit(spread(own), y, number)


def spread(own: list[np.ndarray]) -> np.ndarray:
    """The features of lines from their own ones, as lines() lays them out."""
    out = []
    for x in own:
        zero, n = np.zeros((1, x.shape[1])), len(x)
        at = np.arange(n)
        out.append(np.column_stack([x, np.vstack([zero, x[:-1]]), np.vstack([x[1:], zero]), at > 0, at < n - 1, np.ones(n)]))
    return np.concatenate(out) if out else np.zeros((0, WIDTH))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = LABELLED_ROWS, parts: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    score is the mean over all lines of the marginal probability of a good line, by forward-backward, weighted by one
    plus the line's code points. predicted is 1 if score is at least `threshold`. The model learns from rows of
    `labels` (0 or 1) that are not held out, at most `most`; id, source and language are no inputs.

    Null texts are empty, an empty text is one empty line. Null ids are held out; rows with one id are scored each by
    its own text. Of several labels of one id the larger counts; null labels are left out. Without labels every score
    is 0.5. Other columns are ignored; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most, parts, doc_id, text, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                if len(data) > LONG_BYTES:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([min(1.0, max(0.0, long_score(data, model)))])], names=["doc_id", "score"])
                    continue
                x, chars, number = lines(data, offsets)
                got, _, _ = crf.marginals(x @ model.weights, model, crf.Chains(number))
                owner = np.repeat(np.arange(len(number)), number)
                weight = chars + 1
                score = np.bincount(owner, weights=got[:, 1] * weight, minlength=len(number)) / np.bincount(owner, weights=weight, minlength=len(number))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", parts).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
