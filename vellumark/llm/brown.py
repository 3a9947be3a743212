"""A Brown class-based bigram language model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.llm.shared import cut, discard, hash_spans, mix, slices, tidy, words

#: Words that are exchanged one by one on the driver (the most frequent), the classes of all words, and sweeps over these words.
CLUSTERED, CLASSES, SWEEPS = 1024, 64, 5
#: At most so many words (those of the highest counts) are exchanged in sweeps over the texts; rarer ones are placed once.
EXCHANGED_WORDS = 1 << 18
#: At most so many word counts are broadcast for scoring (the highest); the tokens of all other words get theirs in a join.
BROADCAST_WORDS = 1 << 18
#: Sweeps over the texts after the first placing; in the last the rare words are placed, too.
TEXT_SWEEPS = 1
SHAPES = 16
#: Counts that a task holds before it sends them on.
HELD = 900_000
UNITS = CLUSTERED + SHAPES + 1  # the last is the end of a text
#: Neighbours that a word is placed by: the classes, the shapes of words not placed yet, and the end. Codes of a text's tokens: the classes, the end, and words unseen in training by shape.
NEIGHBOURS, END, CODES = CLASSES + SHAPES + 1, CLASSES, CLASSES + 1 + SHAPES
_KIND = np.zeros(256, np.int64)
_KIND[[ord(c) for c in "0123456789"]] = 1
_KIND[[ord(c) for c in ".,;:!?"]] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?"]] = 3


def held_out(doc_id: str, parts: int = 10) -> Column:
    """Whether crc32 of the id as text is 0 modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their shapes (by length and last character) and how many words each text has."""
    starts, ends, counts = words(data, offsets)
    length = ends - starts
    shape = ((length > 4).astype(np.int64) + (length > 8) + (length > 12)) * 4 + (_KIND[data[ends - 1]] if len(ends) else 0)
    return hash_spans(data, starts, ends), shape, counts


def _count(rows: DataFrame) -> DataFrame:
    """(h, shape, n) of all words of the texts of `rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            h, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
            unique, at, back = np.unique(h, return_index=True, return_inverse=True)
            return unique, shape[at], np.bincount(back, weights=n, minlength=len(unique)).astype(np.int64)

        def out(x: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(x[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[0][k : k + 100_000].view(np.int64)), pa.array(x[1][k : k + 100_000], pa.int64()), pa.array(x[2][k : k + 100_000])], names=["h", "shape", "n"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, shape, _ = tokens(data, offsets)
                unique, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append((unique, shape[at], n))
                size += len(unique)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD * 2 // 3:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(merged())

    return rows.mapInArrow(run, "h long, shape long, n long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def _units(h: np.ndarray, shape: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The unit of every word: its rank among the clustered words, or else its shape."""
    if not len(top[0]):
        return CLUSTERED + shape
    at = np.minimum(np.searchsorted(top[0], h), len(top[0]) - 1)
    return np.where(top[0][at] == h, top[1][at], CLUSTERED + shape)


def _chain(units: np.ndarray, counts: np.ndarray, end: int = UNITS - 1) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts with an end after each, and the unit before each of them (an end before the first word)."""
    number = counts + 1
    ends = np.cumsum(number) - 1
    chain = np.full(int(number.sum()), end, dtype=np.int64)
    inside = np.ones(len(chain), dtype=bool)
    inside[ends] = False
    chain[inside] = units
    before = np.empty_like(chain)
    before[1:] = chain[:-1]
    if len(before):
        before[0] = end
    return chain, before


def _classed(h: np.ndarray, shape: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words, by sorted hashes and their classes: the class, or CLASSES + shape where it has none (yet); and which words are among the hashes."""
    if not len(known[0]):
        return CLASSES + shape, np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
    have = known[0][at] == h
    return np.where(have & (known[1][at] < CLASSES), known[1][at], CLASSES + shape), have


def _bigrams(rows: DataFrame, width: int, code: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Counts of neighbouring codes over all texts; the last code is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width * width, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, shape, number = tokens(data, offsets)
                chain, before = _chain(code(h, shape), number, width - 1)
                seen += np.bincount(before * width + chain, minlength=len(seen)) if len(chain) * 8 > len(seen) else 0
                if len(chain) * 8 <= len(seen):
                    at, n = np.unique(before * width + chain, return_counts=True)
                    seen[at] += n
        at = np.flatnonzero(seen)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_pydict({"code": at[k : k + 100_000], "n": seen[at[k : k + 100_000]]})

    gathered = rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width * width)
    out[gathered.column("code").to_numpy()] = gathered.column("n").to_numpy()
    return out.reshape(width, width)


def exchange(bigrams: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the units. Units 0..movable-1 are exchanged between `classes` classes, every other has one of its own.

    Each unit in turn goes to the class where the likelihood of the class bigrams is highest (Kneser and Ney's exchange
    algorithm), until a sweep moves none or `sweeps` are over. Ties go to the lower class, so the result is fixed.
    """
    n = len(bigrams)
    total = classes + n - movable
    of = np.concatenate((np.arange(movable) % classes, classes + np.arange(n - movable)))
    member = np.zeros((n, total))
    member[np.arange(n), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # of each unit, to and from each class
    table = member.T @ right

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            own, self_count = of[w], bigrams[w, w]
            r, el = right[w].copy(), left[w].copy()
            r[own] -= self_count
            el[own] -= self_count
            table[own] -= r
            table[:, own] -= el
            table[own, own] -= self_count
            part, across = table[:classes], table[:, :classes]
            gain_row = f(part + r) - f(part)
            gain_column = f(across + el[:, None]) - f(across)
            corner = table[diagonal, diagonal]
            gain = gain_row.sum(1) + gain_column.sum(0) - gain_row[diagonal, diagonal] - gain_column[diagonal, diagonal]
            gain += f(corner + r[:classes] + el[:classes] + self_count) - f(corner)
            rows, columns = part.sum(1), across.sum(0)
            out, into = r.sum() + self_count, el.sum() + self_count
            gain -= f(rows + out) - f(rows) + f(columns + into) - f(columns)
            new = int(np.argmax(np.round(gain, 6)))
            table[new] += r
            table[:, new] += el
            table[new, new] += self_count
            if new != own:
                moved += 1
                of[w] = new
                right[:, own] -= bigrams[:, w]
                right[:, new] += bigrams[:, w]
                left[:, own] -= bigrams[w]
                left[:, new] += bigrams[w]
        if not moved:
            break
    return of


def _neighbours(rows: DataFrame, known: Broadcast, core: np.ndarray, rare: bool) -> DataFrame:
    """(h, shape, seen) of the words of `rows` that are not in `core` (sorted hashes), and unless `rare` only of those in `known`.

    seen: n * 512 + code, each code once, for n neighbours of that code (left, or NEIGHBOURS and more: right).
    """
    width = 2 * NEIGHBOURS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            h, shape, code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            unique, at, back = np.unique(h, return_index=True, return_inverse=True)
            key, back = np.unique(back * width + code, return_inverse=True)
            word = key // width
            return unique[word], shape[at][word], key % width, np.bincount(back, weights=n, minlength=len(key)).astype(np.int64)

        def out(x: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            h, shape, code, n = x
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            bounds = np.append(first, len(h))
            for k in range(0, len(first), 20_000):
                b = bounds[k : k + 20_001]
                seen = pa.ListArray.from_arrays(pa.array(b - b[0], pa.int32()), pa.array(n[b[0] : b[-1]] * 512 + code[b[0] : b[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(h[b[:-1]].view(np.int64)), pa.array(shape[b[:-1]]), seen], names=["h", "shape", "seen"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, shape, number = tokens(data, offsets)
                codes, have = _classed(h, shape, known.value)
                chain, before = _chain(codes, number, NEIGHBOURS - 1)
                after = np.append(chain[1:], NEIGHBOURS - 1)
                inside = np.ones(len(chain), dtype=bool)
                inside[np.cumsum(number + 1) - 1] = False
                wanted = ~_among(h, core) & (have | rare)
                mine = np.flatnonzero(wanted)
                h, shape, left, right = h[mine], shape[mine], before[inside][mine], after[inside][mine]
                one = np.ones(len(mine), np.int64)
                held.append(merged([(h, shape, left, one), (h, shape, right + NEIGHBOURS, one)]))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD * 2 // 3:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(merged(held))

    return rows.mapInArrow(run, "h long, shape long, seen array<long>")


def _among(h: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of h are among the sorted hashes."""
    return hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h if len(hashes) else np.zeros(len(h), bool)


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, table: np.ndarray, classes: int = CLASSES, own: np.ndarray | None = None) -> np.ndarray:
    """The class of each word that raises the likelihood of the class bigrams `table` most; ties go to the lower class.

    Entries are ordered by word, and words numbered from 0 without gaps. An entry says that the word stands n times
    after the unit `code` (code < len(table)) or before the unit code - len(table). Where own is a class (not -1) the
    word counts in that class in `table`; it is taken out first, as the exchange algorithm does.
    """

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    size = len(table)
    # One line for each code: what the class bigrams with that neighbour are now, class by class.
    lines = np.vstack([table[:, :classes], table[:classes].T])
    now = f(lines)
    number = int(word[-1]) + 1 if len(word) else 0
    own = np.full(number, -1) if own is None else own
    gain = np.zeros((number, classes))
    for k in range(0, len(word), 50_000):
        w, c, m = word[k : k + 50_000], code[k : k + 50_000], n[k : k + 50_000, None]
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        gain[w[first]] += np.add.reduceat(f(lines[c] + m) - now[c], first)
    # Neighbours of the class itself on both sides meet in one cell.
    diagonal, sides = np.diagonal(table)[:classes], []
    for begin in (0, size):
        inner = (code >= begin) & (code < begin + classes)
        sides.append(np.bincount(word[inner] * classes + code[inner] - begin, weights=n[inner], minlength=number * classes).reshape(number, classes))
    gain += f(diagonal + sides[0] + sides[1]) - f(diagonal + sides[0]) - f(diagonal + sides[1]) + f(diagonal)
    times = np.bincount(word, weights=n * (code < size), minlength=number)[:, None]
    rows, columns = table[:classes].sum(1), table[:, :classes].sum(0)
    gain -= f(rows + times) - f(rows) + f(columns + times) - f(columns)
    # In its own class a word gains what taking it out would lose.
    at = np.flatnonzero(own >= 0)
    if len(at):
        inside = own[word] >= 0
        w, m = word[inside], n[inside]
        cell = lines[code[inside], own[w]]
        loss = np.bincount(w, weights=f(cell) - f(np.maximum(cell - m, 0)), minlength=number)[at]
        k = own[at]
        # Its own bigrams also stand in the cells between its class and another, where neighbours of its class come in.
        for line, gone, m in ((table[k, :classes], sides[1][at], sides[0][at, k]), (table[:classes, k].T, sides[0][at], sides[1][at, k])):
            m, rest = m[:, None], np.maximum(line - gone, 0)
            gain[at] += f(rest + m) - f(rest) - f(line + m) + f(line)
        a, b, d, t = sides[0][at, k], sides[1][at, k], diagonal[k], times[at, 0]
        less = lambda x: f(np.maximum(x, 0))
        loss += less(d - a) + less(d - b) - f(d) - less(d - a - b)
        gain[at, k] = loss - (f(rows[k]) - less(rows[k] - t)) - (f(columns[k]) - less(columns[k] - t))
    return np.argmax(np.round(gain, 6), axis=1)


def _place(found: DataFrame, table: np.ndarray, known: Broadcast) -> DataFrame:
    """(h, shape, n, class) of every word of `found`, which has the neighbours of a word in one row or several."""
    spark = found.sparkSession
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed(h: np.ndarray, shape: np.ndarray, owner: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate(([True], h[1:] != h[:-1]))
            word = np.cumsum(new) - 1
            key, back = np.unique(word[owner] * (2 * NEIGHBOURS) + (seen & 511), return_inverse=True)
            n = np.bincount(back, weights=seen >> 9, minlength=len(key))
            word, code = key // (2 * NEIGHBOURS), key % (2 * NEIGHBOURS)
            now, _ = _classed(h[new].view(np.uint64), shape[new], known.value)
            of = best_classes(word, code, n, sent.value, own=np.where(now < CLASSES, now, -1))
            times = np.bincount(word, weights=n * (code < NEIGHBOURS), minlength=len(of)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(shape[new]), pa.array(times), pa.array(of.astype(np.int64))], names=["h", "shape", "n", "class"])

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*rest, batch]).combine_chunks()
            h = whole.column("h").to_numpy()
            last = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if last:
                yield placed(*_flat(whole.slice(0, last)))
            rest = [_summed(whole.slice(last))]
        if rest:
            yield placed(*_flat(pa.Table.from_batches(rest)))

    return found.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, shape long, n long, class long")


def _flat(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """h and shape of rows, and of each of their neighbours its row and itself."""
    seen = rows.column("seen").combine_chunks()
    seen = seen.chunk(0) if isinstance(seen, pa.ChunkedArray) else seen
    owner = np.repeat(np.arange(len(seen)), seen.value_lengths().to_numpy(zero_copy_only=False))
    return rows.column("h").to_numpy(), rows.column("shape").to_numpy(), owner, seen.flatten().to_numpy()


def _summed(rows: pa.Table) -> pa.RecordBatch:
    """Rows of one word as one row."""
    h, shape, _, seen = _flat(rows)
    code, back = np.unique(seen & 511, return_inverse=True)
    n = np.bincount(back, weights=seen >> 9, minlength=len(code)).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array([0, len(code)], pa.int32()), pa.array(n * 512 + code))
    return pa.RecordBatch.from_arrays([pa.array(h[:1]), pa.array(shape[:1]), lists.cast(rows.schema.field("seen").type)], schema=rows.schema)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token codes of all texts, the code before each, and how many each text has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    chain = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    return chain, np.concatenate(([END], chain[:-1])), np.diff(offsets)


@dataclass(frozen=True)
class Learnt:
    """placed: h, shape, n, class of all words but the core; core: hashes, shapes, counts and classes of these; frequent: which of `placed` are sent out for scoring; tokens, types and texts of the training part."""

    placed: DataFrame
    core: tuple[np.ndarray, ...]
    frequent: Column
    total: int
    types: int
    n_docs: int


def _highest(by_level: list[tuple[int, int, int]], most: int) -> Column:
    """Which words (h, n) are among those of the highest counts, `most` at most: all of the higher levels, and of the level that would be too much a part by the hashes."""
    number, lowest, share = 0, -1, 0
    for at, words_of, _ in reversed(by_level):
        if number + words_of > most:
            lowest, share = at, int((most - number) / words_of * 0.98 * 65_536)
            break
        number += words_of
    level = F.floor(4 * F.log2("n")).cast("int")
    return (level > lowest) | ((level == lowest) & (F.pmod(F.xxhash64("h"), F.lit(65_536)) < share))


def learn(train: DataFrame) -> Learnt:
    """Counts and classes of all words of the column `text` of `train`."""
    context = train.sparkSession.sparkContext
    counts = cut(_count(train))
    n_docs = train.count()
    level = F.floor(4 * F.log2("n")).cast("int")
    by_level = sorted((r["level"], r["words"], r["tokens"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect())
    total = sum(r[2] for r in by_level) + n_docs
    types = sum(r[1] for r in by_level) + (n_docs > 0)
    core = counts.orderBy(F.desc("n"), "h").limit(CLUSTERED).toArrow()
    core_h, core_shape, core_n = core.column("h").to_numpy().view(np.uint64), core.column("shape").to_numpy(), core.column("n").to_numpy()
    top = (np.sort(core_h), np.argsort(core_h, kind="stable").astype(np.int64))
    sent_top = context.broadcast(top)
    bigrams = _bigrams(train, UNITS, lambda h, shape: _units(h, shape, sent_top.value))
    of = exchange(bigrams, CLUSTERED)
    member = np.zeros((UNITS, NEIGHBOURS))
    member[np.arange(UNITS), of] = 1
    core_of = of[: len(core_h)]

    # Sweeps over the texts: every one of these words is exchanged, all of one sweep by the class bigrams before it.
    hashes = np.union1d(counts.filter(_highest(by_level, EXCHANGED_WORDS)).select("h").toArrow().column("h").to_numpy().view(np.uint64), core_h)
    classes = np.full(len(hashes), CLASSES, np.uint8)
    classes[np.searchsorted(hashes, core_h)] = core_of
    table = member.T @ bigrams @ member
    for sweep in range(TEXT_SWEEPS + 1):
        known = context.broadcast((hashes, classes))
        if sweep:
            table = _bigrams(train, NEIGHBOURS, lambda h, shape, known=known: _classed(h, shape, known.value)[0])
        placed = _place(_neighbours(train, known, top[0], sweep == TEXT_SWEEPS), table, known)
        if sweep < TEXT_SWEEPS:
            got = placed.select("h", "class").toArrow()
            classes = classes.copy()
            classes[np.searchsorted(hashes, got.column("h").to_numpy().view(np.uint64))] = got.column("class").to_numpy()
    out = cut(placed)
    discard(counts)
    return Learnt(out, (core_h, core_shape, core_n, core_of), _highest(by_level, BROADCAST_WORDS), total, types, n_docs)


def score_texts(docs: DataFrame, alpha: float = 0.1, parts: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score and score (double) for every row of `docs`.

    Tokens are words with A-Z in lower case and one end for each text. The model learns from the texts that held_out()
    leaves, and every word of them gets one of CLASSES learnt classes; the end has its own.

    1. Exchange clustering of the CLUSTERED most frequent words by their bigram counts over the whole training part, one
       by one. The other words count as neighbours by their shape here.
    2. Exchange of all words, up to EXCHANGED_WORDS, in sweeps over the training part: each goes to the
       class where the likelihood of the class bigrams is raised most by the sums of its left and right neighbours, taken
       out of its own class first. All of a sweep go by the bigrams before it. In the last sweep every rarer word is
       placed in the same way, once.
    3. Class bigrams are counted again over all training tokens, by the classes of step 2.

    score is the sum over tokens of log10 P(class | class before) + log10 P(word | class). Transitions are smoothed by
    the class frequencies. Emissions are discounted absolutely, class by class, and what is taken off is the probability
    of words unseen in training, one type for each shape, dealt over the shapes as the class's words of count one are.
    As the class of an unseen word is not known, its probability is the sum over all classes, and what follows it is
    weighted by its share in each. base_score counts one unseen type: log10((c + alpha) / (N + alpha * (V + 1))).

    Counts are exact and cover all training tokens. Only the BROADCAST_WORDS highest are sent to the executors; tokens
    of other words are joined with their counts and classes, one row for each text and word, and put back at their
    places, for which a text is held as one byte a token. Word hashes have 64 bits.

    Null texts are empty: one token, the end. A null id counts as held out. Repeated rows are each scored and each
    count. Without training texts every word is unknown and all classes are equally likely. Other columns are ignored;
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"), held_out(doc_id, parts).alias("held"))
    with tidy(spark):
        learnt = learn(base.filter(~F.col("held")).select("text"))
    placed, (core_h, core_shape, core_n, core_of), total, types, n_docs = learnt.placed, learnt.core, learnt.total, learnt.types, learnt.n_docs

    # Emissions: absolute discounting in every class.
    n_class, n_types, ones, twos = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros((CLASSES, SHAPES)), np.zeros(CLASSES)
    for row in placed.groupBy("class", "shape").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect():
        n_class[row["class"]] += row["n"]
        n_types[row["class"]] += row["v"]
        ones[row["class"], row["shape"]] += row["n1"]
        twos[row["class"]] += row["n2"]
    np.add.at(n_class, core_of, core_n)
    np.add.at(n_types, core_of, 1)
    np.add.at(ones, (core_of, core_shape), core_n == 1)
    np.add.at(twos, core_of, core_n == 2)
    discount = np.clip(ones.sum(1) / np.maximum(1, ones.sum(1) + 2 * twos), 0.05, 0.95)
    unseen = np.where(n_class > 0, discount * n_types / np.maximum(1, n_class), 1.0)
    shared = (ones.sum(0) + 1) / (ones.sum() + SHAPES)
    by_shape = unseen[:, None] * (ones + shared) / (ones.sum(1, keepdims=True) + 1)
    n_class = np.maximum(1, n_class)

    frequent = placed.filter(learnt.frequent).toArrow()
    known = np.concatenate((core_h, frequent.column("h").to_numpy().view(np.uint64)))
    order = np.argsort(known, kind="stable")
    known_n = np.concatenate((core_n, frequent.column("n").to_numpy()))[order].astype(np.float64)
    known_of = np.concatenate((core_of, frequent.column("class").to_numpy()))[order].astype(np.uint8)
    model = {"known": known[order], "n": known_n, "of": known_of, "discount": discount, "n_class": n_class, "ends": n_docs, "alpha": alpha}
    sent_model = spark.sparkContext.broadcast(model)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent_model.value
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                h, shape, number = tokens(data, offsets)
                n = len(number)
                owner = np.repeat(np.arange(n), number)
                begin = np.cumsum(number) - number
                if len(m["known"]):
                    at = np.minimum(np.searchsorted(m["known"], h), len(m["known"]) - 1)
                    have = m["known"][at] == h
                    c, cls = np.where(have, m["n"][at], 1.0), m["of"][at].astype(np.int64)
                else:
                    have, c, cls = np.zeros(len(h), bool), np.ones(len(h)), np.zeros(len(h), np.int64)
                emit = np.where(have, np.log10(np.maximum(c - m["discount"][cls], 1e-9) / m["n_class"][cls]), 0.0)
                base_sum = np.bincount(owner, weights=np.where(have, np.log10(c + m["alpha"]), 0.0), minlength=n) + np.log10(m["ends"] + m["alpha"])
                emit_sum = np.bincount(owner, weights=emit, minlength=n)
                seen = np.bincount(owner, weights=have, minlength=n).astype(np.int64) + (m["ends"] > 0)
                # A byte a token; those of words not sent are filled in after the join.
                codes = np.full(int(number.sum()) + n, END, np.uint8)
                codes[np.arange(len(h)) + owner] = np.where(have, cls, CLASSES + 1 + shape)
                edges = np.concatenate(([0], np.cumsum(number + 1)))
                chain = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(codes)])
                # The words without a count here: one row for each text and word, with its places.
                lost = np.flatnonzero(~have)
                lost = lost[np.lexsort((h[lost], owner[lost]))]
                new = np.ones(len(lost), dtype=bool)
                new[1:] = (h[lost][1:] != h[lost][:-1]) | (owner[lost][1:] != owner[lost][:-1])
                pick = lost[new]
                bounds = np.concatenate((np.zeros(n, np.int64), np.append(np.flatnonzero(new), len(lost))))
                places = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(lost - begin[owner[lost]], pa.int32()))
                doc, mine = batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first)
                where = pa.array(np.concatenate((np.arange(n), owner[pick])))
                zeros = np.zeros(len(pick))
                own = mix(np.asarray(mine).astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.take(where),
                        mine.take(where),
                        pa.array(np.concatenate((own, h[pick])).view(np.int64)),
                        pa.array(np.concatenate((np.full(n, -1), shape[pick]))),
                        places,
                        pa.array(np.concatenate((number + 1, zeros.astype(np.int64)))),
                        pa.array(np.concatenate((seen, zeros.astype(np.int64)))),
                        pa.array(np.concatenate((base_sum, zeros))),
                        pa.array(np.concatenate((emit_sum, zeros))),
                        pa.concat_arrays([chain, pa.nulls(len(pick), pa.binary())]),
                    ],
                    names=["doc", "mine", "h", "shape", "places", "n_tokens", "n_known", "base", "emit", "chain"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    source = base.select("doc", F.xxhash64("text").alias("mine"), "text")
    rows = source.mapInArrow(resolve, f"doc {kind}, mine long, h long, shape long, places array<int>, n_tokens long, n_known long, base double, emit double, chain binary")
    rare = placed.filter(~learnt.frequent).select(F.col("h").alias("_h"), F.col("n").cast("double").alias("_n"), F.col("class").cast("int").alias("_class"))
    joined = rows.join(rare, F.col("h") == F.col("_h"), "left")
    word, times = F.col("shape") >= 0, F.size("places")
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("_class"))
    code = F.coalesce(F.col("_class"), (CLASSES + 1 + F.col("shape")).cast("int"))
    parts_of = joined.select(
        "doc",
        "mine",
        F.when(word, 0).otherwise(1).cast("long").alias("copies"),
        "n_tokens",
        F.when(word, F.when(F.col("_n").isNotNull(), times).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(word, times * F.log10(F.coalesce("_n", F.lit(0.0)) + alpha)).otherwise(F.col("base")).alias("base"),
        F.when(word, times * F.coalesce(F.log10((F.col("_n") - pick(discount)) / pick(n_class)), F.lit(0.0))).otherwise(F.col("emit")).alias("emit"),
        "chain",
        F.when(word, F.struct(code.alias("code"), "places")).alias("fill"),
    )
    summed = parts_of.groupBy("doc", "mine").agg(*[F.sum(x).alias(x) for x in ("copies", "n_tokens", "n_known", "base", "emit")], F.max("chain").alias("chain"), F.collect_set("fill").alias("fill"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _, number = _codes(batch.column("chain"))
            codes, begin = codes.astype(np.uint8), np.cumsum(number) - number
            lists = batch.column("fill")
            owner = np.repeat(begin, lists.value_lengths().to_numpy(zero_copy_only=False))
            found = lists.flatten()
            places = found.field("places")
            times = places.value_lengths().to_numpy(zero_copy_only=False)
            codes[np.repeat(owner, times) + places.flatten().to_numpy()] = np.repeat(found.field("code").to_numpy(zero_copy_only=False), times)
            chain = pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(np.append(begin, len(codes)).astype(np.int32)), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("doc", "copies", "n_tokens", "n_known", "base", "emit")], chain], names=["doc", "copies", "n_tokens", "n_known", "base", "emit", "chain"])

    plain = f"doc {kind}, copies long, n_tokens long, n_known long, base double, emit double"
    with tidy(spark):
        resolved = cut(summed.drop("mine").mapInArrow(fill, f"{plain}, chain binary"))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CODES * CODES)
        for batch in batches:
            chain, before, number = _codes(batch.column("chain"))
            seen += np.bincount(before * CODES + chain, weights=np.repeat(batch.column("copies").to_numpy(), number), minlength=len(seen))
        code = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"code": code, "n": seen[code].astype(np.int64)})

    gathered = resolved.filter(~held_out("doc", parts)).mapInArrow(steps, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CODES * CODES)
    table[gathered.column("code").to_numpy()] = gathered.column("n").to_numpy()
    table = table.reshape(CODES, CODES)[: CLASSES + 1, : CLASSES + 1]
    share = (table.sum(0) + 1) / (table.sum() + CLASSES + 1)
    follows = (table + 5 * share) / (table.sum(1, keepdims=True) + 5)
    likely = share[:CLASSES, None] * by_shape
    follows = np.vstack([follows, (likely / likely.sum(0)).T @ follows[:CLASSES]])
    sent_steps = spark.sparkContext.broadcast(np.log10(np.hstack([follows, follows[:, :CLASSES] @ by_shape])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chain, before, number = _codes(batch.column("chain"))
            step = np.bincount(np.repeat(np.arange(len(number)), number), weights=sent_steps.value[before, chain], minlength=len(number))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("doc", "copies", "n_tokens", "n_known", "base", "emit")], pa.array(step)], names=["doc", "copies", "n_tokens", "n_known", "base", "emit", "step"])

    scored = resolved.mapInArrow(score, f"{plain}, step double")
    each = scored.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    n_tokens = (F.col("n_tokens") / F.col("copies")).cast("long")
    return each.select(
        F.col("doc").alias(doc_id),
        F.crc32(F.coalesce(F.col("doc").cast("string"), F.lit("")).cast("binary")).alias("_crc"),
        n_tokens.alias("n_tokens"),
        (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") - n_tokens * F.lit(float(np.log10(total + alpha * (types + 1))))).alias("base_score"),
        (F.col("emit") / F.col("copies") + F.col("step")).alias("score"),
    ).select(F.col(doc_id), (F.col("_crc") % parts == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
