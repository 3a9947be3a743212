"""Mixing to target weights: domain posteriors of a classifier, and document rates by projected-gradient least squares."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructType

from vellumark.llm.rules import _SYMBOLS
from vellumark.llm.shared import cut, fresh, hash_spans, slices, words

#: Labelled rows the classifier is fitted on, at most (those with the smallest id hashes).
LABELLED_ROWS = 6000
BUCKETS = 1 << 40
#: How many features of each domain may be used; texts left out decide, in so many folds.
CHOSEN, FOLDS = (4, 12, 40, 120), 3
#: And how much large weights cost.
PENALTIES = (1e-4, 1e-3, 1e-2)
#: Beginnings of words that count as features, in bytes.
BEGINNINGS = (4, 6)
#: Of a labelled text at most so many features go to the driver.
TEXT_FEATURES = 20_000
#: Step lengths that one pass over the documents measures.
LENGTHS = np.array([0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 64.0])
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_EDGES = np.array([0.001, 0.01, 0.03, 0.1, 0.3, 0.6])
_BINS = len(_EDGES) + 1
WIDTH = BUCKETS + 3 * _BINS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) pairs of a slice, each once, and how many words each text has.

    Features are hashed words, the first bytes (of each number in BEGINNINGS) that two or more different words of the
    text begin with, and the bins of three shares: symbols, capitals, and words equal to the word before.
    """
    n = len(offsets) - 1
    starts, ends, counts = words(data, offsets)
    h = hash_spans(data, starts, ends)
    owner = np.repeat(np.arange(n), counts)
    pairs, first = np.unique(owner * WIDTH + (h % np.uint64(BUCKETS)).astype(np.int64), return_index=True)
    first.sort()
    found = [pairs]
    for size in BEGINNINGS:
        at = first[ends[first] - starts[first] > size]
        begun = hash_spans(data, starts[at], starts[at] + size) ^ np.uint64(size)
        begun, times = np.unique(owner[at] * WIDTH + (begun % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
        found.append(begun[times > 1])
    pairs = np.concatenate(found)
    total = lambda flags: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.concatenate(([0], np.cumsum(flags, dtype=np.int64))))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    size = np.maximum(np.diff(offsets), 1)
    shares = (total(_SYMBOLS[data]) / size, total(_UPPER[data]) / size, np.bincount(owner, weights=same, minlength=n) / np.maximum(counts, 1))
    bins = np.concatenate([np.arange(n) * WIDTH + BUCKETS + k * _BINS + np.searchsorted(_EDGES, s, side="right") for k, s in enumerate(shares)])
    pairs = np.concatenate((pairs, bins))
    return pairs // WIDTH, pairs % WIDTH, counts


def posteriors(data: np.ndarray, offsets: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Domain posteriors and word counts of the texts of a slice; weights: sorted features, and a row for each and one of biases."""
    at, feature, counts = features(data, offsets)
    n = len(offsets) - 1
    used, value = weights
    place = np.minimum(np.searchsorted(used, feature), max(0, len(used) - 1))
    known = used[place] == feature if len(used) else np.zeros(len(feature), bool)
    at, place = at[known], place[known]
    scores = np.column_stack([np.bincount(at, weights=w[place], minlength=n) for w in value[:-1].T]) + value[-1]
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True), counts


def _chosen(at: np.ndarray, column: np.ndarray, y: np.ndarray, n_features: int, n_domains: int, most: int) -> np.ndarray:
    """Which features to use: of each domain the `most` that are over-represented in it by the most standard deviations.

    Only features of three texts and more are looked at, and only those that are over-represented at all.
    """
    n, texts = len(y), np.bincount(column, minlength=n_features).astype(float)
    out = np.zeros(n_features, bool)
    for d in range(n_domains):
        mine = y == d
        expected = texts * mine.mean()
        over = np.bincount(column[mine[at]], minlength=n_features) - expected
        over /= np.sqrt(np.maximum(expected * (1 - mine.mean()) * (1 - texts / n), 1e-9))
        over[texts < 3] = 0
        first = np.argsort(-over, kind="stable")[:most]
        out[first[over[first] > 0]] = True
    return out


def _scores(at: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    scores = np.column_stack([np.bincount(at, weights=w[column], minlength=n) for w in value[:-1].T]) + value[-1]
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def _regress(at: np.ndarray, column: np.ndarray, y: np.ndarray, n_features: int, n_domains: int, penalty: float, steps: int) -> np.ndarray:
    """Weights of a multinomial logistic regression (a row for each feature and one of biases), by Adam."""
    n = len(y)
    value = np.zeros((n_features + 1, n_domains))
    mean, square = np.zeros_like(value), np.zeros_like(value)
    hot = np.eye(n_domains)[y]
    for i in range(1, steps + 1):
        error = (_scores(at, column, value, n) - hot) / n
        slope = np.vstack([np.column_stack([np.bincount(column, weights=e[at], minlength=n_features) for e in error.T]), error.sum(0)]) + penalty * value
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        value -= 0.05 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-6)
    return value


def learn(at: np.ndarray, feature: np.ndarray, y: np.ndarray, n_domains: int, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features in use, and their weights, from (text, feature) pairs and a domain for each text.

    With all features rare words would be learnt by heart, with too few a domain is missed. How many of each domain
    are used, and what large weights cost, is what gives the least log loss on texts left out, each third of them in
    turn; nothing else is fitted to the size of the table. The last model is fitted on all texts.
    """
    used, column = np.unique(feature, return_inverse=True)
    fold = np.arange(len(y)) % FOLDS

    def fitted(mine: np.ndarray, most: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        number = np.cumsum(mine) - 1
        inside = mine[at]
        chosen = _chosen(number[at[inside]], column[inside], y[mine], len(used), n_domains, most)
        keep = inside & chosen[column]
        place = np.cumsum(chosen) - 1
        return chosen, _regress(number[at[keep]], place[column[keep]], y[mine], int(chosen.sum()), n_domains, penalty, steps)

    def loss(most: int, penalty: float) -> float:
        out = 0.0
        for f in range(FOLDS):
            left = fold == f
            chosen, value = fitted(~left, most, penalty)
            keep = left[at] & chosen[column]
            p = _scores((np.cumsum(left) - 1)[at[keep]], (np.cumsum(chosen) - 1)[column[keep]], value, int(left.sum()))
            out -= np.log(np.maximum(p[np.arange(len(p)), y[left]], 1e-9)).sum()
        return round(out, 9)

    most, penalty = CHOSEN[0], PENALTIES[0]
    if len(y) >= 2 * FOLDS:
        most = min(CHOSEN, key=lambda m: loss(m, PENALTIES[1]))
        penalty = min(PENALTIES, key=lambda x: loss(most, x))
    chosen, value = fitted(np.ones(len(y), bool), most, penalty)
    return used[chosen], value


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = LABELLED_ROWS, doc_id: str = "doc_id", text: str = "text") -> tuple[tuple[np.ndarray, np.ndarray], dict]:
    """Weights of a multinomial logistic regression of the domain on hashed words, learnt from at most `most` labelled rows, and the domains of these.

    Features are made on the executors; the driver gets the distinct feature numbers of the chosen texts only, of each
    at most TEXT_FEATURES, those with the smallest hashes: a longer text is measured whole but learnt from in part.
    """
    chosen = labelled.select(F.col(labelled.columns[0]).alias("_id"), F.col(labelled.columns[1]).alias("_domain")).filter(F.col("_id").isNotNull() & F.col("_domain").isin(domains))
    few = chosen.groupBy("_id").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(few), F.col("_doc") == F.col("_id")).select("_id", "_domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                at, feature, _ = features(data, offsets)
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(end - first + 1))
                own = [np.sort(feature[order[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]
                own = [(x if len(x) <= TEXT_FEATURES else np.concatenate((x[:TEXT_FEATURES], x[x >= BUCKETS]))).astype("<i8").tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(own, pa.binary())], names=["id", "domain", "own"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, domain string, own binary").toArrow()
    if not got.num_rows:
        return (np.zeros(0, np.int64), np.zeros((1, len(domains)))), {}
    order = sorted(range(got.num_rows), key=lambda i: (str(got.column("id")[i].as_py()), got.column("own")[i].as_py()))
    own = [np.frombuffer(got.column("own")[i].as_py(), "<i8") for i in order]
    y = np.asarray([domains.index(got.column("domain")[i].as_py()) for i in order])
    given = {got.column("id")[i].as_py(): int(d) for i, d in zip(order, y, strict=True)}
    return learn(np.repeat(np.arange(len(y)), [len(x) for x in own]), np.concatenate(own), y, len(domains)), given


def rates(p: np.ndarray, history: np.ndarray, most: float) -> np.ndarray:
    """The rates after the given gradient steps (one row of domain slopes each), from rate one, projected on [0, most]."""
    r = np.ones(len(p))
    for step in history:
        r = np.clip(r - p @ step, 0.0, most)
    return r


@dataclass(frozen=True)
class Fit:
    """history: the steps taken; natural, goal, fitted: token totals of the domains before, wanted and after; converged: whether no step lowered the distance any more."""

    history: np.ndarray
    natural: np.ndarray
    goal: np.ndarray
    fitted: np.ndarray
    converged: bool


def find_rates(table: DataFrame, targets: np.ndarray, most: float, steps: int = 40, tolerance: float = 1e-3) -> Fit:
    """Rates by the projected gradient on `table`, which has n (tokens) and p (posteriors).

    The sum over domains of (expected tokens - target)**2 / natural tokens is minimised over the rates. A document's
    rate is a function of its own posteriors and the domain slopes so far, so each step sends those few numbers out
    and gets domain totals back; no rate is stored or shuffled. Each pass measures LENGTHS step lengths at once and the
    best is taken, so few passes are needed. They end when the targets are met, when no step length comes nearer, or when
    a step moves no domain by more than `tolerance` of all tokens; a fit that has not ended after `steps` says so.
    """
    k = len(targets)

    def totals(history: np.ndarray, slope: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(lengths), k))
            for batch in batches:
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                n, now, change = batch.column(0).to_numpy(zero_copy_only=False), rates(p, history, most), p @ slope
                for i, length in enumerate(lengths):
                    out[i] += (n * np.clip(now - length * change, 0.0, most)) @ p
            yield pa.RecordBatch.from_pydict({"at": pa.array([0]), "total": pa.array([out.ravel().tolist()], pa.list_(pa.float64()))})

        flat = table.select("n", "p").mapInArrow(run, "at long, total array<double>")
        got = flat.select(*[F.sum(F.get("total", F.lit(d))) for d in range(k * len(lengths))]).first()
        return np.asarray([x or 0.0 for x in got]).reshape(-1, k)

    history = np.zeros((0, k))
    natural = totals(history, np.zeros(k), np.zeros(1))[0]
    anchor = int(np.argmax(targets))
    goal = targets * natural[anchor] / max(targets[anchor], 1e-12)
    scale = np.maximum(natural, 1e-9 + 1e-6 * natural.sum())
    distance = lambda t: float(((t - goal) ** 2 / scale).sum())
    now, converged = natural, False
    least = tolerance**2 * max(natural.sum(), 1e-9)
    for _ in range(steps):
        if distance(now) <= least:
            converged = True
            break
        slope = (now - goal) / scale
        tried = totals(history, slope, LENGTHS)
        best = min(range(len(LENGTHS)), key=lambda i: distance(tried[i]))
        if distance(tried[best]) >= distance(now):
            converged = True
            break
        history, moved, now = np.vstack([history, LENGTHS[best] * slope]), np.abs(tried[best] - now).max(), tried[best]
        if moved <= tolerance * natural.sum():
            converged = True
            break
    if not converged:
        warnings.warn(f"mixing rates have not converged after {steps} steps", stacklevel=2)
    return Fit(history, natural, goal, now, converged)


def fit_rates(table: DataFrame, targets: np.ndarray, most: float, steps: int = 60, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """history, natural and goal of find_rates()."""
    fit = find_rates(table, targets, most, steps, tolerance)
    return fit.history, fit.natural, fit.goal


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], max_rate: float = 1.0, most: int = LABELLED_ROWS, keep_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add n_tokens, p_<domain>, goal_<domain> and fitted_<domain> for every domain, rate and copies to `docs`.

    `labelled` has an id and a domain; a multinomial logistic regression fitted on it gives every document posteriors
    over the domains of `targets` (weights of the token totals); the rows that it was fitted on, at most `most`, have the
    domain they are labelled with. Rates in [0, max_rate] are then fitted by projected gradient, so that the expected
    tokens of the domains, each document shared out by its posteriors, come as near to the targets as the bounds allow;
    the domain with the largest weight keeps its natural total, and that fixes the scale. goal_ is the total that a domain shall have, fitted_ the one it gets, the same in every row. copies is
    floor(rate + u), u in [0, 1) by the hash of the id: a rate of one is always one copy.

    With `keep_text` the text stays, and texts are measured once for the fit and once for the result; without it they
    are measured once, and nothing but the measures is kept.

    All documents count in the totals. A text's tokens are its words; null and empty texts have none, and posteriors
    from the classifier's biases. Null ids share one u; repeated rows get the same rate. Ids with several domains have
    the first by name. Without labels all posteriors are equal. Added columns take the place of columns with these
    names; an empty table gives an empty table. A fit that has not converged warns.
    """
    spark = docs.sparkSession
    domains = sorted(targets)
    goal = np.asarray([float(targets[d]) for d in domains])
    k = len(domains)
    weights, given = fit_classifier(docs, labelled, domains, most, doc_id=doc_id, text=text)
    known = pa.array(list(given), to_arrow_type(docs.schema[doc_id].dataType))
    shared = spark.sparkContext.broadcast((weights, known, np.fromiter(given.values(), np.int64, len(given))))
    names = ["n_tokens", *(f"{kind}_{d}" for kind in ("p", "goal", "fitted") for d in domains), "rate", "copies"]
    kept = [c for c in docs.columns if c not in names]
    id_, n_, p_ = fresh(docs.columns, "id", "n", "p")
    source = docs.select(*[c for c in kept if c != text], F.col(doc_id).alias(id_), F.col(text).cast("string").alias(text))

    def measured(frame: DataFrame, texts: bool, history: np.ndarray | None = None) -> DataFrame:
        """The columns of `frame` but the last two (id and text, of which the text stays if `texts`), their tokens and posteriors, and with a history the rate."""
        own = [*frame.columns[:-2], *([text] if texts else [])]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts_of = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
                rest = [*batch.columns[:-2], *([texts_of] if texts else [])]
                for first, end, data, offsets in slices(texts_of):
                    weights, known, domain = shared.value
                    p, counts = posteriors(data, offsets, weights)
                    place = pc.index_in(ids.slice(first, end - first), value_set=known)
                    labelled_at = np.flatnonzero(place.is_valid())
                    p[labelled_at] = np.eye(k)[domain[place.drop_null().to_numpy()]]
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), k).cast(pa.list_(pa.float64()))
                    more = [] if history is None else [pa.array(rates(p, history, max_rate))]
                    yield pa.RecordBatch.from_arrays([*(x.slice(first, end - first) for x in rest), pa.array(counts, pa.int64()), lists, *more], names=[*own, n_, p_, "rate"][: len(own) + 2 + len(more)])

        schema = StructType([frame.schema[c] for c in own]).add(n_, "long").add(p_, ArrayType(DoubleType()))
        return frame.mapInArrow(measure, schema if history is None else schema.add("rate", "double"))

    table = cut(measured(source.select(id_, text), False) if keep_text else measured(source, False))
    fit = find_rates(table.select(F.col(n_).alias("n"), F.col(p_).alias("p")), goal, max_rate)
    history = fit.history

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, history, max_rate))], names=[*batch.schema.names, "rate"])

    rated = measured(source, True, history) if keep_text else table.mapInArrow(rate, StructType(list(table.schema.fields)).add("rate", "double"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(29), doc_id), 11) / F.lit(float(1 << 53))
    return rated.select(
        *[c for c in kept if keep_text or c != text],
        F.col(n_).alias("n_tokens"),
        *[F.get(p_, F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)],
        *[F.lit(float(fit.goal[i])).alias(f"goal_{d}") for i, d in enumerate(domains)],
        *[F.lit(float(fit.fitted[i])).alias(f"fitted_{d}") for i, d in enumerate(domains)],
        "rate",
        F.floor(F.col("rate") + u).cast("int").alias("copies"),
    )


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table with quality and toxic marks: toxic, or else good or poor; rows without a mark are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).filter(F.col("domain").isNotNull())
