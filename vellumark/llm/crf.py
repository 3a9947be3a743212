"""A linear-chain conditional random field over batches of sequences, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """weights: features x labels; step: label to label; first, last: labels at the ends."""

    weights: np.ndarray
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Chains:
    """Rows of many sequences, laid out so that position t of all that reach it are one slice."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = np.asarray(lengths, dtype=np.int64)
        start = np.cumsum(self.lengths) - self.lengths
        order = np.argsort(-self.lengths, kind="stable")
        order = order[: int((self.lengths > 0).sum())]
        falling = self.lengths[order]
        self.most = int(falling[0]) if len(falling) else 0
        self.active = np.searchsorted(-falling, -np.arange(1, self.most + 1), side="right")
        self.rows = [start[order[: self.active[t]]] + t for t in range(self.most)]
        self.ends = start[order] + falling - 1
        self.starts = start[order]
        self.order = order


def marginals(scores: np.ndarray, model: Model, chains: Chains, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Label marginals of every row by forward-backward, the expected transitions, and the sum of log partitions."""
    n, k = scores.shape
    forward, backward = np.zeros((n, k)), np.zeros((n, k))
    for t, rows in enumerate(chains.rows):
        if t == 0:
            forward[rows] = scores[rows] + model.first
        else:
            forward[rows] = scores[rows] + _lse(forward[rows - 1][:, :, None] + model.step, 1)
    backward[chains.ends] = model.last
    expected = np.zeros((k, k))
    total = _lse(forward[chains.ends] + model.last, 1) if chains.most else np.zeros(0)
    for t in range(chains.most - 1, 0, -1):
        rows = chains.rows[t]
        ahead = scores[rows] + backward[rows]
        joint = model.step + ahead[:, None, :]
        backward[rows - 1] = _lse(joint, 2)
        if pairs:
            expected += np.exp(forward[rows - 1][:, :, None] + joint - total[: len(rows), None, None]).sum(0)
    both = forward + backward
    both -= both.max(axis=1, keepdims=True) if n else 0
    out = np.exp(both)
    return out / out.sum(axis=1, keepdims=True) if n else out, expected, float(total.sum())


def chain_marginals(scores: np.ndarray, model: Model, block: int = 100_000) -> np.ndarray:
    """marginals() of one very long sequence with two labels, in normalised numbers and blocks: a few numbers a row are held."""
    n = len(scores)
    out, forward = np.empty((n, 2)), np.empty((n, 2))
    (t00, t01), (t10, t11) = np.exp(model.step - model.step.max()).tolist()
    first, last = (np.exp(x - x.max()).tolist() for x in (model.first, model.last))
    likely = lambda part: np.exp(part - part.max(axis=1, keepdims=True))
    x, y = first
    begun = False
    for a in range(0, n, block):
        rows = []
        for e, f in likely(scores[a : a + block]).tolist():
            if begun:
                x, y = (x * t00 + y * t10) * e, (x * t01 + y * t11) * f
            else:
                x, y, begun = x * e, y * f, True
            total = x + y
            x, y = x / total, y / total
            rows.append((x, y))
        forward[a : a + len(rows)] = rows
    x, y = last
    for a in reversed(range(0, n, block)):
        rows = []
        for e, f in reversed(likely(scores[a : a + block]).tolist()):
            rows.append((x, y))
            e, f = e * x, f * y
            x, y = t00 * e + t01 * f, t10 * e + t11 * f
            total = x + y
            x, y = x / total, y / total
        out[a : a + len(rows)] = forward[a : a + len(rows)] * rows[::-1]
    return out / out.sum(axis=1, keepdims=True) if n else out


def viterbi(scores: np.ndarray, model: Model, chains: Chains) -> np.ndarray:
    """The most probable labels of every row; ties go to the lower label."""
    n, k = scores.shape
    best, back = np.zeros((n, k)), np.zeros((n, k), dtype=np.int64)
    for t, rows in enumerate(chains.rows):
        if t == 0:
            best[rows] = scores[rows] + model.first
        else:
            ways = best[rows - 1][:, :, None] + model.step
            back[rows] = ways.argmax(1)
            best[rows] = scores[rows] + ways.max(1)
    out = np.zeros(n, dtype=np.int64)
    if chains.most:
        out[chains.ends] = (best[chains.ends] + model.last).argmax(1)
    for t in range(chains.most - 1, 0, -1):
        rows = chains.rows[t]
        out[rows - 1] = back[rows, out[rows]]
    return out


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_labels: int = 2, penalty: float = 1.0, steps: int = 150, rate: float = 0.1) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam over all sequences at once; no random numbers are drawn."""
    n, width = features.shape
    chains = Chains(lengths)
    shapes = [(width, n_labels), (n_labels, n_labels), (n_labels,), (n_labels,)]
    values = [np.zeros(s) for s in shapes]
    if not n:
        return Model(*values)
    hot = np.zeros((n, n_labels))
    hot[np.arange(n), labels] = 1
    later = np.ones(n, dtype=bool)
    later[chains.starts] = False
    seen_pairs = np.zeros((n_labels, n_labels))
    at = np.flatnonzero(later)
    np.add.at(seen_pairs, (labels[at - 1], labels[at]), 1)
    scale = 1.0 / n
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for i in range(1, steps + 1):
        model = Model(*values)
        got, expected, _ = marginals(features @ model.weights, model, chains, pairs=True)
        slopes = [features.T @ (got - hot), expected - seen_pairs, (got - hot)[chains.starts].sum(0), (got - hot)[chains.ends].sum(0)]
        pace = rate * (1 if i <= steps * 2 // 3 else 0.3)
        for p, (value, slope) in enumerate(zip(values, slopes, strict=True)):
            slope = slope * scale + penalty * scale * value
            mean[p] = 0.9 * mean[p] + 0.1 * slope
            square[p] = 0.999 * square[p] + 0.001 * slope * slope
            values[p] = value - pace * (mean[p] / (1 - 0.9**i)) / (np.sqrt(square[p] / (1 - 0.999**i)) + 1e-8)
    return Model(*values)
