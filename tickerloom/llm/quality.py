"""Document quality from a linear-chain conditional random field over the lines.

Every line gets features of its own and of the lines before and after it, and a label, good or bad.
The chain is fitted on a bounded sample of labelled documents: lines start with the label of
their document, and lines of bad documents that look good are relabelled twice.  Forward-backward
marginals, weighted by the length of the lines, give the document's share of bad text, and a
logistic curve fitted on the same sample turns it into a probability.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrays import LOWER, Prefixes, WHITE, blocks, edges, text_bytes
from tickerloom.llm.store import labelled_sample

SAMPLE = 4_000
SAMPLE_BYTES = 50_000
THRESHOLD = 0.3
KINDS = {  # shares of the bytes of a line
    "letters": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)], "upper": range(0x41, 0x5B), "digits": range(0x30, 0x3A), "white": [0x20, *range(0x09, 0x0E)],
    "bars": [0x7C], "stops": [0x2C, 0x2E, 0x3A, 0x3B], "calls": [0x21, 0x3F], "signs": [*range(0x23, 0x28), 0x2A, 0x2B, 0x2F, 0x3C, 0x3D, 0x3E, 0x40, *range(0x5B, 0x61), 0x7B, 0x7D, 0x7E],
}
MASKS = np.stack([np.isin(np.arange(256), list(x)) for x in KINDS.values()]).astype(np.uint8)
OWN = len(KINDS) + 8


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with those of its neighbours, its bytes, and the number of the first line of each text."""
    feeds = np.flatnonzero(raw == 0x0A)
    # A text begins a line even if it is empty; a feed at its end begins an empty last line.
    per_doc = np.diff(np.searchsorted(feeds, at)) + 1
    first = np.concatenate([[0], np.cumsum(per_doc)])
    order = first[:-1]
    begin = np.empty(first[-1], np.int64)
    begin[order] = at[:-1]
    rest = np.ones(first[-1], bool)
    rest[order] = False
    begin[rest] = feeds + 1
    end = np.empty_like(begin)
    end[first[1:] - 1] = at[1:]
    ahead = np.ones(first[-1], bool)
    ahead[first[1:] - 1] = False
    end[ahead] = feeds
    size = end - begin
    x = np.zeros((len(begin), OWN))
    x[:, 0] = np.log1p(size)
    for k, mask in enumerate(MASKS):
        sums = np.concatenate([[0], np.cumsum(mask[raw], dtype=np.int64)])
        x[:, 1 + k] = (sums[end] - sums[begin]) / np.maximum(size, 1)
    words, stop = edges(~WHITE[raw], at)
    line = np.searchsorted(begin, words, "right") - 1 if len(words) else np.zeros(0, np.int64)
    hashes = Prefixes(LOWER[raw]).of(words, stop)
    count = np.bincount(line, minlength=len(begin))
    def share(mask, of):  # noqa: E306
        return np.bincount(of[mask], minlength=len(begin)) / np.maximum(count, 1)
    k = 1 + len(KINDS)
    x[:, k] = np.log1p(np.bincount(line, stop - words, len(begin)) / np.maximum(count, 1))
    for gap in (1, 2):
        same = np.zeros(len(words), bool)
        same[gap:] = (hashes[gap:] == hashes[:-gap]) & (line[gap:] == line[:-gap])
        x[:, k + gap] = share(same, line)
    last = raw[stop - 1] if len(words) else raw[:0]
    marked = MASKS[list(KINDS).index("signs")][last] | MASKS[list(KINDS).index("calls")][last]
    x[:, k + 3] = share(marked > 0, line)
    x[:, k + 4] = share(stop - words == 1, line)
    some = size > 0
    final = raw[np.maximum(end - 1, 0)] if len(raw) else np.zeros(len(end), np.uint8)
    x[:, k + 5] = some & np.isin(final, [0x21, 0x2E, 0x3F])
    lead = raw[np.minimum(begin, len(raw) - 1)] if len(raw) else np.zeros(len(end), np.uint8)
    x[:, k + 6] = some & (lead >= 0x41) & (lead <= 0x5A)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    ends = np.zeros((len(x), 2))
    ends[first[:-1], 0] = 1
    ends[first[1:] - 1, 1] = 1
    return np.hstack([x, before, after, ends]), size, first


@dataclass
class Chain:
    """Weights of the features for the label bad, scores of the four transitions, and the curve from share to probability."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    slope: float = -1.0
    shift: float = 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def marginals(bad: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of every line and the sum of the pair marginals, by forward-backward over all texts side by side."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right") if len(n) else np.zeros(0, int)
    scores = np.stack([np.zeros_like(bad), bad], axis=1)
    forward, backward = scores.copy(), np.zeros_like(scores)
    for t in range(1, len(active)):
        here = begin[:active[t]] + t
        forward[here] = scores[here] + log_sum(forward[here - 1][:, :, None] + moves, 1)
    for t in range(len(active) - 1, 0, -1):
        here = begin[:active[t]] + t
        backward[here - 1] = log_sum(moves + (scores[here] + backward[here])[:, None, :], 2)
    both = forward + backward
    total = log_sum(both, 1)
    pairs = np.zeros((2, 2))
    later = np.ones(len(bad), bool)
    later[first[:-1]] = False
    here = np.flatnonzero(later)
    if len(here):
        joint = forward[here - 1][:, :, None] + moves + (scores[here] + backward[here])[:, None, :] - total[here][:, None, None]
        pairs = np.exp(joint).sum(axis=0)
    return np.exp(both[:, 1] - total), pairs


def fit_chain(x: np.ndarray, first: np.ndarray, labels: np.ndarray, chain: Chain | None = None, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximise the likelihood of the line labels by Adam steps on the whole sample."""
    if chain is None:
        chain = Chain(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), np.zeros(x.shape[1]), 0.0, np.zeros((2, 2)))
    z = np.clip((x - chain.mean) / chain.scale, -8, 8)
    later = np.ones(len(x), bool)
    later[first[:-1]] = False
    here = np.flatnonzero(later)
    observed = np.zeros((2, 2))
    np.add.at(observed, (labels[here - 1].astype(int), labels[here].astype(int)), 1)
    state = np.concatenate([chain.weights, [chain.bias], chain.moves.reshape(-1)])
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        weights, bias, moves = state[:-5], state[-5], state[-4:].reshape(2, 2)
        p, pairs = marginals(z @ weights + bias, first, moves)
        error = labels - p
        slope = np.concatenate([z.T @ error, [error.sum()], (observed - pairs).reshape(-1)]) / len(x) - decay * state
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        state = state + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(chain.mean, chain.scale, state[:-5], float(state[-5]), state[-4:].reshape(2, 2))


def bad_share(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The expected share of a text, by length, that is in bad lines."""
    weight = np.maximum(size, 1).astype(float)
    return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)


def fit(texts: pa.Array, good: np.ndarray) -> Chain:
    """A chain and its curve from texts with labels (1 good, 0 bad)."""
    parts = [line_features(*text_bytes(part.column(0))) for part in blocks([pa.RecordBatch.from_arrays([texts], ["text"])], "text", 1_000_000)]
    x, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    bad_doc = np.repeat(1 - good, np.diff(first))
    labels, chain = bad_doc.astype(float), None
    for turn in range(3):
        chain = fit_chain(x, first, labels, chain)
        if turn == 2:
            break
        p, _ = marginals(chain.emissions(x), first, chain.moves)
        worst = p >= np.repeat(np.maximum.reduceat(p, first[:-1]), np.diff(first))
        labels = (bad_doc * ((p > 0.5) | worst)).astype(float)
    p, _ = marginals(chain.emissions(x), first, chain.moves)
    share = bad_share(p, size, first)
    u = np.log((share + 1e-3) / (1 - share + 1e-3))
    a, b = -1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit
        q = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = q * (1 - q) + 1e-6
        grad = np.array([((good - q) * u).sum() - 0.1 * (a + 1), (good - q).sum() - 0.01 * b])
        hess = np.array([[(w * u * u).sum() + 0.1, (w * u).sum()], [(w * u).sum(), w.sum() + 0.01]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, grad).clip(-2, 2)
    chain.slope, chain.shift = float(min(a, -1e-3)), float(b)
    return chain


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """Fit on at most ``sample`` documents of ``docs`` (doc_id, text) with a ``label`` (0/1) in ``labels``, of at most ``sample_bytes`` bytes each."""
    chosen = labelled_sample(docs, labels, label, sample, sample_bytes).select("text", "label").toArrow()
    good = chosen.column("label").to_numpy().astype(float)
    if not len(good) or good.min() == good.max():
        warnings.warn(f"{len(good)} usable rows with a label, all of one kind: every text gets the same score", stacklevel=2)
        only = float(good[0]) if len(good) else 1.0
        width = 3 * OWN + 2
        return Chain(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), -1e-9, 4.0 if only else -4.0)
    return fit(chosen.column("text").combine_chunks(), good)


def grade(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    """The batches as they are, with a score for each row's ``graded`` text."""
    for part in blocks(batches, "graded", 1_500_000):
        x, size, first = line_features(*text_bytes(part.column("graded")))
        p, _ = marginals(chain.emissions(x), first, chain.moves)
        share = bad_share(p, size, first)
        u = np.log((share + 1e-3) / (1 - share + 1e-3))
        score = 1 / (1 + np.exp(-np.clip(chain.slope * u + chain.shift, -30, 30)))
        columns = {c: part.column(c) for c in part.schema.names if c != "graded"}
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(score)], [*columns, "score"])


def scored(docs: DataFrame, chain: Chain, score: str = "score") -> DataFrame:
    """``docs`` with all its columns and the probability that the text is good; no shuffle.

    A missing or empty text is one empty line and gets the score of such a line.  A column of the
    name of the score is replaced.
    """
    rows = docs.drop(score)
    inner = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).withColumn("graded", F.coalesce(F.col(f"c{rows.columns.index('text')}"), F.lit("")))
    fields = ", ".join(f"{c} {t}" for c, t in inner.drop("graded").dtypes)
    return inner.mapInArrow(lambda it: grade(it, chain), f"{fields}, score double").toDF(*rows.columns, score)
