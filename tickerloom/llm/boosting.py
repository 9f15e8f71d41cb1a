"""Boosted trees for a yes or no, and the calibration of their scores.

A tree needs of its examples only sums of gradients by node, feature and bin.  So it is fitted where the examples are: each part of them
gives its sums, and the sums of all parts decide on the splits.  Gradients are rounded to multiples of 1 / UNIT, so that
their sums don't depend on the parts or on their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ROUNDS, DEPTH, RATE, BINS, SMOOTH = 60, 3, 0.2, 32, 1.0
UNIT = 2.0**20


def bin_edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The distinct quantiles that cut sorted ``values``, each as often as ``counts`` says, into bins (linear between neighbours)."""
    ends = np.cumsum(counts)
    place = (ends[-1] - 1) * np.linspace(0, 1, BINS + 1)[1:-1]
    low, high = (values[np.searchsorted(ends, at, "right")] for at in (np.floor(place), np.ceil(place)))
    return np.unique(low + (high - low) * (place - np.floor(place)))


def descend(tree, codes: np.ndarray) -> np.ndarray:
    """The node that each row reaches by the splits given: it goes right where its bin is above the split's."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for feature, at in tree:
        node = 2 * node + (codes[rows, feature[node]] > at[node])
    return node


class Trees:
    """Trees fitted to the gradient of the logistic loss, on features cut into few bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [bin_edges(*np.unique(column, return_counts=True)) for column in x.T]
        codes, once = self.codes(x), np.ones(len(y))
        self.fit(y.mean(), lambda splits: self.sums(codes, y, once, splits))

    @classmethod
    def over(cls, edges: list[np.ndarray], rate: float, sums: Callable[[Trees, list], np.ndarray]) -> Trees:
        """Trees on examples that lie elsewhere: ``sums`` adds up what ``Trees.sums`` gives for all parts of them."""
        made = cls.__new__(cls)
        made.edges = edges
        made.fit(rate, lambda splits: sums(made, splits))
        return made

    def fit(self, rate: float, sums: Callable[[list], np.ndarray]) -> None:
        rate = np.clip(rate, 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        for _ in range(ROUNDS):
            splits: list[tuple[np.ndarray, np.ndarray]] = []
            for _ in range(DEPTH):
                g, h = (sums(splits) / UNIT).cumsum(3)
                total_g, total_h = g[:, :, -1:], h[:, :, -1:]
                gains = g**2 / (h + SMOOTH) + (total_g - g) ** 2 / (total_h - h + SMOOTH) - total_g**2 / (total_h + SMOOTH)
                best = gains.reshape(len(gains), -1).argmax(1)
                splits.append((best // BINS, best % BINS))
            here = np.arange(len(best)), *splits[-1]
            halves = [np.stack([s[here], s[here[0], here[1], -1] - s[here]], 1).ravel() for s in (g, h)]
            self.trees.append([*splits, (RATE * halves[0] / (halves[1] + SMOOTH),)])

    def sums(self, codes: np.ndarray, y: np.ndarray, times: np.ndarray, splits: list) -> np.ndarray:
        """Gradient and weight, in units, of some examples, by the nodes of a tree that has ``splits`` so far, feature and bin."""
        p = 1 / (1 + np.exp(-self.margin(codes)))
        node, nodes = descend(splits, codes), 2 ** len(splits)
        out = np.empty((2, nodes, codes.shape[1], BINS))
        for k, each in enumerate((y - p, p * (1 - p))):
            each = times * np.rint(each * UNIT)
            for f in range(codes.shape[1]):
                out[k, :, f] = np.bincount(node * BINS + codes[:, f], each, nodes * BINS).reshape(nodes, BINS)
        return out

    def margin(self, codes: np.ndarray) -> np.ndarray:
        return self.start + sum((t[-1][0][descend(t[:-1], codes)] for t in self.trees), np.zeros(len(codes)))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, column, "left") for e, column in zip(self.edges, x.T)], 1)

    def coded_scores(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(codes)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.coded_scores(self.codes(x)) if len(x) else np.zeros(0)


def isotonic(scores: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least score and share of yes of each step of the best rising step function (neighbours that fall are pooled).

    ``y`` is the number of yes among ``times`` examples with that score; without ``times`` each is one example.
    """
    levels, place = np.unique(scores, return_inverse=True)
    steps: list[list[float]] = []
    for level, yes, n in zip(levels, np.bincount(place, y, len(levels)), np.bincount(place, times, len(levels))):
        steps.append([level, float(yes), float(n)])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, s, n1 = steps.pop()
            steps[-1][1] += s
            steps[-1][2] += n1
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


def calibrated(scores: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The share of yes at each score; 0 below the first step."""
    at = np.searchsorted(steps[0], scores, "right")
    return np.concatenate([[0.0], steps[1]])[at]
