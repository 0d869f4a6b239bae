"""Histogram gradient-boosted trees for two classes, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes by level, then leaves. ``feature`` and ``threshold`` are (trees, inner), ``leaf`` (trees, leaves)."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of ``x``: one step down per level for all rows at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - len(f)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def expression(self, columns: list[Column]) -> Column:
        """The log odds as one Spark expression."""
        def below(k: int, node: int) -> Column:
            inner = len(self.feature[k])
            if node >= inner:
                return F.lit(float(self.leaf[k][node - inner]))
            left, right = below(k, 2 * node + 1), below(k, 2 * node + 2)
            if not np.isfinite(self.threshold[k][node]):
                return left
            return F.when(columns[self.feature[k][node]] > float(self.threshold[k][node]), right).otherwise(left)

        total = F.lit(float(self.base))
        for k in range(len(self.feature)):
            total = total + below(k, 0)
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, weight: float = 1.0, least: float = 5.0) -> Trees:
    """Boost ``trees`` trees on log loss. Values are binned by quantiles once; splits are looked for between bins.

    Without rows, or with rows of one class, the score is a constant.
    """
    n, width = x.shape
    inner = 2**depth - 1
    empty = Trees(0.0, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not n:
        return empty
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        empty.base = base
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    out = Trees(base, depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    margin = np.full(n, base)
    rows = np.arange(n)
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        cut = np.full(inner, bins + 1)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = node - first
            best = np.full(many, 1e-6)
            for f in range(width):
                key = at * (bins + 1) + binned[:, f]
                sums = [np.bincount(key, v, many * (bins + 1)).reshape(many, bins + 1) for v in (g, h)]
                left = [np.cumsum(s, axis=1)[:, :-1] for s in sums]
                all_g, all_h = sums[0].sum(axis=1, keepdims=True), sums[1].sum(axis=1, keepdims=True)
                right = [all_g - left[0], all_h - left[1]]
                gain = left[0] ** 2 / (left[1] + weight) + right[0] ** 2 / (right[1] + weight) - all_g**2 / (all_h + weight)
                gain[(left[1] < least / 20) | (right[1] < least / 20)] = 0
                gain[:, len(edges[f]):] = 0
                where = gain.argmax(axis=1)
                got = gain[np.arange(many), where]
                for i in np.flatnonzero(got > best):
                    best[i] = got[i]
                    out.feature[k, first + i], cut[first + i], out.threshold[k, first + i] = f, where[i], edges[f][where[i]]
            node = 2 * node + 1 + (binned[rows, out.feature[k][node]] > cut[node])
        leaf = node - inner
        out.leaf[k] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + weight)
        margin += out.leaf[k][leaf]
    return out
