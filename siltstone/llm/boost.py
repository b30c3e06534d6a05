"""Gradient-boosted trees for a yes or no, small enough to train on the driver from a bounded sample and to travel with each task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Forest:
    """Full binary trees of one depth, in level order: ``feature`` and ``threshold`` of each split, ``value`` of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (rows[at_row, feature[at]] > threshold[at])
            out += value[at - (len(value) - 1)]
        return out


def fit(rows: np.ndarray, labels: np.ndarray, *, trees: int = 80, depth: int = 5, rate: float = 0.3, ridge: float = 2.0, least: int = 8, row_share: float = 0.6, feature_share: float = 0.6, seed: int = 7) -> Forest:
    """Trees that each lower the logistic loss of those before, split where the second-order gain is greatest.

    Each tree draws its shares of rows and features by the seed, and ties go to the first feature and the lowest threshold, so
    the same rows give the same forest.  No rows: a forest that says even odds.  A split that leaves fewer than ``least`` rows on a side, or gains nothing, sends all rows to the left.
    """
    n = len(rows)
    inner, leaves = 2**depth - 1, 2**depth
    empty = Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not n:
        return empty
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = (labels.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    two_valued = np.array([f for f, e in enumerate(edges) if len(np.unique(rows[:, f])) == 2 and len(e) and (rows[:, f] <= e[0]).sum() < n and len(e) < 3], dtype=np.int64)

    def gains(g, h, k, all_g, all_h, all_k) -> np.ndarray:
        """What a split with the sums ``g``, ``h``, ``k`` on its left lowers the loss by; nothing if a side has too few rows."""
        gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
        return np.where((k >= least) & (all_k - k >= least), gain, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        own = np.flatnonzero(rng.random(n) < row_share) if n > least / row_share else np.arange(n)
        looked = np.flatnonzero(rng.random(rows.shape[1]) < feature_share)
        gradient, curve = (labels - p)[own], (p * (1 - p))[own]
        at = np.zeros(len(own), np.int64)
        some = two_valued[np.isin(two_valued, looked)]
        high = binned[np.ix_(own, some)].astype(np.float64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.zeros(wide)
            chosen, bound = np.zeros(wide, np.int64), np.full(wide, BINS, np.int64)
            nodes = np.arange(wide)
            # features of two values: sums over all of them at once
            within = (at - first)[None, :] == nodes[:, None]
            total = [(within * w).sum(axis=1, keepdims=True) for w in (gradient, curve, 1.0)]
            upper = [(within * w) @ high for w in (gradient, curve, 1.0)]
            gain = gains(*[t - u for t, u in zip(total, upper, strict=True)], *total)
            if len(some):
                top = gain.argmax(axis=1)
                better = gain[nodes, top] > 1e-9
                best, chosen, bound = np.where(better, gain[nodes, top], best), np.where(better, some[top], chosen), np.where(better, 0, bound)
            spot = (at - first) * BINS
            for f in looked[~np.isin(looked, two_valued)]:
                if not len(edges[f]):
                    continue
                where = spot + binned[own, f]
                left = [np.bincount(where, weights=w, minlength=wide * BINS).reshape(wide, BINS).cumsum(axis=1) for w in (gradient, curve, None)]
                gain = gains(*left, *[x[:, -1:] for x in left])
                top = gain.argmax(axis=1)
                better = gain[nodes, top] > best + 1e-9
                best = np.where(better, gain[nodes, top], best)
                chosen, bound = np.where(better, f, chosen), np.where(better, top, bound)
            feature[first : first + wide] = chosen
            threshold[first : first + wide] = [edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(chosen, bound, strict=True)]
            at = 2 * at + 1 + (rows[own, feature[at]] > threshold[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, weights=gradient, minlength=leaves) / (np.bincount(leaf, weights=curve, minlength=leaves) + ridge)
        score += Forest(0.0, feature[None], threshold[None], value[None]).margins(rows)
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.stack(features), np.stack(thresholds), np.stack(values))
