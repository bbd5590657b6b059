"""Isolation forest in numpy: trees on small samples, scores in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES = 100


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1: leaf), split, children, path length at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2 ** (-mean path / usual path): lower is more anomalous."""
        total = np.zeros(len(x))
        for feature, split, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            going = feature[at] >= 0
            while going.any():
                rows = np.flatnonzero(going)
                node = at[rows]
                low = x[rows, feature[node]] < split[node]
                at[rows] = np.where(low, left[node], right[node])
                going[rows] = feature[at[rows]] >= 0
            total += length[at]
        return -(2.0 ** (-total / len(self.trees) / self.usual))


def usual_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def fit_forest(x: np.ndarray, sample: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    deepest = int(np.ceil(np.log2(max(2, size))))
    trees = []
    for _ in range(TREES):
        feature, split, left, right, length = [], [], [], [], []

        def grow(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            for a in (feature, split, left, right, length):
                a.append(-1)
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
            if depth >= deepest or len(rows) <= 1 or not len(spread):
                length[me] = depth + usual_path(len(rows))
                return me
            f = int(rng.choice(spread))
            s = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            feature[me], split[me] = f, s
            below = rows[:, f] < s
            left[me] = grow(rows[below], depth + 1)
            right[me] = grow(rows[~below], depth + 1)
            return me

        grow(x[rng.choice(len(x), size, replace=False)], 0)
        trees.append(tuple(np.array(a, t) for a, t in ((feature, np.int64), (split, float), (left, np.int64), (right, np.int64), (length, float))))
    return Forest(trees, max(usual_path(size), 1e-9))
