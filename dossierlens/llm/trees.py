"""A decision tree and a random forest for small labelled tables of numbers.

Trained on the driver from a table whose size is fixed by its maker; applied in numpy inside
tasks. A tree is four arrays, so it is a few kilobytes to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Node ``i`` asks ``x[feature] <= threshold``: yes is ``left``, no is ``left + 1``;
    a leaf has feature -1. ``share`` is the share of positive rows that reached it."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    share: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        while len(rows):
            asking = np.flatnonzero(self.feature[at] >= 0)
            if not len(asking):
                break
            node = at[asking]
            no = rows[asking, self.feature[node]] > self.threshold[node]
            at[asking] = self.left[node] + no
        return self.share[at]


def _best_split(rows: np.ndarray, labels: np.ndarray, features: np.ndarray, min_leaf: int):
    """The split of least Gini impurity; ties go to the lower feature, then threshold."""
    n, best = len(labels), (np.inf, -1, 0.0)
    for feature in features:
        order = np.argsort(rows[:, feature], kind="stable")
        values, positive = rows[order, feature], np.cumsum(labels[order])
        k = np.flatnonzero(values[1:] > values[:-1]) + 1
        k = k[(k >= min_leaf) & (n - k >= min_leaf)]
        if not len(k):
            continue
        left, total = positive[k - 1], positive[-1]
        impurity = left * (1 - left / k) + (total - left) * (1 - (total - left) / (n - k))
        i = int(impurity.argmin())
        if impurity[i] < best[0] - 1e-12:
            best = (impurity[i], int(feature), (values[k[i] - 1] + values[k[i]]) / 2)
    return best


def fit_tree(
    rows: np.ndarray,
    labels: np.ndarray,
    max_depth: int = 8,
    min_leaf: int = 2,
    features_per_split: int | None = None,
    rng: np.random.Generator | None = None,
) -> Tree:
    nodes: list[list] = [[-1, 0.0, 0, float(labels.mean()) if len(labels) else 0.0]]
    todo = [(0, np.arange(len(labels)), 0)]
    while todo:
        at, mine, depth = todo.pop()
        y = labels[mine]
        if depth == max_depth or not len(y) or y.min() == y.max():
            continue
        features = np.arange(rows.shape[1])
        if features_per_split:
            features = np.sort(rng.choice(features, features_per_split, replace=False))
        impurity, feature, threshold = _best_split(rows[mine], y, features, min_leaf)
        if feature < 0:
            continue
        yes = rows[mine, feature] <= threshold
        nodes[at][:3] = [feature, threshold, len(nodes)]
        for side in (mine[yes], mine[~yes]):
            todo.append((len(nodes), side, depth + 1))
            nodes.append([-1, 0.0, 0, float(labels[side].mean())])
    feature, threshold, left, share = zip(*nodes)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(share))


@dataclass(frozen=True)
class Forest:
    trees: list[Tree]

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """The mean share of the trees."""
        return np.mean([tree.predict(rows) for tree in self.trees], axis=0)


def fit_forest(rows: np.ndarray, labels: np.ndarray, n_trees: int = 25, max_depth: int = 10, seed: int = 7) -> Forest:
    """Trees on bootstrap samples, each split seeing the square root of the features."""
    rng = np.random.default_rng(seed)
    some = max(1, round(rows.shape[1] ** 0.5))
    trees = []
    for _ in range(n_trees):
        drawn = rng.integers(0, len(labels), len(labels))
        trees.append(fit_tree(rows[drawn], labels[drawn], max_depth, 2, some, rng))
    return Forest(trees)
