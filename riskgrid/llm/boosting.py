"""Gradient-boosted trees for a bounded training sample: logistic loss over binned features."""

from __future__ import annotations

import numpy as np

Tree = list[tuple[int, float, int, int, float]]


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, rate: float) -> Tree:
    """Nodes (feature, threshold, left, right, value); a leaf has feature -1."""
    tree: Tree = []

    def node(rows: np.ndarray, left: int) -> int:
        at = len(tree)
        g, h = grad[rows].sum(), hess[rows].sum()
        tree.append((-1, 0.0, -1, -1, float(rate * g / (h + 1.0))))
        best = (1e-6, -1, 0)
        if left:
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                gs = np.bincount(bins[rows, f], grad[rows], len(cuts) + 1).cumsum()[:-1]
                hs = np.bincount(bins[rows, f], hess[rows], len(cuts) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
                gain[(hs < 1.0) | (h - hs < 1.0)] = 0.0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            low = bins[rows, f] <= k
            a, b = node(rows[low], left - 1), node(rows[~low], left - 1)
            tree[at] = (f, float(edges[f][k]), a, b, 0.0)
        return at

    node(np.arange(len(bins)), depth)
    return tree


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> tuple[float, list[Tree]]:
    """(base score, trees) for features x and labels y in 0..1."""
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return base, []
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        cuts = (values[1:] + values[:-1]) / 2
        edges.append(cuts if len(cuts) <= 32 else np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])))
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-score))
        tree = _grow(bins, edges, y - chance, chance * (1 - chance), depth, rate)
        trees.append(tree)
        score += _value(tree, x)
    return base, trees


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    at, table = np.zeros(len(x), int), np.array(tree)
    for _ in range(len(tree)):
        f = table[at, 0].astype(int)
        if (f < 0).all():
            break
        low = x[np.arange(len(x)), np.maximum(f, 0)] <= table[at, 1]
        at = np.where(f < 0, at, np.where(low, table[at, 2], table[at, 3]).astype(int))
    return table[at, 4]


def chance(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    """Probability of label 1."""
    base, trees = model
    score = np.full(len(x), base)
    for tree in trees:
        score += _value(tree, x)
    return 1 / (1 + np.exp(-score))
