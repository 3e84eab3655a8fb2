"""Small regression trees for boosting and rule extraction, learned on a bounded table.

The learner runs on the driver over at most the documented sample; what it learns is
applied by Spark as column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float  # rows with a value up to it go left
    low: Split | Leaf
    high: Split | Leaf


Node = Split | Leaf
Condition = tuple[int, bool, float]  # feature, above?, threshold


def cuts(table: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    """Candidate thresholds: midpoints between quantiles of each feature."""
    out = []
    for j in range(table.shape[1]):
        values = np.unique(np.quantile(table[:, j], np.linspace(0, 1, bins + 1), method="inverted_cdf"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def grow(
    table: np.ndarray,
    grad: np.ndarray,
    hess: np.ndarray,
    thresholds: list[np.ndarray],
    depth: int,
    min_rows: int = 10,
    ridge: float = 1.0,
    features: np.ndarray | None = None,
) -> Node:
    """A tree of Newton steps for a loss with these gradients and second derivatives."""
    total_g, total_h = grad.sum(), hess.sum()
    leaf = Leaf(float(-total_g / (total_h + ridge)))
    if depth == 0 or len(grad) < 2 * min_rows:
        return leaf
    best, found = 1e-9, None
    for j in range(table.shape[1]) if features is None else features:
        if not len(thresholds[j]):
            continue
        place = np.searchsorted(thresholds[j], table[:, j], side="left")
        size = len(thresholds[j]) + 1
        g = np.cumsum(np.bincount(place, weights=grad, minlength=size))[:-1]
        h = np.cumsum(np.bincount(place, weights=hess, minlength=size))[:-1]
        n = np.cumsum(np.bincount(place, minlength=size))[:-1]
        gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
        gain[(n < min_rows) | (len(grad) - n < min_rows)] = 0
        if gain.max() > best:
            best, found = gain.max(), (int(j), float(thresholds[j][gain.argmax()]))
    if found is None:
        return leaf
    low = table[:, found[0]] <= found[1]
    parts = [
        grow(table[side], grad[side], hess[side], thresholds, depth - 1, min_rows, ridge, features)
        for side in (low, ~low)
    ]
    return Split(*found, *parts)


def predict(node: Node, table: np.ndarray) -> np.ndarray:
    if isinstance(node, Leaf):
        return np.full(len(table), node.value)
    low = table[:, node.feature] <= node.threshold
    return np.where(low, predict(node.low, table), predict(node.high, table))


def column(node: Node, feature: Callable[[int], Column]) -> Column:
    """The tree as nested conditions."""
    if isinstance(node, Leaf):
        return F.lit(node.value)
    test = feature(node.feature) <= F.lit(node.threshold)
    return F.when(test, column(node.low, feature)).otherwise(column(node.high, feature))


def paths(node: Node, above: tuple[Condition, ...] = ()) -> Iterator[tuple[Condition, ...]]:
    """The conjunction of conditions that leads to each node but the root."""
    if above:
        yield above
    if isinstance(node, Split):
        yield from paths(node.low, (*above, (node.feature, False, node.threshold)))
        yield from paths(node.high, (*above, (node.feature, True, node.threshold)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def boost(
    table: np.ndarray, label: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32
) -> tuple[float, list[Node]]:
    """Gradient boosting for the logistic loss: the prior log-odds and the trees, whose
    values already hold the learning rate."""
    mean = (label.sum() + 0.5) / (len(label) + 1)
    prior = float(np.log(mean / (1 - mean)))
    thresholds, score, out = cuts(table, bins), np.full(len(label), prior), []
    for _ in range(rounds):
        p = sigmoid(score)
        tree = scaled(grow(table, p - label, p * (1 - p), thresholds, depth), rate)
        if isinstance(tree, Leaf):
            break
        out.append(tree)
        score += predict(tree, table)
    return prior, out


def scaled(node: Node, rate: float) -> Node:
    if isinstance(node, Leaf):
        return Leaf(node.value * rate)
    return Split(node.feature, node.threshold, scaled(node.low, rate), scaled(node.high, rate))
