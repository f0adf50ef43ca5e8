"""Gradient-boosted trees over small whole-number features, fitted on counted rows.

The rows of any number of examples are grouped by their features beforehand, so the fit sees one row
for each combination that occurs, with the number of examples and of positives. Trees become CASE
expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TREES, DEPTH, RATE, SHRINK = 24, 2, 0.4, 1.0

Node = float | tuple[int, int, "Node", "Node"]


@dataclass(frozen=True)
class Trees:
    """``base`` and trees: a leaf is a number, a node (feature, value, if equal, if not)."""

    base: float
    trees: tuple[Node, ...]

    def margin(self, row: Sequence[int]) -> float:
        total = self.base
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] == node[1] else node[3]
            total += node
        return total

    def column(self, features: Callable[[int], Column]) -> Column:
        """The margin, from the column of each feature."""

        def walk(node: Node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(round(node, 6))
            return F.when(features(node[0]) == node[1], walk(node[2])).otherwise(walk(node[3]))

        return sum((walk(t) for t in self.trees), F.lit(round(self.base, 6)))


def fit(rows: Sequence[tuple[Sequence[int], float, float]]) -> Trees:
    """From (features, examples, positives)."""
    examples, positives = sum(r[1] for r in rows), sum(r[2] for r in rows)
    base = math.log((positives + 1) / (examples - positives + 1))
    margins = [base] * len(rows)
    trees = []
    for _ in range(TREES):
        slopes, bends = [], []
        for (_, n, p), margin in zip(rows, margins):
            chance = 1 / (1 + math.exp(-margin))
            slopes.append(p - n * chance)
            bends.append(n * chance * (1 - chance))
        tree = _grow(rows, slopes, bends, range(len(rows)), DEPTH)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        margins = [m + _leaf(tree, r[0]) for m, r in zip(margins, rows)]
    return Trees(base, tuple(trees))


def _leaf(node: Node, row: Sequence[int]) -> float:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] == node[1] else node[3]
    return node


def _grow(rows, slopes, bends, at: Sequence[int], depth: int) -> Node:
    slope, bend = sum(slopes[i] for i in at), sum(bends[i] for i in at)
    leaf = RATE * slope / (bend + SHRINK)
    if not depth:
        return leaf
    best = None
    for feature in range(len(rows[0][0]) if rows else 0):
        sums: dict[int, list[float]] = {}
        for i in at:
            own = sums.setdefault(rows[i][0][feature], [0.0, 0.0])
            own[0] += slopes[i]
            own[1] += bends[i]
        for value, (s, b) in sums.items():
            if len(sums) == 1:
                continue
            gain = s * s / (b + SHRINK) + (slope - s) ** 2 / (bend - b + SHRINK) - slope * slope / (bend + SHRINK)
            if gain > 1e-9 and (best is None or (gain, -feature, -value) > best[0]):
                best = ((gain, -feature, -value), feature, value)
    if best is None:
        return leaf
    _, feature, value = best
    yes = [i for i in at if rows[i][0][feature] == value]
    no = [i for i in at if rows[i][0][feature] != value]
    return feature, value, _grow(rows, slopes, bends, yes, depth - 1), _grow(rows, slopes, bends, no, depth - 1)
