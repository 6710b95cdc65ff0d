"""Gradient-boosted trees over yes/no features, fitted on counted feature patterns and applied as SQL expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Row = tuple[tuple[bool, ...], int, int]  # features, positives, all


@dataclass(frozen=True)
class Tree:
    """Splits on a feature, each side on another one; leaves add to the log-odds. A feature of -1 makes one leaf of both."""

    feature: int
    sides: tuple[tuple[int, float, float], tuple[int, float, float]]  # if not, if so: feature, leaf if not, leaf if so

    def value(self, x: tuple[bool, ...]) -> float:
        f, no, yes = self.sides[x[self.feature]]
        return yes if x[f] else no

    def column(self, x: list[Column]) -> Column:
        leaf = lambda side: F.when(x[side[0]], F.lit(side[2])).otherwise(F.lit(side[1]))
        return F.when(x[self.feature], leaf(self.sides[1])).otherwise(leaf(self.sides[0]))


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[Tree, ...]
    threshold: float

    def score(self, x: tuple[bool, ...]) -> float:
        return 1 / (1 + math.exp(-self.base - sum(t.value(x) for t in self.trees)))

    def column(self, x: list[Column]) -> Column:
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.column(x)
        return 1 / (1 + F.exp(-total))


def _best(rows: list[tuple[tuple[bool, ...], float, float]], n: int, ridge: float) -> tuple[float, int, float, float]:
    """(gain, feature, leaf if not, leaf if so) of the best split; rows: features, gradient, curvature."""
    best = (-1.0, 0, 0.0, 0.0)
    for f in range(n):
        sums = [[0.0, 0.0], [0.0, 0.0]]
        for x, g, h in rows:
            sums[x[f]][0] += g
            sums[x[f]][1] += h
        gain = sum(g * g / (h + ridge) for g, h in sums)
        if gain > best[0] + 1e-12:
            best = (gain, f, *(g / (h + ridge) for g, h in sums))
    return best


def fit(rows: list[Row], n_features: int, rounds: int = 30, rate: float = 0.3, ridge: float = 1.0, precision: float = 0.9, held: list[Row] | None = None) -> Model:
    """Boosted trees of depth two on logistic loss, and a threshold calibrated to the wanted precision.

    rows: feature patterns with positives and all of them, at most 2 ** n_features whatever the corpus. held: the same
    of texts that the trees aren't fitted on. The threshold is the lowest score down to which every pattern's positives
    are at least `precision` of its held rows (of its own ones where no held row has it); without such a score, or
    without rows, nothing passes it.
    """
    rows = sorted(rows)
    n, positives = sum(r[2] for r in rows), sum(r[1] for r in rows)
    base = math.log((positives + 1) / (n - positives + 1))
    trees: list[Tree] = []
    odds = {x: base for x, _, _ in rows}
    for _ in range(rounds if rows else 0):
        slope = []
        for x, pos, every in rows:
            p = 1 / (1 + math.exp(-odds[x]))
            slope.append((x, pos - every * p, every * p * (1 - p)))
        _, feature, _, _ = _best(slope, n_features, ridge)
        sides = []
        for side in (False, True):
            _, f, no, yes = _best([r for r in slope if r[0][feature] == side], n_features, ridge)
            sides.append((f, rate * no, rate * yes))
        tree = Tree(feature, (sides[0], sides[1]))
        trees.append(tree)
        odds = {x: v + tree.value(x) for x, v in odds.items()}
    model, threshold = Model(base, tuple(trees), 2.0), 2.0
    known = {x: (pos, count) for x, pos, count in rows} | {x: (pos, count) for x, pos, count in held or []}
    for score, pos, count in sorted(((model.score(x), *n) for x, n in known.items()), reverse=True):
        if pos < precision * count:
            break
        threshold = score
    return Model(base, tuple(trees), threshold - 1e-9)
