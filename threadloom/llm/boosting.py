"""Gradient boosting over cells: rows that agree in all features are one cell with two counts.

Features are small whole numbers, so a table of any size comes down to as many cells as there are combinations of
values; trees are grown on these in the driver and go back to the table as CASE expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Splits on two features; leaves by (first above its cut, second above its cut)."""

    first: tuple[int, int]
    second: tuple[int, int]
    leaves: tuple[float, float, float, float]

    def value(self, x: tuple[int, ...]) -> float:
        (f, a), (g, b) = self.first, self.second
        return self.leaves[2 * (x[f] > a) + (x[g] > b)]

    def column(self, features: list[Column]) -> Column:
        (f, a), (g, b) = self.first, self.second
        below, above = ([F.lit(float(v)) for v in self.leaves[i : i + 2]] for i in (0, 2))
        pick = lambda pair: F.when(features[g] > b, pair[1]).otherwise(pair[0])
        return F.when(features[f] > a, pick(above)).otherwise(pick(below))


@dataclass(frozen=True)
class Boosted:
    bias: float
    trees: tuple[Tree, ...]
    threshold: float

    def margin(self, x: tuple[int, ...]) -> float:
        return self.bias + sum(t.value(x) for t in self.trees)

    def selects(self, features: list[Column]) -> Column:
        """Is a row's margin at the calibrated threshold or beyond?"""
        out = F.lit(float(self.bias))
        for t in self.trees:
            out = out + t.column(features)
        return out >= F.lit(float(self.threshold) - 1e-8)


def boost(cells: dict[tuple[int, ...], tuple[int, int]], calibrate: dict[tuple[int, ...], tuple[int, int]] | None = None, rounds: int = 24, rate: float = 0.4, ridge: float = 1.0, precision: float = 0.95, support: int = 20) -> Boosted:
    """Fits ``cells``: features to (rows with label 1, all rows).

    The threshold is the lowest margin at which cells of ``calibrate`` (rows that were not fitted; ``cells`` itself if
    it is None) from the top down hold at least ``precision`` of label 1 and ``support`` rows; where there is none,
    nothing is selected.
    """
    xs = sorted(cells)
    pos, all_ = [cells[x][0] for x in xs], [cells[x][1] for x in xs]
    bias = math.log((sum(pos) + 0.5) / (sum(all_) - sum(pos) + 0.5))
    margin = [bias] * len(xs)
    cuts = [(f, c) for f in range(len(xs[0]) if xs else 0) for c in sorted({x[f] for x in xs})[:-1]]
    trees: list[Tree] = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [k - n * q for k, n, q in zip(pos, all_, p, strict=True)]
        h = [n * q * (1 - q) for n, q in zip(all_, p, strict=True)]
        best, gain = None, 1e-6
        for i, first in enumerate(cuts):
            for second in cuts[i + 1 :] or [first]:
                sums = [[0.0, 0.0] for _ in range(4)]
                for x, a, b in zip(xs, g, h, strict=True):
                    leaf = sums[2 * (x[first[0]] > first[1]) + (x[second[0]] > second[1])]
                    leaf[0] += a
                    leaf[1] += b
                if (own := sum(a * a / (b + ridge) for a, b in sums)) > gain:
                    best, gain = Tree(first, second, tuple(rate * a / (b + ridge) for a, b in sums)), own
        if best is None:
            break
        trees.append(best)
        margin = [m + best.value(x) for m, x in zip(margin, xs, strict=True)]
    model = Boosted(bias, tuple(trees), math.inf)
    threshold, hit, seen = math.inf, 0, 0
    ranked = sorted(((round(model.margin(x), 9), k, n) for x, (k, n) in (cells if calibrate is None else calibrate).items()), reverse=True)
    for i, (m, k, n) in enumerate(ranked):
        hit, seen = hit + k, seen + n
        if (i + 1 == len(ranked) or ranked[i + 1][0] < m) and seen >= support and hit >= precision * seen:
            threshold = m - 1e-9  # of a rounded margin
    return Boosted(bias, model.trees, threshold)
