"""Bands from past residuals, cut by cut: rolling conformal ranks and adaptive levels.

Both start from counts of residuals by regime, cut and rounded residual, so that what one task
walks over grows with the cuts and the distinct rounded residuals, not with the entities.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 3

#: Coverage that a level must have in the validation window, overall and by regime;
#: the bounds of an adaptive level.
GUARD_LOW, GUARD_HIGH = 0.94, 0.98
LEVEL_LOW, LEVEL_HIGH = 0.5, 0.999


def residual_counts(rows: DataFrame, y: str, prediction: str) -> DataFrame:
    """regime, p, residual and n. Rows without a target or prediction are left out."""
    residual = F.round(F.abs(F.col(y) - F.col(prediction)), DIGITS).alias("residual")
    return rows.select("regime", "p", residual).where("residual IS NOT NULL").groupBy("regime", "p", "residual").agg(F.count(F.lit(1)).alias("n"))


class Past:
    """Counts of the residuals of earlier cuts over their sorted values."""

    def __init__(self, values: np.ndarray):
        self.values, self.counts = values, np.zeros(len(values), np.int64)

    def ranked(self, rank: int) -> float:
        return float(self.values[np.searchsorted(np.cumsum(self.counts), rank)])

    def conformal(self, alpha: float) -> float:
        n = int(self.counts.sum())
        return self.ranked(int(min(max(np.ceil((n + 1) * (1 - alpha)), 1), n)))

    def quantile(self, q: float) -> float:
        n = int(self.counts.sum())
        at = (n - 1) * q
        below = int(np.floor(at))
        a, b = self.ranked(below + 1), self.ranked(min(below + 2, n))
        return a + (b - a) * (at - below)


def _walk(counts, start: int, step: Callable, seen: dict[float, int] | None = None):
    """p, *step(past, rows of the cut), for each cut from start on that has a past; seen: counts of residuals before these."""
    counts, seen = counts.sort_values(["p", "residual"]), seen or {}
    values = np.union1d(counts["residual"].to_numpy(float), np.fromiter(seen, float, len(seen)))
    past = Past(values)
    for residual, n in seen.items():
        past.counts[np.searchsorted(values, residual)] = n
    for p, cut in counts.groupby("p", sort=True):
        e, n = cut["residual"].to_numpy(), cut["n"].to_numpy()
        if p >= start and past.counts.any():
            yield (p, *step(past, e, n))
        np.add.at(past.counts, np.searchsorted(past.values, e), n)


class Level:
    """An adaptive level, moved by each cut."""

    def __init__(self, gamma: float, target: float, level: float):
        self.gamma, self.target, self.level = gamma, target, level

    def step(self, past: Past, e: np.ndarray, n: np.ndarray) -> tuple[float, float, int, int]:
        q = min(max(self.level, LEVEL_LOW), LEVEL_HIGH)
        width, total = past.quantile(q), int(n.sum())
        covered = int(n[e <= width].sum())
        self.level += self.gamma * (self.target - covered / total)
        return q, width, total, covered

    def walked(self, rows, start: int, regime: str, seen: dict[float, int] | None = None):
        import pandas as pd

        out = pd.DataFrame(list(_walk(rows, start, self.step, seen)), columns=["p", "q", "width", "n", "covered"])
        return out.assign(gamma=self.gamma, regime=regime)


ADAPTED = "p int, q double, width double, n bigint, covered bigint, gamma double, regime string"


def rolling(counts: DataFrame, alphas: Sequence[float], start: int) -> DataFrame:
    """Bands by the conformal rank of all earlier residuals of the regime, for each alpha."""

    def run(key, rows):
        import pandas as pd

        def step(past, e, n):
            width = past.conformal(key[0])
            return width, int(n.sum()), int(n[e <= width].sum())

        out = pd.DataFrame(list(_walk(rows, start, step)), columns=["p", "width", "n", "covered"])
        return out.assign(alpha=key[0], regime=key[1])

    each = counts.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    return each.groupBy("alpha", "regime").applyInPandas(run, "p int, width double, n bigint, covered bigint, alpha double, regime string")


def adaptive(counts: DataFrame, gammas: Sequence[float], target: float, start: int) -> DataFrame:
    """Adaptive conformal bands: the quantile of earlier residuals at a level that moves, after each cut, by gamma times the missed coverage."""

    def run(key, rows):
        return Level(key[0], target, target).walked(rows, start, key[1])

    each = counts.withColumn("gamma", F.explode(F.array(*map(F.lit, gammas))))
    return each.groupBy("gamma", "regime").applyInPandas(run, ADAPTED)


def _coverage(where: Column) -> Column:
    return F.sum(F.when(where, F.col("covered"))) / F.sum(F.when(where, F.col("n")))


def guarded_choice(bands: DataFrame, first: int, last: int) -> DataFrame:
    """bands with selected: the largest alpha whose coverage in the window is in the guard, overall and in each regime.

    Without one, the alpha of the highest overall coverage, the smaller of equals.
    """
    window = bands.where(F.col("p").between(first, last))
    each = window.groupBy("alpha", "regime").agg(F.sum("covered").alias("covered"), F.sum("n").alias("n"))
    inside = lambda c: c.between(GUARD_LOW, GUARD_HIGH)
    whole = _coverage(F.lit(True))
    levels = each.groupBy("alpha").agg(whole.alias("whole"), (inside(whole) & F.min(inside(F.col("covered") / F.col("n")))).alias("passes"))
    best = F.coalesce(F.max(F.when(F.col("passes"), F.col("alpha"))), F.max_by("alpha", F.struct("whole", -F.col("alpha"))))
    return bands.crossJoin(F.broadcast(levels.agg(best.alias("best")))).withColumn("selected", F.col("alpha") == F.col("best")).drop("best")  # one row


def nearest_choice(bands: DataFrame, target: float, last: int) -> DataFrame:
    """bands with selected: the gamma whose coverage up to last is nearest to the target, the smaller of equals."""
    levels = bands.where(F.col("p") <= last).groupBy("gamma").agg(F.abs(_coverage(F.lit(True)) - target).alias("miss"))
    best = F.min_by("gamma", F.struct("miss", "gamma"))
    return bands.crossJoin(F.broadcast(levels.agg(best.alias("best")))).withColumn("selected", F.col("gamma") == F.col("best")).drop("best")  # one row
