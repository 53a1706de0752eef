"""Walk-forward generalised linear models and grids of quantile regressions, all moved by the same passes.

A pass over blocks of rows gives the equations of every model at once: of all cuts of a
walk-forward, or of all groups and quantiles of a grid. A row counts for each cut after its
month, so no cut's training set is ever built. What comes back is models x features squared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import passes

#: Fixed value: the models' penalty. Bounds of passes, and the gradient at which a cut has arrived.
ALPHA = 0.1
PASSES, ARRIVED, FAR = 60, 1e-9, 30.0


def _squares(x: np.ndarray) -> np.ndarray:
    return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


def link_terms(eta: np.ndarray, y: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half the deviance of a Tweedie family with a log link (power 1: Poisson), without what only y has, and its derivatives by eta."""
    eta = np.clip(eta, -FAR, FAR)
    if power == 1:
        mean = np.exp(eta)
        return mean - y * eta, mean - y, mean
    a, b = np.exp((2 - power) * eta), y * np.exp((1 - power) * eta)
    return a / (2 - power) + b / (power - 1), a - b, (2 - power) * a + (power - 1) * b


def walk_forward(df: DataFrame, names: Sequence[str], y: str, cut: str, start: int, power: float, alpha: float = ALPHA) -> DataFrame:
    """A row for each cut from start on: cut, n, intercept and weights, fitted on all rows before it.

    Ridge on features that are standardised over the cut's own training rows; the intercept is
    free. Moments of all cuts are running sums over a row a month. Newton's steps are halved
    where a cut's loss would rise. Null features count as 0, rows without a target are left
    out; cuts without any event before them have no row.
    """
    spark, k = df.sparkSession, len(names)
    x = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    rows = df.where(F.col(y).isNotNull())
    sums = rows.groupBy(F.col(cut).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("y"), F.array(*map(F.sum, x)).alias("s"), F.array(*[F.sum(c * c) for c in x]).alias("ss"))
    months = sorted(sums.collect(), key=lambda r: r.p)  # a row a month
    cuts = [r.p for r in df.where(F.col(cut) >= start).select(F.col(cut).alias("p")).distinct().orderBy("p").collect()]
    at = np.array([r.p for r in months])
    running = lambda c: np.cumsum(np.array([getattr(r, c) for r in months], float).reshape(len(months), -1), 0)
    whole = {c: running(c) for c in ("n", "y", "s", "ss")} if months else {}
    cuts = [c for c in cuts if (at < c).any() and whole["y"][(at < c).sum() - 1, 0] > 0]
    schema = f"{cut} {df.schema[cut].dataType.simpleString()}, n long, intercept double, weights array<double>"
    if not cuts:
        return spark.createDataFrame([], schema)
    last = np.array([(at < c).sum() - 1 for c in cuts])
    n = whole["n"][last, 0]
    spread2 = np.maximum(whole["ss"][last] / n[:, None] - (whole["s"][last] / n[:, None]) ** 2, 0.0)
    total = whole["n"][-1, 0]
    middle = whole["s"][-1] / total
    scale = np.sqrt(np.maximum(whole["ss"][-1] / total - middle**2, 1e-12))
    penalty = np.column_stack([np.zeros(len(cuts)), alpha * spread2 / scale**2])
    blocks = passes.packed(rows, [*names, y, cut])
    ends = np.array(cuts, float)

    def totals(beta: np.ndarray) -> np.ndarray:
        def one(data: bytes) -> np.ndarray:
            m = np.frombuffer(data).reshape(-1, k + 2)
            z = np.column_stack([np.ones(len(m)), (m[:, :k] - middle) / scale])
            parts = [np.where(m[:, k + 1, None] < ends, t, 0.0) for t in link_terms(z @ beta.T, m[:, k, None], power)]
            return np.column_stack([parts[0].sum(0), parts[1].T @ z, parts[2].T @ _squares(z)])

        return passes.totals(blocks, (len(cuts), 1 + (k + 1) + (k + 1) ** 2), np.float64, one) / n[:, None]

    beta = np.zeros((len(cuts), k + 1))
    beta[:, 0] = np.log(whole["y"][last, 0] / n)
    trial, low, going = beta.copy(), np.full(len(cuts), np.inf), np.ones(len(cuts), bool)
    for _ in range(PASSES):
        t = totals(trial)
        loss = t[:, 0] + (penalty * trial**2).sum(1) / 2
        for c in np.flatnonzero(going):
            if not loss[c] <= low[c] + 1e-13 * abs(low[c]):
                trial[c] = (beta[c] + trial[c]) / 2
                going[c] = np.abs(trial[c] - beta[c]).max() > 1e-14
                continue
            low[c], beta[c] = loss[c], trial[c]
            slope = t[c, 1 : k + 2] + penalty[c] * beta[c]
            curve = t[c, k + 2 :].reshape(k + 1, k + 1) + np.diag(penalty[c] + 1e-12)
            going[c] = np.abs(slope).max() > ARRIVED
            trial[c] = beta[c] - np.linalg.solve(curve, slope)
        if not going.any():
            break
    out = [(c, int(n[i]), float(b[0] - (b[1:] / scale) @ middle), [float(w) for w in b[1:] / scale]) for i, (c, b) in enumerate(zip(cuts, beta, strict=True))]
    return spark.createDataFrame(out, schema)


def linear(names: Sequence[str]) -> Column:
    """intercept and weights applied to the columns."""
    total = F.col("intercept")
    for i, n in enumerate(names):
        total = total + F.col("weights")[i] * F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    return total


def forecasts(df: DataFrame, models: DataFrame, names: Sequence[str], cut: str) -> DataFrame:
    """Rows of the models' cuts with pred, by the model of their own cut."""
    joined = df.join(F.broadcast(models.select(cut, "intercept", "weights")), cut)  # a row a month
    return joined.withColumn("pred", F.exp(F.greatest(F.least(linear(names), F.lit(FAR)), F.lit(-FAR)))).drop("intercept", "weights")


def pinball(residual, q):
    return np.maximum(q * residual, (q - 1) * residual)


def quantile_grid(df: DataFrame, names: Sequence[str], y: str, group: str, qs: Sequence[float], alpha: float = ALPHA, passes_at_most: int = 120) -> DataFrame:
    """group, q, n, loss, intercept and weights: linear quantile regressions of every group and quantile.

    Minimises the mean pinball loss plus alpha times the sum of absolute weights of standardised
    features. Each pass solves reweighted normal equations that bound both from above; the
    smoothing shrinks by passes, and the best weights that were seen stay. groups x quantiles x
    features squared numbers come back, so groups are regions and the like. Null features count
    as 0; rows without a target or group are left out.
    """
    spark, k, Q = df.sparkSession, len(names), len(qs)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]
    rows = df.where(F.col(y).isNotNull() & F.col(group).isNotNull())
    t = F.col(y).cast("double")
    sums = rows.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("y"), F.sum(t * t).alias("yy"), F.array(*map(F.sum, x)).alias("s"), F.array(*[F.sum(c * c) for c in x]).alias("ss")).orderBy("g").collect()
    schema = f"{group} {df.schema[group].dataType.simpleString()}, q double, n long, loss double, intercept double, weights array<double>"
    if not sums:
        return spark.createDataFrame([], schema)
    G = len(sums)
    n = np.array([r.n for r in sums], float)
    mean = np.array([r.s for r in sums]) / n[:, None]
    scale = np.sqrt(np.maximum(np.array([r.ss for r in sums]) / n[:, None] - mean**2, 1e-12))
    scale[scale < 1e-6] = 1.0  # a constant feature
    ys = np.array([r.y for r in sums]) / n
    unit = np.sqrt(np.maximum(np.array([r.yy for r in sums]) / n - ys**2, 1e-12))
    place = F.array_position(F.array(*[F.lit(r.g) for r in sums]), F.col(group)) - 1
    blocks = passes.packed(rows.withColumn("_g", place), [*names, y, "_g"])
    level = np.array(qs, float)
    wide = 1 + 2 * (k + 1) + (k + 1) ** 2

    def totals(beta: np.ndarray, near: np.ndarray) -> np.ndarray:
        def one(data: bytes) -> np.ndarray:
            m = np.frombuffer(data).reshape(-1, k + 2)
            out = np.zeros((G, Q, wide))
            of = m[:, k + 1].astype(int)
            for g in np.unique(of):
                some = m[of == g]
                z = np.column_stack([np.ones(len(some)), (some[:, :k] - mean[g]) / scale[g]])
                target = some[:, k, None]
                left = target - z @ beta[g].T
                w = 1 / (2 * (near[g] + np.abs(left)))
                out[g] = np.column_stack([pinball(left, level).sum(0), (w * target).T @ z, np.repeat(z.sum(0)[None], Q, 0), w.T @ _squares(z)])
            return out

        return passes.totals(blocks, (G, Q, wide), np.float64, one)

    beta = np.zeros((G, Q, k + 1))
    beta[:, :, 0] = ys[:, None]
    best, low = beta.copy(), np.full((G, Q), np.inf)
    near, quiet = 0.1 * unit, 0
    for _ in range(passes_at_most):
        sums_ = totals(beta, near)
        loss = sums_[..., 0] / n[:, None] + alpha * np.abs(beta[..., 1:]).sum(2)
        better = loss < low
        quiet = 0 if (loss < low * (1 - 1e-5)).any() else quiet + 1
        best[better], low[better] = beta[better], loss[better]
        if quiet == 5 and (near <= 1e-5 * unit).all():
            break
        right = sums_[..., 1 : k + 2] + (level[:, None] - 0.5) * sums_[..., k + 2 : 2 * k + 3]
        curve = sums_[..., 2 * k + 3 :].reshape(G, Q, k + 1, k + 1)
        pull = np.zeros((G, Q, k + 1))
        pull[..., 1:] = n[:, None, None] * alpha / (np.abs(beta[..., 1:]) + near[:, None, None] / 10)
        ridge = np.einsum("gqi,ij->gqij", pull + 1e-9, np.eye(k + 1))
        beta = np.linalg.solve(curve + ridge, right[..., None])[..., 0]
        near = np.maximum(near * 0.8, 1e-6 * unit)
    out = []
    for i, r in enumerate(sums):
        for j, q in enumerate(qs):
            w = best[i, j, 1:] / scale[i]
            out.append((r.g, float(q), r.n, float(low[i, j]), float(best[i, j, 0] - w @ mean[i]), [float(v) for v in w]))
    return spark.createDataFrame(out, schema)


def quantile_forecasts(df: DataFrame, grid: DataFrame, names: Sequence[str], group: str) -> DataFrame:
    """A row for each row and quantile: q and pred, not below 0."""
    joined = df.join(F.broadcast(grid.select(group, "q", "intercept", "weights")), group)  # a row a group and quantile
    return joined.withColumn("pred", F.greatest(linear(names), F.lit(0.0))).drop("intercept", "weights")
