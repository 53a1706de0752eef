"""Distributed fits against small in-memory versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting, learners, passes, quantiles, regression

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("limit", [100_000, 20, 1])
def test_quantiles_equal_the_whole_group_s(spark, limit):
    v = np.concatenate([RNG.normal(0, 1, 300), np.full(200, 7.0), 10.0 ** RNG.uniform(-8, 8, 300), -np.arange(50.0)])
    data = [("a", float(x)) for x in v] + [("b", 5.0)] + [("c", None), ("c", 1.0), ("c", 2.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    qs = (0.0, 0.1, 0.5, 0.77, 0.9, 0.999, 1.0)
    got = {(r.g, r.q): r.value for r in quantiles.quantiles(df, "v", ["g"], qs, bins=8, limit=limit).collect()}
    for g, x in (("a", v), ("b", [5.0]), ("c", [1.0, 2.0])):
        for q in qs:
            assert got[g, q] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-12)
    one = quantiles.wide(df, "v", [], {"mid": 0.5, "top": 0.9}).first()
    assert one.mid == pytest.approx(np.median([x for _, x in data if x is not None])) and one.n == len(data) - 1


@pytest.mark.parametrize("limit", [10, 100_000])
def test_quantiles_of_values_whose_last_digit_moves(spark, limit):
    shaken = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()  # as sums of doubles are in another order
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).cast("double").alias("w")).select("g", shaken("w").alias("v"))
    got = {(r.g, r.q): r.value for r in quantiles.quantiles(df, "v", ["g"], (0.1, 1.0), bins=8, limit=limit).collect()}
    assert got == {(g, q): pytest.approx(999 * q, abs=1e-6) for g in (0, 1) for q in (0.1, 1.0)}


def grown(x, y, rounds, rate, edges, depth, max_leaves, least):
    """Boosting by plain loops over features and bins, all rows in memory; returns the training rows' predictions."""
    bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1)
    raw = np.full(len(y), np.log(y.mean()))
    scale = boosting.scale_of(len(y), y.sum(), y.max())
    for _ in range(rounds):
        g, h = np.rint((np.exp(raw) - y) * scale), np.rint(np.exp(raw) * scale)
        leaves, level = [np.arange(len(y))], {0: np.arange(len(y))}
        done = []
        for _ in range(depth):
            options = []
            for node, rows in sorted(level.items()):
                best = None
                for f, e in enumerate(edges):
                    for b in range(len(e)):
                        left = bins[rows, f] <= b
                        l, r = rows[left], rows[~left]
                        if min(len(l), len(r)) >= least and min(h[l].sum(), h[r].sum()) >= 1e-3 * scale:
                            parts = [(g[s].sum() / scale) ** 2 / (h[s].sum() / scale) for s in (l, r, rows)]
                            gain = parts[0] + parts[1] - parts[2]
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, node, l, r)
                if best:
                    options.append(best)
            options.sort(key=lambda o: -o[0])
            taken = options[: max_leaves - (len(level) + len(done))]
            split = {o[1] for o in taken}
            done += [rows for node, rows in level.items() if node not in split]
            level = {2 * n + 1 + side: s for _, n, *sides in taken for side, s in enumerate(sides)}
            if not level:
                break
        for rows in [*done, *level.values()]:
            raw[rows] += -rate * (g[rows].sum() / scale) / (h[rows].sum() / scale)
    return np.exp(raw)


def test_boosting_equals_a_small_one_in_memory(spark):
    n = 700
    x = np.column_stack([RNG.integers(0, 9, n), RNG.normal(0, 1, n).round(2), RNG.exponential(3, n)]).astype(float)
    y = RNG.poisson(np.exp(0.3 * x[:, 0] - x[:, 1] * (x[:, 0] > 4))).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, c double, y double").repartition(5)
    model = boosting.fit(df, ["a", "b", "c"], "y", rounds=13, bins=20, depth=4, max_leaves=9, least=20)
    got = np.array([r.pred for r in boosting.predicted(df, model).orderBy("i").collect()])
    edges = [np.array(sorted({q for q in np.quantile(c, np.arange(1, 20) / 20) if q < c.max()})) for c in x.T]
    assert all(np.allclose(a, b) for a, b in zip(model.edges, edges, strict=True))
    assert got == pytest.approx(grown(x, y, 13, 0.1, edges, 4, 9, 20), rel=1e-9)
    assert np.abs(got - y).mean() < 0.7 * np.abs(y.mean() - y).mean()
    again = boosting.fit(df.repartition(2).withColumn("a", F.col("a")), ["a", "b", "c"], "y", rounds=13, bins=20, depth=4, max_leaves=9, least=20)
    assert all((s.value == t.value).all() and (s.feature == t.feature).all() for s, t in zip(model.trees, again.trees, strict=True))
    with pytest.raises(ValueError):
        boosting.fit(df.withColumn("y", F.lit(0.0)), ["a"], "y")


def newton(z, y, power, alpha):
    """One ridge fit by plain Newton steps on standardised features."""
    mean, sd = z.mean(0), z.std(0)
    x = np.column_stack([np.ones(len(z)), (z - mean) / sd])
    b = np.zeros(x.shape[1])
    b[0] = np.log(y.mean())
    pen = np.r_[0.0, np.full(z.shape[1], alpha)]

    def loss(b):
        return regression.link_terms(x @ b, y, power)[0].mean() + (pen * b * b).sum() / 2

    for _ in range(200):
        _, g, h = regression.link_terms(x @ b, y, power)
        step = np.linalg.solve((x * h[:, None]).T @ x / len(y) + np.diag(pen), x.T @ g / len(y) + pen * b)
        t = 1.0
        while loss(b - t * step) > loss(b) and t > 1e-9:
            t /= 2
        b = b - t * step
    return b[0] - (b[1:] / sd) @ mean, b[1:] / sd


@pytest.mark.parametrize("power", [1.0, 1.5])
def test_each_cut_of_a_walk_forward_equals_a_fit_of_its_own(spark, power):
    n = 600
    p = RNG.integers(1, 13, n)
    z = np.column_stack([RNG.normal(5, 2, n), RNG.exponential(1, n), p % 3 == 0]).astype(float)
    y = RNG.poisson(np.exp(0.2 * z[:, 0] - 0.5 * z[:, 1] + 0.1 * p)).astype(float)
    df = spark.createDataFrame([(int(m), *map(float, r), float(t)) for m, r, t in zip(p, z, y, strict=True)], "p int, a double, b double, c double, y double").repartition(6)
    got = regression.walk_forward(df, ["a", "b", "c"], "y", "p", 5, power)
    models = {r.p: r for r in got.collect()}
    assert sorted(models) == list(range(5, 13))
    for c, m in models.items():
        intercept, weights = newton(z[p < c], y[p < c], power, 0.1)
        assert m.n == (p < c).sum()
        assert [m.intercept, *m.weights] == pytest.approx([intercept, *weights], rel=1e-6, abs=1e-8)
    out = regression.forecasts(df, got, ["a", "b", "c"], "p").where("p = 9").select("a", "b", "c", "pred").collect()
    for r in out:
        assert r.pred == pytest.approx(np.exp(models[9].intercept + np.dot(models[9].weights, [r.a, r.b, r.c])))
    assert regression.walk_forward(df.withColumn("y", F.lit(0.0)), ["a"], "y", "p", 5, power).count() == 0


def exact_quantile_loss(z, y, q, alpha):
    """The least objective: it is reached where as many residuals or weights are 0 as there are parameters."""
    x = np.column_stack([np.ones(len(z)), (z - z.mean(0)) / z.std(0)])
    k = x.shape[1]
    planes = [(*r, t) for r, t in zip(x, y, strict=True)] + [(*np.eye(k)[j], 0.0) for j in range(1, k)]
    best = np.inf
    for some in itertools.combinations(planes, k):
        a = np.array(some)
        if abs(np.linalg.det(a[:, :k])) > 1e-9:
            b = np.linalg.solve(a[:, :k], a[:, k])
            best = min(best, regression.pinball(y - x @ b, q).mean() + alpha * np.abs(b[1:]).sum())
    return best


def test_quantile_grid_is_within_a_hundredth_of_the_exact_solution(spark):
    data, parts = [], {}
    for g in ("north", "south"):
        z = np.column_stack([RNG.normal(0, 1, 36), RNG.exponential(2, 36)])
        y = 10 + 4 * z[:, 0] * (g == "north") + z[:, 1] * RNG.normal(0, 2, 36)
        parts[g] = (z, y)
        data += [(g, *map(float, r), float(t)) for r, t in zip(z, y, strict=True)]
    df = spark.createDataFrame(data, "g string, a double, b double, y double").repartition(4)
    grid = regression.quantile_grid(df, ["a", "b"], "y", "g", (0.1, 0.5, 0.9))
    for r in grid.collect():
        z, y = parts[r.g]
        mine = regression.pinball(y - r.intercept - z @ np.array(r.weights), r.q).mean() + 0.1 * np.abs(np.array(r.weights) * z.std(0)).sum()
        assert mine == pytest.approx(r.loss, rel=1e-6)
        assert mine <= 1.01 * exact_quantile_loss(z, y, r.q, 0.1)
    assert {r.q for r in regression.quantile_forecasts(df, grid, ["a", "b"], "g").collect()} == {0.1, 0.5, 0.9}


def test_equal_rows_are_one_row_with_their_number(spark):
    bins, y, raw = RNG.integers(0, 4, (50, 2)).astype(np.uint8), RNG.integers(0, 9, 50).astype(float), RNG.normal(0, 1, 50)
    tree = boosting.Tree(np.array([0, -1, -1]), np.array([1, 0, 0]), np.zeros(3), 1)
    times = RNG.integers(1, 400, 50)
    whole = [np.repeat(x, times, 0) for x in (bins, y, raw)]
    for scale in (2.0**20, 2.0**40):  # sums of the second pass what doubles hold exactly
        each = sum(boosting.histograms(tree, [1, 2], whole[0][i : i + 1], whole[1][i : i + 1], whole[2][i : i + 1], scale, 4) for i in range(len(whole[1])))
        assert (boosting.histograms(tree, [1, 2], bins, y, raw, scale, 4, times.astype(float)) == each).all()
    df = spark.range(10_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("y"))
    assert {(r.a, r.y, r[passes.TIMES]) for r in passes.alike(df, ["a", "y"]).collect()} >= {(0.0, 0.0, 477)} and passes.alike(df, ["a", "y"]).count() == 21


def test_rows_of_a_fit_are_made_once_and_dealt_over_all_cores(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("y")).coalesce(1).mapInArrow(count, "a double, y double")
    train = learners.dealt(rows)
    assert train.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert train.count() == 400 and train.agg(F.sum("a")).first()[0] == sum(i % 7 for i in range(400))
    assert made.value == 400
