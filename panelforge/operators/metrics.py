"""Error measures, gates, resampling and conformal bands over prediction tables (y, pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import share
from panelforge.operators.quantiles import ranked

EPSILON = 1e-6


def wape(y: Column, p: Column, where: Column | None = None) -> Column:
    e, a = F.abs(y - p), F.abs(y)
    if where is not None:
        e, a = F.when(where, e), F.when(where, a)
    return F.when(F.sum(a) > 0, F.sum(e) / F.sum(a))


def errors(y: Column, p: Column) -> dict[str, Column]:
    return {
        "n": F.count(F.lit(1)),
        "wape": wape(y, p),
        "mae": F.avg(F.abs(y - p)),
        "rmse": F.sqrt(F.avg(F.pow(y - p, 2))),
        "mape": F.avg(F.when(y > 0, F.abs(y - p) / y)),
        "r2": F.when(F.var_pop(y) > 0, 1 - F.avg(F.pow(y - p, 2)) / F.var_pop(y)).otherwise(0.0),
        "bias": F.sum(p) - F.sum(y),
    }


def undue_zeros(pred: Column, past: Column) -> Column:
    """Share of forecasts of nothing where there has been something."""
    return F.coalesce(F.avg(F.when(past > 0, (pred <= 0).cast("double"))), F.lit(0.0))


def recall_at_k(df: DataFrame, k: int, cut: str = "p") -> DataFrame:
    """For each cut, the share of the k largest that are among the k forecast largest; ties by entity.

    Each top is cut off by itself, so that tasks keep k rows of a cut before any are shuffled.
    """

    def top(c: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(cut).orderBy(F.desc(c), "geo"))
        return df.select(cut, "geo", c).withColumn("r", rank).where(F.col("r") <= k).select(cut, "geo")

    both = top("y").join(top("pred").withColumn("hit", F.lit(1)), [cut, "geo"], "left")
    return both.groupBy(cut).agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def stability_index(expected: DataFrame, actual: DataFrame, value: str, bins: int) -> DataFrame:
    """Population stability index over equal bins of the expected range; what lies outside is left out."""
    ends = expected.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))

    def part(df: DataFrame, name: str) -> DataFrame:
        placed = df.crossJoin(ends).where(F.col(value).between(F.col("lo"), F.col("hi")))  # one row
        b = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        return placed.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias(name))

    both = part(expected, "e").join(part(actual, "a"), "bin", "full").na.fill(0, ["e", "a"])
    both = both.crossJoin(both.agg(F.sum("e").alias("ne"), F.sum("a").alias("na")))
    e, a = F.col("e") / F.col("ne"), F.col("a") / F.col("na")
    return both.agg(F.sum((a - e) * F.log((a + EPSILON) / (e + EPSILON))).alias("psi"))


def gate(row: DataFrame, limits: dict[str, float]) -> DataFrame:
    """passed and reasons; a missing measure fails."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")).when(F.col(c) > limit, F.lit(f"{c} above limit")) for c, limit in limits.items()]
    reasons = F.array_join(F.filter(F.array(*checks), lambda x: x.isNotNull()), "; ")
    return row.withColumn("reasons", reasons).withColumn("passed", reasons == "")


def wins(df: DataFrame, a: str, b: str, cut: str = "p") -> DataFrame:
    """Cuts in which a has less absolute error than b."""
    by = df.groupBy(cut).agg(F.sum(F.abs(F.col("y") - F.col(a))).alias("ea"), F.sum(F.abs(F.col("y") - F.col(b))).alias("eb"))
    return by.agg(F.count(F.lit(1)).alias("cuts"), F.sum((F.col("ea") < F.col("eb")).cast("long")).alias("wins"))


def block_bootstrap(df: DataFrame, a: str, b: str, draws: int = 2000, seed: int = 42, cut: str = "p") -> DataFrame:
    """Draws of cuts with replacement by a hash of seed, draw and slot: each draw's difference of weighted errors, a minus b.

    Only each cut's sums are drawn.
    """
    sums = df.groupBy(cut).agg(*[F.sum(F.abs(F.col("y") - F.col(c))).alias(f"e{i}") for i, c in enumerate((a, b))], F.sum("y").alias("s"))
    numbered = sums.withColumn("i", F.row_number().over(Window.orderBy(cut)) - 1)  # a row a cut
    n = F.broadcast(sums.agg(F.count(F.lit(1)).alias("n")))  # one row
    slots = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(n).where("n > 0").select("n", "draw", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("bigint")
    picked = slots.select("draw", (drawn % F.col("n")).cast("int").alias("i"))
    return picked.join(F.broadcast(numbered), "i").groupBy("draw").agg((share(F.sum("e0"), F.sum("s")) - share(F.sum("e1"), F.sum("s"))).alias("delta"))


def bootstrap_interval(deltas: DataFrame) -> DataFrame:
    """Number of draws, CI95 of their differences, and the share in which a is better."""
    better = F.avg((F.col("delta") < 0).cast("double"))
    return deltas.agg(F.count(F.lit(1)).alias("draws"), F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"), better.alias("better"))


def conformal_width(residuals: DataFrame, alpha: float, keys: Sequence[str]) -> DataFrame:
    """The residual at rank ceil((n + 1)(1 - alpha)), at most n, of each group, found by counting bins."""
    sizes = residuals.where("residual IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rank = F.least(F.greatest(F.ceil((F.col("n") + 1) * (1 - alpha)), F.lit(1)), F.col("n")) - 1
    return ranked(residuals, "residual", keys, sizes.select(*keys, rank.alias("rank"))).select(*keys, F.col("value").alias("width"))


def _support(mean: float, alpha: float):
    """Counts and their probabilities, without those below what a double can add to 1."""
    import numpy as np

    reach = 50 * (np.sqrt(mean + alpha * mean * mean) + alpha * mean + 1)
    k = np.arange(max(int(mean - reach), 0), int(mean + reach) + 1)
    if alpha > 1e-9:  # each probability from the one before
        steps = np.log((k[1:] - 1 + 1 / alpha) / k[1:] * (alpha * mean / (1 + alpha * mean)))
    else:
        steps = np.log(mean / k[1:])
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    logs -= logs.max()
    kept = logs > -50
    weights = np.exp(logs[kept])
    return k[kept], weights / weights.sum()


def _drawn(rng, mean: float, alpha: float, n: int, draws: int):
    """Pairs that add up to each draw's absolute errors and events, of n cells of one mean."""
    import numpy as np

    noisy = alpha > 1e-9 and mean > 0
    if n > 16 and mean > 0:
        k, chance = _support(mean, alpha if noisy else 0.0)
        if 2 * n > len(k):
            far, step = np.abs(k - mean), max(1, (1 << 22) // len(k))
            parts = [rng.multinomial(n, chance, min(step, draws - at)) for at in range(0, draws, step)]
            yield tuple(np.concatenate([c @ v for c in parts]) for v in (far, k.astype(float)))
            return
    if mean == 0:
        return
    for _ in range(n):
        drawn = rng.negative_binomial(1 / alpha, 1 / (1 + alpha * mean), draws) if noisy else rng.poisson(mean, draws)
        yield np.abs(drawn - mean), drawn


def noise_floor(means: DataFrame, dispersion: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """The error that noise alone gives if every cell's mean (p, a number of its own, and mean) were known, by kind of noise.

    Poisson noise, and negative binomial noise of variance mean + dispersion * mean^2, where a
    dispersion of null or 0 gives Poisson noise. dispersion: one row. Cells of one mean are drawn
    together: where they are many, how often each count comes is drawn at once (multinomial), so
    the work grows with distinct means, and only with cells where means differ. Draws are spread
    over the executors, with a seed for each mean's least p and kind; a task sums its cells draw by
    draw. Null means count as 0. Draws without any event have no error; no cells give no rows.
    """
    kinds = ("poisson", "negative_binomial")

    def run(batches):
        import numpy as np
        import pandas as pd

        e, y, any_ = np.zeros((2, draws)), np.zeros((2, draws)), False
        for b in batches:
            for p, mean, n, alpha in zip(b["p"], b["mean"], b["n"], b["dispersion"], strict=True):
                any_ = True
                for i in range(2):
                    rng = np.random.default_rng([seed, int(p) % (1 << 64), i])
                    for error, drawn in _drawn(rng, mean, alpha if i else 0.0, n, draws):
                        e[i] += error
                        y[i] += drawn
        if any_:
            for i, kind in enumerate(kinds):
                yield pd.DataFrame({"kind": kind, "draw": np.arange(draws), "e": e[i], "y": y[i]})

    mean = F.coalesce(F.greatest(F.nanvl(F.col("mean").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    alike = means.groupBy(mean.alias("mean")).agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"))
    alike = alike.repartition(int(means.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p")  # few rows with much work each
    given = alike.crossJoin(F.broadcast(dispersion.select(F.coalesce(F.col("dispersion").cast("double"), F.lit(0.0)).alias("dispersion"))))
    drawn = given.mapInPandas(run, "kind string, draw long, e double, y double").groupBy("kind", "draw").agg(share(F.sum("e"), F.sum("y")).alias("wape"))
    cuts = [F.percentile("wape", q).alias(n) for n, q in (("p2_5", 0.025), ("p90", 0.9), ("p97_5", 0.975))]
    return drawn.groupBy("kind").agg(F.avg("wape").alias("mean"), *cuts, F.count(F.lit(1)).alias("draws"))
