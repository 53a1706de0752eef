"""Exact quantiles of groups of any size: counts of bins first, then the values of the bins that matter.

A group's values never meet in one task. Each pass counts the values of the stretches that hold
a wanted rank in bins of equal width, with map-side sums, and keeps of each stretch only the
bins with such a rank, narrowed to the least and largest value in them. Once no stretch holds
more than LIMIT distinct values, those that are left are counted one by one. A stretch of one value needs
no further pass, however often the value stands there.

The values are stored before the first pass, each once with how often it stands there. Made again
in each pass, a value that rests on a sum of doubles could differ in its last digit, fall out of
its stretch and take its group with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.tables import stored

BINS, LIMIT = 1024, 100_000


def _before(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _values(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """keys, v and m, the distinct values that are not null and how often each stands there, stored."""
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    return stored(rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("m")), "ranked")


def ranked(df: DataFrame, value: str, keys: Sequence[str], places: DataFrame, bins: int = BINS, limit: int = LIMIT) -> DataFrame:
    """keys, rank and value: the rank-th smallest value (from 0) of each group, for the rows (keys, rank) of places.

    Nulls are left out, ranks beyond the group's size give no row. Group keys are not null.
    """
    return _ranked(_values(df, value, keys), keys, places, bins, limit)


def _ranked(rows: DataFrame, keys: Sequence[str], places: DataFrame, bins: int, limit: int) -> DataFrame:
    """ranked() of the stored _values()."""
    k = list(keys)
    ends = rows.groupBy(*k).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("size"))
    wanted = stored(places.select(*k, F.col("rank").cast("long").alias("rank")).distinct().join(ends, k).where("rank < n").drop("n").withColumn("at", F.col("rank")), "ranks")
    here = rows.join(ends.drop("n", "size"), k).where("lo < hi")
    stretch = [*k, "lo", "hi"]
    first = True
    while True:
        open_ = wanted.where("lo < hi")
        most = open_.agg(F.max("size")).first()[0]
        if most is None:
            return wanted.select(*k, "rank", F.col("lo").alias("value"))
        if not first:  # rows go on from their stretch's bin to the stretch that it became
            kept = open_.select(*k, "lo0", "hi0", "bin", "lo", "hi").distinct()
            here = here.withColumn("bin", place).withColumnsRenamed({"lo": "lo0", "hi": "hi0"}).join(kept, [*k, "lo0", "hi0", "bin"]).select(*stretch, "v", "m")
        if most <= limit:
            break
        first, place = False, F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = here.groupBy(*stretch, place.alias("bin")).agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("size"), F.min("v").alias("a"), F.max("v").alias("b"))
        counts = counts.withColumn("before", F.coalesce(F.sum("m").over(_before(stretch, "bin")), F.lit(0)))
        found = open_.drop("size", "lo0", "hi0", "bin").join(counts, stretch).where("at >= before AND at < before + m")
        found = found.select(*k, "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), "size", (F.col("at") - F.col("before")).alias("at"), F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), "bin")
        wanted = stored(wanted.where("lo >= hi").unionByName(found, allowMissingColumns=True), "ranks")
    each = here.withColumn("before", F.coalesce(F.sum("m").over(_before(stretch, "v")), F.lit(0)))
    exact = wanted.where("lo < hi").join(each, stretch).where("at >= before AND at < before + m").select(*k, "rank", F.col("v").alias("value"))
    return exact.unionByName(wanted.where("lo >= hi").select(*k, "rank", F.col("lo").alias("value")))


def quantiles(df: DataFrame, value: str, keys: Sequence[str], qs: Sequence[float], bins: int = BINS, limit: int = LIMIT) -> DataFrame:
    """keys, q, value and n: exact quantiles with linear interpolation, as percentile() has them, of the values that are not null."""
    k = list(keys) or ["all"]
    rows = _values(df if keys else df.withColumn("all", F.lit(0)), value, k)
    sizes = rows.groupBy(*k).agg(F.sum("m").alias("n"))
    at = (F.col("n") - 1) * F.col("q")
    asked = stored(sizes.select(*k, "n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn("low", F.floor(at)).withColumn("part", at - F.col("low")), "quantiles")
    both = asked.select(*k, F.explode(F.array("low", F.least(F.col("low") + 1, F.col("n") - 1))).alias("rank"))
    found = stored(_ranked(rows, k, both, bins, limit), "values")
    low, high = (found.select(*k, F.col("rank").alias(r), F.col("value").alias(v)) for r, v in (("low", "a"), ("high", "b")))
    out = asked.withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1)).join(low, [*k, "low"]).join(high, [*k, "high"])
    return out.select(*keys, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"), "n")


def wide(df: DataFrame, value: str, keys: Sequence[str], names: dict[str, float]) -> DataFrame:
    """keys, n and a column for each named quantile."""
    long = quantiles(df, value, keys, list(names.values()))
    columns = [F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(n) for n, q in names.items()]
    return long.groupBy(*keys).agg(F.max("n").alias("n"), *columns)
