"""As-of features: nothing about the current month goes into its own features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import clip, guarded, history, ordered, trailing
from panelforge.operators.ordering import average_ranks, running


def lags(panel: DataFrame, steps=(1, 2, 3, 6, 12), value: str = "y") -> DataFrame:
    """Earlier values by row; the panel must be dense."""
    w = ordered("geo")
    out = panel.withColumns({f"lag{k}": F.lag(value, k).over(w) for k in steps})
    return out.withColumn("drop3", F.col("lag3") - F.col("lag1")) if {1, 3} <= set(steps) else out


def rolling(panel: DataFrame, value: str = "y") -> DataFrame:
    """Means and sums of the months before: full windows, and windows with what there is."""
    y = F.col(value)
    w = lambda n: trailing(n, "geo")
    out = {f"roll{n}_full": guarded(w(n), y, n) for n in (3, 6)} | {f"roll{n}": guarded(w(n), y, 1) for n in (3, 6, 12)}
    out |= {f"sum{n}": guarded(w(n), y, n, F.sum) for n in (3, 6)}
    current = ordered("geo").rowsBetween(-2, 0)
    return panel.withColumns(out | {"roll3_now": F.avg(y).over(current), "roll12_zero": F.avg(F.coalesce(y, F.lit(0.0))).over(w(12))})


def cumulative(panel: DataFrame, value: str = "y") -> DataFrame:
    """Sum since January, sum since ever, same month last year, and the month's mean so far."""
    y = F.col(value)
    return panel.withColumns(
        {
            "ytd": F.coalesce(F.sum(y).over(history("geo", "ano", order="mes")), F.lit(0.0)),
            "prior": F.coalesce(F.sum(F.coalesce(y, F.lit(0.0))).over(history("geo")), F.lit(0.0)),
            "same_month_before": F.lag(y).over(ordered("geo", "mes", order="ano")),
            "month_mean": guarded(history("geo", "mes", order="ano"), y, 2),
            "ever": F.max((y > 0).cast("int")).over(Window.partitionBy("geo")),
        }
    )


def calendar(panel: DataFrame) -> DataFrame:
    """Cyclic month, season flags, trend and labels."""
    angle = 2 * 3.141592653589793 * F.col("mes") / 12
    panel = panel.crossJoin(panel.agg(F.min("ano").alias("first_year")))  # one row
    return panel.withColumns(
        {
            "mes_sin": F.sin(angle),
            "mes_cos": F.cos(angle),
            "is_dry": F.col("mes").between(8, 12),
            "is_critical": F.col("mes").isin(10, 11),
            "trend": F.col("ano") - F.col("first_year"),
            "occurrence": (F.col("y") > 0).cast("int"),
            "label": F.format_string("%d-%02d", "ano", "mes"),
        }
    )


def anomalies(panel: DataFrame, value: str = "y") -> DataFrame:
    """Distance from the month's mean, group-mean filling, differences, and filled attributes.

    A NULL month of the year has a mean of its own.
    """
    v = F.col(value)
    means = panel.groupBy(F.col("mes").alias("_mes")).agg(F.avg(v).alias("_mean"))
    panel = panel.join(F.broadcast(means), F.col("mes").eqNullSafe(F.col("_mes")), "left")  # a row a month of the year
    to_now = ordered("geo").rowsBetween(Window.unboundedPreceding, 0)
    from_now = ordered("geo").rowsBetween(0, Window.unboundedFollowing)
    return panel.withColumns(
        {
            "anomaly": v - F.col("_mean"),
            "filled": F.coalesce(v, F.col("_mean")),
            "diff1": v - F.lag(v, 1).over(ordered("geo")),
            "carried": F.coalesce(F.last(v, True).over(to_now), F.first(v, True).over(from_now)),
        }
    ).drop("_mes", "_mean")


def within_cut(panel: DataFrame, value: str = "y") -> DataFrame:
    """Place, distance and share of a value among all entities of its month.

    Months come as sums of a row each, and places by counted values, so no month is in one task.
    """
    v = F.col(value)
    cut = panel.groupBy(F.col("p").alias("_p")).agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"), F.sum(v).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    places = average_ranks(panel, ["p"], value).select(F.col("p").alias("_q"), F.col(value).alias("_v"), (F.col("rank") / F.col("n")).alias("_place"))
    joined = panel.join(F.broadcast(cut), F.col("p") == F.col("_p")).join(places, (F.col("p") == F.col("_q")) & (v == F.col("_v")), "left")  # a row a month
    z = F.try_divide(v - F.col("_mean"), F.col("_sd"))
    return joined.withColumns(
        {
            "rank_share": F.coalesce("_place", F.lit(0.5)),
            "z": F.coalesce(clip(z, -4.0, 4.0), F.lit(0.0)),
            "neutral": F.coalesce(v, F.col("_mean"), F.lit(0.0)),
            "share": F.when(F.col("_sum") > 1e-12, v / F.col("_sum")).otherwise(1 / F.col("_rows")),
        }
    ).drop("_p", "_mean", "_sd", "_sum", "_rows", "_q", "_v", "_place")


def quantile_buckets(df: DataFrame, value: str, k: int, key: str = "geo") -> DataFrame:
    """k buckets by rank, first of equals first, at linear quantile edges, right-closed."""
    placed = running(df.withColumn("_one", F.lit(1)), [value, key], "_one", "_before")
    r, n = F.col("_before") + 1, F.col("_n")
    bucket = sum(((r > 1 + (n - 1) * j / k).cast("int") for j in range(1, k)), F.lit(0))
    sized = placed.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    return sized.withColumn("bucket", bucket).drop("_one", "_before", "_n")


def asof_year(panel: DataFrame, yearly: DataFrame, value: str) -> DataFrame:
    """The latest yearly row of an earlier year, by a union and one window: no range join."""
    rows = panel.select("geo", "ano", "mes", F.lit(None).cast("double").alias("v"), F.lit(1).alias("side"))
    facts = yearly.select("geo", (F.col("ano") + 1).alias("ano"), F.lit(0).alias("mes"), F.col(value).cast("double").alias("v"), F.lit(0).alias("side"))
    w = Window.partitionBy("geo").orderBy("ano", "mes", "side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(facts).withColumn("asof", F.last("v", True).over(w)).where("side = 1").select("geo", "ano", "mes", "asof")
