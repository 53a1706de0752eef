"""Walk-forward forecasts as one plan: every cut's training set is a window frame, not a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import clip, guarded, history, ordered, share

#: Fixed values of the champion: weight of the prior in the regional ratio, and the ratio's bounds.
RATIO_PRIOR, RATIO_LOW, RATIO_HIGH, RATIO_MONTHS = 100.0, 0.5, 2.0, 12


def climatology(panel: DataFrame, y: str = "y", keys=("geo", "mes")) -> DataFrame:
    """Mean of the same month in earlier years, 0 without any: one expanding window for all cuts."""
    return panel.withColumn("clim", F.coalesce(F.avg(F.greatest(y, F.lit(0.0))).over(history(*keys, order="ano")), F.lit(0.0)))


def regional_ratio(panel: DataFrame) -> DataFrame:
    """p and ratio: observed over expected of the RATIO_MONTHS months before, shrunk to 1 and clipped.

    Sums by month come first, so the running sums go over as many rows as there are months.
    """
    month = panel.groupBy("p").agg(F.sum("y").alias("observed"), F.sum(F.when(F.col("y").isNotNull(), F.col("clim"))).alias("expected"))
    past = Window.orderBy("p").rangeBetween(-RATIO_MONTHS, -1)
    o, e = (F.coalesce(F.sum(c).over(past), F.lit(0.0)) for c in ("observed", "expected"))
    return month.select("p", clip((o + RATIO_PRIOR) / (e + RATIO_PRIOR), RATIO_LOW, RATIO_HIGH).alias("ratio"))


def champion(panel: DataFrame, min_history: int) -> DataFrame:
    """Climatology times the regional ratio, for entities with min_history earlier months."""
    base = climatology(panel).withColumn("n_before", F.count("y").over(history("geo")))
    out = base.join(F.broadcast(regional_ratio(base)), "p")  # a row a month
    return out.where(F.col("n_before") >= min_history).withColumn("champion", F.col("clim") * F.col("ratio"))


def baselines(panel: DataFrame) -> DataFrame:
    """Naive lag 12, own, regional and recent climatology of every cut."""
    recent = ordered("geo", "mes", order="ano").rangeBetween(-3, -1)
    out = climatology(panel).withColumns(
        {
            "naive": F.coalesce(F.lag("y", 12).over(ordered("geo")), F.lit(0.0)),
            "recent": F.coalesce(F.avg("y").over(recent), F.lit(0.0)),
            "occurrence": F.coalesce(F.avg((F.col("y") > 0).cast("double")).over(history("geo", "mes", order="ano")), F.lit(0.0)),
        }
    )
    region = panel.groupBy("uf", "mes", "ano").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    past = history("uf", "mes", order="ano")
    region = region.select("uf", "mes", "ano", F.coalesce(share(F.sum("s").over(past), F.sum("n").over(past)), F.lit(0.0)).alias("regional"))
    return out.join(region, ["uf", "mes", "ano"])


def hurdle(df: DataFrame, prediction: str, threshold: float) -> Column:
    """0 where the month has been quiet too often."""
    return F.when(F.col("occurrence") >= threshold, F.col(prediction)).otherwise(F.lit(0.0))


def blended(df: DataFrame, a: str, b: str, weights) -> DataFrame:
    """weight * a + (1 - weight) * b for each weight."""
    grid = F.explode(F.array(*map(F.lit, weights))).alias("weight")
    return df.select("*", grid).withColumn("blend", F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b))


def with_sums(df: DataFrame, cut: str, **sums: Column) -> DataFrame:
    """df with sums over its cut, added up first to a row a cut."""
    rows = df.groupBy(F.col(cut).alias("_cut")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return df.join(F.broadcast(rows), F.col(cut) == F.col("_cut")).drop("_cut")  # a row a month


def allocated(df: DataFrame, base: str, score: str, weights, cut: str = "p") -> DataFrame:
    """Keeps each cut's total of base and moves the shares towards score by each weight.

    The shares don't depend on the weight, so the grid is laid out last.
    """
    out = with_sums(df, cut, total=F.col(base), _score=F.col(score), _rows=F.lit(1))
    part = lambda c, whole: F.when(F.col(whole) > 1e-12, F.col(c) / F.col(whole)).otherwise(1 / F.col("_rows"))
    out = out.withColumns({"base_share": part(base, "total"), "score_share": part(score, "_score")}).drop("_score", "_rows")
    grid = F.explode(F.array(*map(F.lit, weights))).alias("weight")
    return out.select("*", grid).withColumn("allocated", F.col("total") * ((1 - F.col("weight")) * F.col("base_share") + F.col("weight") * F.col("score_share")))


def tilted(df: DataFrame, base: str, z: str, beta: float, cut: str = "p") -> DataFrame:
    """Shares times exp(beta z), made to sum to 1 again; totals stay."""
    out = df.withColumn("tilt", F.col(base) * F.exp(beta * F.col(z)))
    out = with_sums(out, cut, _base=F.col(base), _tilt=F.col("tilt"))
    return out.withColumn("tilted", F.coalesce(F.col("_base") * share(F.col("tilt"), F.col("_tilt")), F.lit(0.0))).drop("_base", "_tilt")


def quantile_climatology(panel: DataFrame, q: float) -> DataFrame:
    """The q-quantile of the same month in earlier years.

    A group holds one entity's values of one calendar month, a row a year.
    """
    seen = F.array_sort(F.collect_list("y").over(history("geo", "mes", order="ano")))
    at = (F.size(seen) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    value = F.get(seen, low) + (at - low) * (F.coalesce(F.get(seen, low + 1), F.get(seen, low)) - F.get(seen, low))
    return panel.withColumn("upper_clim", F.when(F.size(seen) > 0, value).otherwise(F.lit(0.0)))


def trailing_ratio(panel: DataFrame, keys, months: int, prior: float) -> Column:
    """Observed over climatology of the months before, by keys, shrunk to 1."""
    past = Window.partitionBy(*keys).orderBy("p").rangeBetween(-months, -1)
    return (F.coalesce(F.sum("y").over(past), F.lit(0.0)) + prior) / (F.coalesce(F.sum("clim").over(past), F.lit(0.0)) + prior)


def full_rolling(panel: DataFrame, n: int) -> Column:
    return guarded(ordered("geo").rowsBetween(-n, -1), F.col("y"), n)
