"""Entity-month panels: aggregation of events, dense months, coverage, gaps and source preference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly(events: DataFrame, keys: Sequence[str] = ("geo",)) -> DataFrame:
    """Events by keys and month: number, sums, means, extremes, p90 and sensors.

    Days (31 at most) and sensors are counted as sets, which unlike distinct counts are gathered
    before the shuffle without a copy of each row for each count.
    """
    names = F.array_sort(F.collect_set("sensor"))
    return events.groupBy(*keys, "ano", "mes", "p").agg(
        F.count(F.lit(1)).cast("double").alias("y"),
        F.coalesce(F.sum("frp"), F.lit(0.0)).alias("frp_sum"),
        F.avg("frp").alias("frp_mean"),
        F.max("frp").alias("frp_max"),
        F.percentile("frp", 0.9).alias("frp_p90"),
        F.coalesce(F.stddev_samp("frp"), F.lit(0.0)).alias("frp_std"),
        F.avg("risk").alias("risk_mean"),
        F.size(names).cast("bigint").alias("n_sensors"),
        F.size(F.collect_set(F.to_date("time"))).cast("bigint").alias("n_days"),
        F.array_join(names, ";").alias("sensors"),
    )


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("geo", "ano", "mes", "p").agg(F.count(F.lit(1)).cast("double").alias("y"))


def months(lo: str, hi: str) -> Column:
    return F.explode(F.sequence(F.col(lo), F.col(hi))).alias("p")


def with_calendar(df: DataFrame) -> DataFrame:
    """ano and mes from the ordinal p."""
    return df.withColumn("ano", ((F.col("p") - 1) / 12).cast("int")).withColumn("mes", ((F.col("p") - 1) % 12 + 1).cast("int"))


def coverage(observed: DataFrame) -> DataFrame:
    """First and last observed month of each entity."""
    return observed.groupBy("geo").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.sum("y").alias("total"))


def zero_filled(observed: DataFrame, windows: DataFrame) -> DataFrame:
    """Every month of each window (geo, lo, hi); months without a row are 0 and marked. Inverted windows give none."""
    spine = windows.where("lo <= hi").select("geo", months("lo", "hi"))
    seen = observed.select("geo", "p", "y")
    out = spine.join(seen, ["geo", "p"], "left").withColumn("assumed_zero", F.col("y").isNull())
    return with_calendar(out.withColumn("y", F.coalesce("y", F.lit(0.0))))


def reindexed(observed: DataFrame, windows: DataFrame) -> DataFrame:
    """As zero_filled, but months without a row stay NULL."""
    spine = windows.where("lo <= hi").select("geo", months("lo", "hi"))
    return with_calendar(spine.join(observed.select("geo", "p", "y"), ["geo", "p"], "left"))


def common_window(observed: DataFrame) -> DataFrame:
    """One window for all entities: the first to the last month of the table."""
    ends = observed.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return observed.select("geo").distinct().crossJoin(ends)  # one row


def gaps_quarantined(panel: DataFrame, first: int = 8, last: int = 12) -> DataFrame:
    """Season months are suspect, and NULL, in years without any event whose neighbour years have some."""
    season = panel.where(F.col("mes").between(first, last)).groupBy("geo", "ano").agg(F.sum("y").alias("s"))
    by = Window.partitionBy("geo").orderBy("ano").rangeBetween
    around = season.withColumn("before", F.max("s").over(by(-1, -1))).withColumn("after", F.max("s").over(by(1, 1)))
    bad = around.where("s = 0 AND before > 0 AND after > 0").select("geo", "ano", F.lit(True).alias("bad"))
    out = panel.join(bad, ["geo", "ano"], "left").withColumn("suspect_gap", F.coalesce("bad", F.lit(False)) & F.col("mes").between(first, last))
    return out.withColumn("y", F.when(~F.col("suspect_gap"), F.col("y"))).drop("bad")


def preferred(first: DataFrame, second: DataFrame, until: int) -> DataFrame:
    """first wins up to the month until, second after it; either fills what the other lacks."""
    both = first.select("geo", "p", "y", F.lit("first").alias("source")).unionByName(second.select("geo", "p", "y", F.lit("second").alias("source")))
    wins = F.when((F.col("source") == "first") == (F.col("p") <= until), 0).otherwise(1)
    best = Window.partitionBy("geo", "p").orderBy(wins, "source")
    return both.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """How two sources agree where both have a month."""
    both = first.select("geo", "p", F.col("y").alias("a")).join(second.select("geo", "p", F.col("y").alias("b")), ["geo", "p"])
    return both.groupBy("geo").agg(
        F.count(F.lit(1)).alias("months"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("match_share"),
        F.sum("a").alias("total_a"),
        F.sum("b").alias("total_b"),
        F.when((F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0), F.corr("a", "b")).alias("corr"),
    )


def longest_run(flags: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Longest run of consecutive rows with the flag, and their number, by keys."""
    by = Window.partitionBy(*keys).orderBy(order)
    island = F.row_number().over(by) - F.sum(F.col(flag).cast("int")).over(by)
    runs = flags.withColumn("island", island).groupBy(*keys, "island").agg(F.sum(F.col(flag).cast("int")).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"), F.sum("n").alias("total"))
