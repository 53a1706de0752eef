"""Places and running sums in a global order, without a window that holds all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.tables import stored


def running(df: DataFrame, order: Sequence[str], value: str, name: str = "before") -> DataFrame:
    """df with the sum of value over all rows before, in ascending order of the columns order, which tell rows apart.

    Rows are dealt by range; each part is summed up by itself and starts from the sum of the
    parts before it, of which there is a row each.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(starts), "_part")  # a row a part
    return out.withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, rank (from 1, the average among equals) and n of the group, for each distinct value that is not null.

    Values are counted first, so what is ordered has a row for each distinct value of a group.
    """
    k = list(keys)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*k, value).agg(F.count(F.lit(1)).alias("_m"))
    placed = stored(running(sizes, [*k, value], "_m", "_before"), "ranks")
    groups = placed.groupBy(*k).agg(F.sum("_m").alias("n"), F.min("_before").alias("_first"))
    joined = placed.join(groups, k) if k else placed.crossJoin(F.broadcast(groups))  # one row
    return joined.select(*k, value, (F.col("_before") - F.col("_first") + (F.col("_m") + 1) / 2).alias("rank"), "n")
