"""Checks of tables: nulls, leaks, duplicates, freshness, name rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.ordering import average_ranks

#: Parts of names that mark a column as made from the target.
FORBIDDEN = ("fire_count", "occurrence", "extreme_event", "frp")


def null_fractions(df: DataFrame) -> DataFrame:
    """name and null_fraction of every column, in one pass."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "name", "null_fraction")


def leakage(df: DataFrame, target: str, limit: float) -> DataFrame:
    """Correlation of every other column with the target, and whether it is over the limit."""
    names = [c for c in df.columns if c != target]
    row = df.agg(*[F.corr(c, target).alias(c) for c in names]).unpivot([], names, "name", "corr")
    return row.withColumn("leaks", F.abs("corr") > limit)


def safe_names(columns: Sequence[str]) -> list[str]:
    """Columns whose names don't give them away as the target."""
    return [c for c in columns if not any(re.search(rf"(^|_){f}", c.lower()) for f in FORBIDDEN)]


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson, and Spearman by average ranks. Ranks are found by counting values, not rows, in order."""
    def ranks(c: str) -> DataFrame:
        return average_ranks(df, [], c).select(c, F.col("rank").alias(f"r_{c}"))

    out = df.join(ranks(a), a).join(ranks(b), b)
    return out.agg(F.corr(a, b).alias("pearson"), F.corr(f"r_{a}", f"r_{b}").alias("spearman"))


def census(df: DataFrame, key: Sequence[str], entity: str) -> DataFrame:
    """Rows, rows beyond the first of each key, and entities."""
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))
    return sizes.crossJoin(df.agg(F.countDistinct(entity).alias("entities")))


def freshness(seen: DataFrame, limit: int = 2) -> DataFrame:
    """Latest month of each entity, how far it is behind the latest of all, and whether that is too far."""
    each = seen.groupBy("geo").agg(F.max("p").alias("latest"))
    out = each.crossJoin(seen.agg(F.max("p").alias("last")))
    return out.select("geo", "latest", (F.col("last") - F.col("latest")).alias("behind"), (F.col("last") - F.col("latest") > limit).alias("stale"))
