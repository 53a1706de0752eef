"""Conversations' rows in order, dealt over partitions by range, so that one conversation may take many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import shuffle_width, written

#: place holds the partition's number above these bits.
BITS = 33


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def in_order(rows: DataFrame, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A written table of rows (conv_id, turn, role, text and others) with place, a number in the order of all rows.

    Order: conv_id, turn, role, a hash of the text and the row's number in the input. Nulls come
    first. The last key lets equal rows, however many, lie in several partitions. then is applied
    inside partitions, to rows in order, before they are written.
    """
    keys = [c.asc_nulls_first() for c in (F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text"), F.col("row"))]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return written(then(dealt.withColumn("place", F.monotonically_increasing_id()).drop("row")), "turns")


def part(place: str = "place") -> Column:
    """Which partition of in_order() a row lies in."""
    return F.shiftright(F.col(place), BITS).cast("int")


def each_conversation(table: DataFrame, *order: str) -> DataFrame:
    """table by conversation, rows of one after another in order, for tasks that keep a running state and no rows."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", *order)]
    return table.repartition(shuffle_width(table.sparkSession), "conv_id").sortWithinPartitions(*keys)
