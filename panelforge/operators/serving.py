"""Answers for a service: single forecasts, their parts, and checked explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expressions import numeric_tokens

#: Numbers that an explanation may use freely, and how near others must be.
FREE_NUMBERS, NEAR = (0.0, 1.0, 2.0, 10.0, 12.0, 90.0), 0.005


def packets(forecasts: DataFrame, width: float) -> DataFrame:
    """Each forecast with its parts, band, and whether the parts give it again."""
    again = F.col("clim") * F.col("ratio")
    return forecasts.select(
        "geo",
        "p",
        F.col("champion").alias("pred"),
        F.struct("clim", "ratio").alias("parts"),
        F.greatest(F.col("champion") - width, F.lit(0.0)).alias("low"),
        (F.col("champion") + width).alias("high"),
        (F.abs(again - F.col("champion")) <= 1e-12).alias("verified"),
    )


def narrative(df: DataFrame) -> Column:
    return F.format_string("Entity %d in month %d: forecast %.2f from a mean of %.2f times %.2f.", "geo", "p", "pred", "parts.clim", "parts.ratio")


def grounded(text: Column, numbers: Column) -> Column:
    """Whether every number in the text is near one of the numbers or free."""
    allowed = F.concat(numbers, F.array(*map(F.lit, FREE_NUMBERS)))
    return F.forall(numeric_tokens(text), lambda t: F.exists(allowed, lambda a: F.abs(a - t) <= NEAR))


def attribution(df: DataFrame) -> Column:
    """The forecast's graph as JSON: what goes into what."""
    node = lambda name, v: F.struct(F.lit(name).alias("name"), v.cast("double").alias("value"))
    edge = lambda a, b: F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"))
    nodes = F.array(node("clim", F.col("parts.clim")), node("ratio", F.col("parts.ratio")), node("pred", F.col("pred")))
    return F.to_json(F.struct(nodes.alias("nodes"), F.array(edge("clim", "pred"), edge("ratio", "pred")).alias("edges")))
