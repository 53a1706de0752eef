"""Every named query with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = "MDL12_champion"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame, and its SQL if SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def tidy(df: DataFrame, *keys: str, **values: Column | str) -> DataFrame:
    """keys and values; doubles rounded to 6 places, so that the order of sums doesn't show."""
    columns = [*(F.col(k) for k in keys), *((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items())]
    out = df.select(*columns)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


from panelforge.plans import band_queries, etl_queries, evaluation_queries, ingestion_queries, intake_queries, model_queries, more_queries, panel_queries, scope_queries, spatial_queries  # noqa: E402, F401
