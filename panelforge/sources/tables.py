"""The fixture tables as domain tables: point events, entities and regions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder all executors share; a temporary one only where none is named and all run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read from there: what several passes read is made once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, names: set[str]) -> DataFrame:
    """Fails before any job if a column is missing."""
    if missing := names - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def point_events(spark: SparkSession, folder: str) -> DataFrame:
    """One row an event: geo (entity), time, month ordinal p = ano * 12 + mes, magnitude, sensor and covariates."""
    t = table(spark, folder, "lineitem")
    time = F.col("l_shipdate")
    return t.select(
        F.col("l_suppkey").alias("geo"),
        time.alias("time"),
        F.year(time).alias("ano"),
        F.month(time).alias("mes"),
        (F.year(time) * 12 + F.month(time)).alias("p"),
        F.col("l_extendedprice").alias("frp"),
        F.col("l_returnflag").alias("sensor"),
        F.col("l_quantity").alias("risk"),
        F.col("l_discount").alias("dry"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """geo, its region uf, and coordinates made from the key."""
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    k = F.col("s_suppkey")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(  # nation has 25 rows at any scale
        k.alias("geo"),
        F.col("n_regionkey").alias("uf"),
        ((k * 37 % 1000) / 100 - 12).alias("lat"),
        ((k * 91 % 1000) / 100 - 45).alias("lon"),
        F.col("s_acctbal").alias("area"),
    )
