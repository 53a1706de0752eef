"""Audits over run reports whose shapes differ: each report is one VARIANT, and a field is looked for where any shape has it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """source (file name) and report, a VARIANT, of every JSON file; a mark at the start of a file is no part of it. Bad JSON gives NULL."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.try_parse_json(F.regexp_replace("value", "^\\uFEFF", "")).alias("report"))


def field(report: Column, paths: Sequence[str], kind: str) -> Column:
    """The value at the first of these paths that has one of this kind."""
    return F.coalesce(*[F.try_variant_get(report, p, kind) for p in paths])


def shapes(reports: DataFrame) -> DataFrame:
    """How many reports have each schema."""
    return reports.groupBy(F.schema_of_variant("report").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def line_audit(reports: DataFrame, fields: Mapping[str, tuple[str, Sequence[str]]], limits: Mapping[str, tuple[str, float]]) -> DataFrame:
    """source and the fields, name -> (kind, paths). limits: a passed column -> (measure, limit), where the report itself doesn't say."""
    out = reports.select("source", *[field(F.col("report"), paths, kind).alias(name) for name, (kind, paths) in fields.items()])
    for name, (measure, limit) in limits.items():
        said = F.col(name) if name in fields else F.lit(None).cast("boolean")
        out = out.withColumn(name, F.coalesce(said, F.col(measure) <= limit, F.lit(False)))
    return out


def summary(audit: DataFrame, measures: Sequence[str], passed: str) -> DataFrame:
    """One row: reports, how many passed, and the least of each measure."""
    return audit.agg(F.count(F.lit(1)).alias("reports"), F.sum(F.col(passed).cast("long")).alias("passed"), *[F.min(m).alias(f"best_{m}") for m in measures])
