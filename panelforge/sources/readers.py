"""Readers of the formats that events, stations, indices and services come in; writers with manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelforge.functions.expressions import locale_number
from panelforge.sources import archives


def csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header; rows that don't fit the schema come as NULLs, not as failures."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)


def zipped_csv(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """Lines of all CSV members of zip archives: source (zip:member), fields by header name.

    Members in UTF-8 are read so, others as Latin-1; members that can't be read to their end
    give no rows.
    """
    return archives.read(spark, path, pattern=pattern).select(F.concat("archive", F.lit(":"), "member").alias("source"), "fields")


def station_files(spark: SparkSession, path: str, preamble: int = 8) -> DataFrame:
    """Semicolon files with a key;value preamble and decimal commas: station, line number, parts.

    Read as whole texts; a station's year is one small file.
    """
    files = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines"))
    head = F.map_from_entries(F.transform(F.slice("lines", 1, preamble), lambda x: F.struct(F.lower(F.trim(F.split(x, "[:;]")[0])).alias("k"), F.trim(F.get(F.split(x, ";"), F.lit(1))).alias("v"))))
    body = F.posexplode(F.slice("lines", preamble + 2, 100_000_000)).alias("line", "text")
    names = F.split(F.get("lines", F.lit(preamble)), ";")
    rows = files.select(head.alias("head"), names.alias("names"), body).where(F.trim("text") != "")
    return rows.select("head", "names", "line", F.split("text", ";").alias("parts"))


def station_value(names: Column, parts: Column, word: str) -> Column:
    """The first column whose name has the word, as a number; the sentinel is NULL."""
    at = F.array_position(F.transform(names, lambda n: F.lower(n).contains(word)), True)
    return F.when(at > 0, locale_number(F.get(parts, (at - 1).cast("int"))))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def features(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a GeoJSON file: poly, closed outer ring, bounds."""
    geometry = "struct<type:string,coordinates:array<array<array<double>>>>"
    schema = f"features array<struct<properties:struct<id:string,name:string>,geometry:{geometry}>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    out = each.select(F.col("f.properties.id").alias("poly"), F.col("f.properties.name").alias("name"), ring.alias("ring"))
    side = lambda c, pick: pick(F.transform("ring", lambda p: p[c]))
    return out.withColumns({"x0": side("x", F.array_min), "x1": side("x", F.array_max), "y0": side("y", F.array_min), "y1": side("y", F.array_max)})


def index_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of a year and twelve values, parted by blanks: ano, mes, value; -99.9 is NULL."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where((F.size("x") == 13) & F.col("x")[0].rlike("^[0-9]{4}$"))
    each = parts.select(F.col("x")[0].cast("int").alias("ano"), F.posexplode(F.slice("x", 2, 12)).alias("i", "v"))
    number = F.col("v").try_cast("double")
    return each.select("ano", (F.col("i") + 1).alias("mes"), F.when(number > -99, number).alias("value"))


def daily_payload(df: DataFrame, body: str = "body") -> DataFrame:
    """Parallel arrays of a daily service answer as rows: every other column, day, temp, rain."""
    schema = "daily struct<time:array<string>,temperature_2m_mean:array<double>,precipitation_sum:array<double>>"
    d = df.withColumn("d", F.from_json(body, schema)["daily"])
    rows = F.explode(F.arrays_zip(d["d.time"].alias("day"), d["d.temperature_2m_mean"].alias("temp"), d["d.precipitation_sum"].alias("rain"))).alias("r")
    return d.select(*[c for c in df.columns if c != body], rows).select(*[c for c in df.columns if c != body], F.to_date("r.day").alias("day"), "r.temp", "r.rain")


def windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Date windows of a range request."""
    seq = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"interval {days} days"))
    return spark.range(1).select(F.explode(seq).alias("first")).select("first", F.least(F.date_add("first", days - 1), F.to_date(F.lit(end))).alias("last"))


class PointSource(DataSource):
    """A service asked point by point, as a Spark source: format("points").

    Options: points (JSON list of [id, lat, lon]) and url, with {lat} and {lon}. Each point is
    a partition, so a failed call is tried again by Spark alone.
    """

    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        return "id string, body string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PointReader(self.options)


class _PointReader(DataSourceReader):
    def __init__(self, options):
        self.points, self.url = json.loads(options["points"]), options["url"]

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(p) for p in self.points]

    def read(self, partition: InputPartition):
        from urllib.request import urlopen

        name, lat, lon = partition.value
        with urlopen(self.url.replace("{lat}", str(lat)).replace("{lon}", str(lon)), timeout=60) as answer:  # noqa: S310
            yield str(name), answer.read().decode()


def write_with_manifest(df: DataFrame, path: str, keys: Sequence[str]) -> dict:
    """Writes Parquet and, beside it, a manifest with the row count, keys and a content hash."""
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    back = spark.read.parquet(path)
    content = F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)"))  # equal rows add up; they don't cancel
    row = back.agg(F.count(F.lit(1)).alias("rows"), content.cast("string").alias("hash")).first()
    manifest = {"path": path, "rows": row["rows"], "content": row["hash"], "keys": list(keys), "columns": back.columns}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return manifest


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
