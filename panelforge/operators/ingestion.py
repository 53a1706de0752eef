"""From vendors' rows to mapped, deduplicated months: whole canonical events, names to dimensions, and a report made while writing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import plain_name
from panelforge.operators.intake import picked, trimmed

#: The regions' names, without marks, and their codes.
REGIONS = {"ceara": "CE", "pernambuco": "PE", "piaui": "PI"}
#: Canonical columns that both vendors have, the names under which they have them, and their type.
SHARED = {
    "state_name": (("Estado",), "string"),
    "municipality_raw": (("Município",), "string"),
    "biome": (("Bioma",), "string"),
    "dry_days": (("N. Dias Sem Chuva", "DiaSemChuva"), "double"),
    "rain": (("Precipitação",), "double"),
    "risk": (("Risco Fogo", "RiscoFogo"), "double"),
    "lat": (("Latitude",), "double"),
    "lon": (("Longitude",), "double"),
    "frp": (("FRP",), "double"),
}


def _canonical(df: DataFrame, time: Column, local: Column, satellite: Column, source: Column) -> DataFrame:
    """Names are found without regard to case and marks; numbers that are none are NULL."""
    shared = [F.trim(picked(df, *names).cast("string")).alias(c) if kind == "string" else picked(df, *names).try_cast(kind).alias(c) for c, (names, kind) in SHARED.items()]
    return df.select(time.cast("timestamp").alias("time_utc"), satellite.alias("satellite"), *shared, source.alias("source_file"), F.year(local).alias("ano"), F.month(local).alias("mes"), F.date_format(local, "yyyy-MM-dd").alias("event_date"))


def first_vendor(df: DataFrame, source: Column) -> DataFrame:
    """Universal times and a satellite; months and dates are those three hours earlier."""
    df = trimmed(df)
    time = F.try_to_timestamp(picked(df, "Data / Hora", "DataHora"))
    return _canonical(df, time, time - F.expr("INTERVAL 3 HOURS"), F.trim(picked(df, "Satélite").cast("string")), source)


def second_vendor(df: DataFrame, source: Column) -> DataFrame:
    """Local times with the day first, no universal time and no satellite."""
    df = trimmed(df)
    raw = picked(df, "DataHora")
    local = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")])
    return _canonical(df, F.lit(None), local, F.lit("UNKNOWN"), source)


def lookup(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """key (plain name), uf, geo and name of a JSON array of places, or of lines of JSON; a key that stands for two places is an error."""
    rows = spark.read.schema("geocodigo long, nome string, municipio_ibge string, uf string").option("multiLine", not lines).json(path)
    name = F.coalesce("municipio_ibge", "nome")
    named = rows.select(plain_name(name).alias("key"), F.upper("uf").alias("uf"), F.col("geocodigo").alias("geo"), name.alias("name"))
    by = named.groupBy("key", "uf").agg(F.countDistinct("geo").alias("n"), F.min("geo").alias("geo"), F.min("name").alias("name"))
    twice = F.raise_error(F.concat(F.lit("two places are named "), F.col("key"), F.lit(" in "), F.col("uf"))).cast("long")
    return by.select("key", "uf", F.when(F.col("n") == 1, F.col("geo")).otherwise(twice).alias("geo"), "name")


def member_place(source: Column) -> Column:
    """The place that an archive member is about: its folder, else its name without the last two parts."""
    member = F.regexp_extract(source, "^(?:[^:]*:)?(.*)$", 1)
    parts = F.split(member, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.regexp_replace(stem, "_[^_]*_[^_]*$", ""))


def mapped(events: DataFrame, places: DataFrame, regions: Mapping[str, str] = REGIONS) -> DataFrame:
    """events with uf, geo and name, by plain name and region.

    An event without a name takes that of its archive member. Fails closed: a region or place
    that is not known ends the job, with the name in the error. places is a dimension, of a row
    a place, and is joined by Spark's own choice.
    """
    codes = F.create_map(*[F.lit(x) for pair in regions.items() for x in pair])
    unknown = lambda what, c: F.raise_error(F.concat(F.lit(f"no such {what}: "), F.coalesce(c, F.lit("NULL")))).cast("string")
    uf = F.coalesce(F.try_element_at(codes, plain_name(F.col("state_name"))), unknown("region", F.col("state_name")))
    raw = F.coalesce(F.nullif(F.trim("municipality_raw"), F.lit("")), member_place(F.col("source_file")))
    keyed = events.withColumns({"uf": uf, "_key": plain_name(raw)})
    joined = keyed.join(places.withColumnRenamed("key", "_key"), ["_key", "uf"], "left")
    geo = F.coalesce("geo", unknown("place", F.concat_ws(", ", "_key", "uf")).cast("long"))
    return joined.withColumn("geo", geo).drop("_key")


def located(targets: DataFrame, coordinates: DataFrame) -> DataFrame:
    """targets (with name) with lat and lon by plain name; a target without coordinates ends the job."""
    points = coordinates.select(plain_name(F.col("name")).alias("_key"), F.col("lat").alias("_lat"), "lon").dropDuplicates(["_key"])
    joined = targets.withColumn("_key", plain_name(F.col("name"))).join(points, "_key", "left")
    missing = F.raise_error(F.concat(F.lit("no coordinates: "), F.coalesce("name", F.lit("NULL")))).cast("double")
    return joined.withColumn("lat", F.coalesce("_lat", missing)).drop("_key", "_lat")


class Ingestion:
    """Union of a mode's sources, without repeats, as months in a written table; report() tells what the writing pass has counted.

    Counts are observed where the rows pass: nothing is scanned again for the report. Entities
    are counted by marking the first row of each, so no set of them is gathered; regions are
    few, and their set is. A row that is no event goes through all steps and is left out at the
    end: Spark cuts steps off that get no rows, and their counts would never come.
    """

    MODES = {"local": ("local",), "api": ("api",), "hybrid": ("local", "api")}

    def __init__(self, mode: str, sources: Mapping[str, DataFrame | None], keys: Sequence[str]):
        if mode not in self.MODES:
            raise ValueError(f"unknown mode {mode}")
        used = {n: sources[n] for n in self.MODES[mode] if sources.get(n) is not None}
        if not used:
            raise ValueError(f"no source for mode {mode}")
        self.keys, self.read, self.kept, self.made = list(keys), Observation("read"), Observation("kept"), Observation("made")
        spark = next(iter(used.values())).sparkSession
        marked = [df.withColumn("_from", F.lit(n)) for n, df in used.items()] + [spark.range(1).select(F.lit("").alias("_from"))]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
        counts = [F.count_if(F.col("_from") == n).alias(n) for n in self.MODES["hybrid"]]
        self.rows = rows.observe(self.read, *counts).withColumn("_event", F.col("_from") != "").drop("_from")

    def months(self) -> DataFrame:
        """geo, uf, ano, mes, events, frp_sum and frp_mean."""
        event = F.col("_event")
        once = self.rows.dropDuplicates([*self.keys, "_event"]).observe(self.kept, F.count_if(event).alias("n"))
        out = once.groupBy("geo", "uf", "ano", "mes", "_event").agg(F.count(F.lit(1)).alias("events"), F.sum("frp").alias("frp_sum"), F.avg("frp").alias("frp_mean"))
        names = [c for c in out.columns if c != "_event"]
        first = F.row_number().over(Window.partitionBy("_event", "geo").orderBy("ano", "mes", "uf")) == 1
        real = lambda c: F.when(event, c)
        p = real(F.col("ano") * 12 + F.col("mes"))
        ends = {f"{c}{i}": how(real(F.col(c))) for c in ("ano", "mes") for i, how in ((0, F.min), (1, F.max))}
        counts = {"rows": F.count_if(event), "entities": F.count_if(event & F.col("_first") & F.col("geo").isNotNull()), "regions": F.size(F.collect_set(real(F.col("uf")))), "first": F.min(p), "last": F.max(p), **ends}
        return out.withColumn("_first", first).observe(self.made, *[c.alias(n) for n, c in counts.items()]).where(event).select(*names)

    def write(self, path: str) -> None:
        months = self.months()
        self.columns, self.path = len(months.columns), path
        months.write.mode("overwrite").parquet(path)

    def report(self, spark: SparkSession) -> DataFrame:
        """One row, of the pass that wrote. date_min and date_max join the least (greatest) year and the least (greatest) month."""
        made, kept = self.made.get, self.kept.get["n"]
        read = self.read.get
        label = lambda a, m: "N/A" if made[a] is None else f"{made[a]}-{made[m]:02d}"
        month = lambda p: "N/A" if p is None else f"{(p - 1) // 12}-{(p - 1) % 12 + 1:02d}"
        row = (self.path, read["local"], read["api"], sum(read.values()) - kept, made["rows"], self.columns, label("ano0", "mes0"), label("ano1", "mes1"), month(made["first"]), month(made["last"]), made["entities"], made["regions"])
        return spark.createDataFrame([row], "path string, read_local long, read_api long, repeats long, rows long, columns int, date_min string, date_max string, first string, last string, entities long, regions int")
