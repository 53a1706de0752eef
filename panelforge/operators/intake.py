"""Reading vendors' columns into one schema, and the joins and scores that stand next to intake."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import expressions as e
from panelforge.operators.quantiles import wide

#: Signs that stand for nothing in statistical tables, and letters of confidence.
ZERO_SIGNS = ("", "-", "..", "...", "X")
CONFIDENCE = {"l": 30.0, "n": 60.0, "h": 90.0}


def trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def picked(df: DataFrame, *aliases: str) -> Column:
    """The first column of one of these names: as written, else without regard to case, else to marks too; NULL if there is none."""
    lower, plain = ({f(c): c for c in reversed(df.columns)} for f in (str.lower, words_of))
    bare = [words_of(a) for a in aliases]
    for found in (next((a for a in aliases if a in df.columns), None), next((lower[a.lower()] for a in aliases if a.lower() in lower), None), next((plain[a] for a in bare if a and a in plain), None)):
        if found is not None:
            return F.col("`" + found.replace("`", "``") + "`")
    return F.lit(None)


def words_of(name: str) -> str:
    """A column's name without marks, in upper case, its runs of other signs than letters and digits as one blank."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join(re.findall("[0-9A-Z]+", plain.upper()))


def holding(df: DataFrame, token: str) -> Column:
    """The first column whose words hold the token's; NULL if there is none."""
    return next((F.col(f"`{c.replace('`', '``')}`") for c in df.columns if words_of(token) in words_of(c)), F.lit(None))


def renamed(df: DataFrame, parts: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns under the first name of which they have a part, in any case; the others as they are.

    A name is given once: later columns that would have it too keep their own.
    """
    given: dict[str, str] = {}
    for c in df.columns:
        new = next((n for n, some in parts.items() if any(x in c.lower() for x in some)), None)
        if new and new not in given.values() and (new == c or new not in df.columns):
            given[c] = new
    return df.toDF(*[given.get(c, c) for c in df.columns])


def entity_name(name: Column, suffixes: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """Lower case without marks or apostrophes, single blanks, no state's suffix, known aliases put right."""
    plain = F.translate(F.lower(name), e.ACCENTED + "'", e.PLAIN)
    one = F.trim(F.regexp_replace(plain, r"[_\s-]+", " "))
    short = F.regexp_replace(one, f" ({'|'.join(suffixes)})$", "")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, short), short)


def _canonical(df: DataFrame, time_utc: Column, local: Column, satellite: Column, source: str) -> DataFrame:
    return df.select(
        picked(df, "id").cast("long").alias("id"),
        time_utc.cast("timestamp").alias("time_utc"),
        satellite.alias("satellite"),
        picked(df, "frp").try_cast("double").alias("power"),
        F.lit(source).alias("source_file"),
        F.year(local).alias("ano"),
        F.month(local).alias("mes"),
    )


def first_format(df: DataFrame, source: str) -> DataFrame:
    """Universal times and a satellite; months are those of the time three hours earlier."""
    df = trimmed(df)
    time = F.try_to_timestamp(picked(df, "Data / Hora", "DataHora"))
    return _canonical(df, time, time - F.expr("INTERVAL 3 HOURS"), F.trim(picked(df, "Satelite")), source)


def second_format(df: DataFrame, source: str) -> DataFrame:
    """Local times with the day first, and no satellite."""
    df = trimmed(df)
    return _canonical(df, F.lit(None), F.try_to_timestamp(picked(df, "DataHora"), F.lit("dd/MM/yyyy HH:mm")), F.lit("UNKNOWN"), source)


def symbolic_value(raw: Column) -> Column:
    """Signs for nothing are 0; numbers may have a comma and blanks; NULL and other texts are NULL."""
    text = F.trim(raw)
    number = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(text.isin(*ZERO_SIGNS), 0.0).otherwise(number)


def acquired(df: DataFrame, date: str = "acq_date", time: str = "acq_time") -> DataFrame:
    """df with time_utc out of a date and a whole number of hours and minutes, and ano, mes and dia three hours earlier; fails on a bad row."""
    digits = F.regexp_extract(F.coalesce(time, F.lit("0")), r"(\d+)", 1)
    clock = F.lpad(F.when(digits == "", "0").otherwise(digits), 4, "0")
    text = F.concat(F.col(date), F.lit(" "), clock)
    found = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmm"))
    out = df.withColumn("time_utc", F.coalesce(found, F.raise_error(F.concat(F.lit("no time: "), F.coalesce(text, F.lit("NULL")))).cast("timestamp")))
    local = F.col("time_utc") - F.expr("INTERVAL 3 HOURS")
    return out.withColumn("ano", F.year(local)).withColumn("mes", F.month(local)).withColumn("dia", F.day(local))


def confidence(raw: Column) -> Column:
    """Numbers as they are, letters by their number, else NULL."""
    letters = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return F.coalesce(raw.try_cast("double"), F.try_element_at(letters, F.lower(raw)))


def without_suffixes(df: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """df without columns that a merge has doubled: those with a suffix whose plain name is there too."""
    return df.drop(*[c for c in df.columns for s in suffixes if c.endswith(s) and c.removesuffix(s) in df.columns])


def source_of(column: str, parts: Mapping[str, str]) -> str:
    """The source whose mark the column's name holds."""
    return next((source for mark, source in parts.items() if mark in column.lower()), "unknown")


def of_sensor(events: DataFrame, sensor: str) -> DataFrame:
    """Events of one sensor; a table that doesn't name sensors is refused."""
    if "sensor" not in events.columns:
        raise ValueError("events without a sensor column can't be a target")
    return events.where(F.col("sensor") == sensor)


def scored_against(forecasts: DataFrame, observed: DataFrame, absent_is_zero: bool, target: str) -> DataFrame:
    """One row: forecasts with a truth, forecasts without, and the truth's sum."""
    joined = forecasts.join(observed.select("geo", "p", "y"), ["geo", "p"], "left")
    y = F.coalesce("y", F.lit(0.0)) if absent_is_zero else F.col("y")
    return joined.agg(F.count(y).alias("valid"), (F.count(F.lit(1)) - F.count(y)).alias("missing"), F.sum(y).alias("y")).select(F.lit(target).alias("target"), "*")


def aggregated(df: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """Rows, means and maxima by key of those wanted columns that df has."""
    there = [c for c in wanted if c in df.columns]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.round(f(c), 6).alias(f"{c}_{s}") for c in there for f, s in ((F.avg, "mean"), (F.max, "max"))])


def row_normalised(weights: DataFrame, k: int) -> DataFrame:
    """The k largest weights of each a, over their sum."""
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
    top = weights.withColumn("r", best).where(F.col("r") <= k).drop("r")
    return top.withColumn("w", F.col("w") / (F.sum("w").over(Window.partitionBy("a")) + 1e-6))


def prediction_blocks(blocks: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [b.select("geo", "p", "prediction", F.lit(name).alias("model")) for name, b in blocks.items()])


def magnitude_scale(events: DataFrame) -> DataFrame:
    """One row: the median of the logarithm of positive magnitudes, 1 if there are none."""
    sizes = events.where("frp > 0").select(F.log1p("frp").alias("size"))
    return wide(sizes, "size", [], {"scale": 0.5}).agg(F.coalesce(F.max("scale"), F.lit(1.0)).alias("scale"))


def strength(mode: str) -> Column:
    """Strength of an event with frp, risk and scale: 1, by magnitude, or by magnitude and risk."""
    by_size = e.clip(1 + F.log1p(F.greatest(F.coalesce("frp", F.lit(0.0)), F.lit(0.0))) / F.col("scale"), 1.0, 6.0)
    by_risk = e.clip(0.5 + e.clip(F.coalesce("risk", F.lit(0.0)), 0.0, 1.0), 0.5, 1.5)
    return {"count": F.lit(1.0), "frp": by_size, "frp_risk": by_size * by_risk}[mode]


def regime_quantiles(rows: DataFrame) -> DataFrame:
    """q80 and q95 of absolute errors over all rows, and over the critical months if they are more than 10 rows."""
    names = F.array_compact(F.array(F.lit("global"), F.when(F.col("mes").isin(10, 11), "critical")))
    each = rows.select(F.explode(names).alias("regime"), F.abs(F.col("y") - F.col("champion")).alias("e"))
    out = wide(each, "e", ["regime"], {"q80": 0.8, "q95": 0.95})
    return out.where("regime = 'global' OR n > 10")


def within(places: DataFrame, targets: DataFrame, km: float, cell: float) -> DataFrame:
    """places with km to the nearest target, if that is at most km. cell: degrees, at least the distance's width at these latitudes."""
    by = lambda c: F.floor(F.col(c) / cell)
    spread = [F.explode(F.sequence(by(c) - 1, by(c) + 1)).alias(f"{c}_cell") for c in ("lat", "lon")]
    around = targets.select("lon", F.col("lat").alias("tlat"), spread[0]).select("tlat", "lat_cell", F.col("lon").alias("tlon"), spread[1])
    near = places.withColumn("lat_cell", by("lat")).withColumn("lon_cell", by("lon")).join(around, ["lat_cell", "lon_cell"])
    distance = e.haversine_km(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"))
    return near.groupBy("geo").agg(F.min(distance).alias("km")).where(F.col("km") <= km)
