"""Column expressions with the null rules of the panel: NULL marks missing, NaN never appears."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Latin letters with marks and what they become without.
ACCENTED, PLAIN = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
EARTH_KM = 6371.0088


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def share(part: Column, whole: Column) -> Column:
    """part / whole; NULL where the whole is 0 or NULL."""
    return F.try_divide(part, whole)


def clip(c: Column, low: float, high: float) -> Column:
    """Within [low, high]; NULL stays NULL, which least and greatest alone would not keep."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def guarded(window: WindowSpec, value: Column, least: int, how=F.avg) -> Column:
    """how(value) over the window if it holds at least that many values."""
    return F.when(F.count(value).over(window) >= least, how(value).over(window))


def ordered(*keys: str, order: str = "p") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, *keys: str, order: str = "p") -> WindowSpec:
    """The n rows before the current one."""
    return ordered(*keys, order=order).rowsBetween(-n, -1)


def history(*keys: str, order: str = "p") -> WindowSpec:
    """All rows before the current one."""
    return ordered(*keys, order=order).rowsBetween(Window.unboundedPreceding, -1)


def average_rank_share(value: Column, keys: Sequence[str]) -> Column:
    """Average rank among equals over the number of values; NULL for NULL."""
    by = Window.partitionBy(*keys).orderBy(value.asc_nulls_last())
    ties = Window.partitionBy(*keys, value)
    return F.when(value.isNotNull(), (F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(value).over(Window.partitionBy(*keys)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def plain_name(c: Column) -> Column:
    """Lower case without accents; separators become single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[\s_'-]+", " "))


def locale_number(c: Column, missing: str = "-9999") -> Column:
    """A number with dots for thousands and a decimal comma; the sentinel and text are NULL."""
    bare = F.trim(c)
    number = F.when(bare.contains(","), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    return F.when(bare != missing, number.try_cast("double"))


def numeric_tokens(c: Column) -> Column:
    """Numbers written in a text, as doubles."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def saturation_pressure_kpa(celsius: Column) -> Column:
    return 0.6108 * F.exp(17.27 * celsius / (celsius + 237.3))
