"""The polyconic projection against a published point, plain quadrature and its own inverse."""

import math

import pytest
from pyspark.sql import functions as F

from panelforge.functions.projection import BRAZIL, Polyconic

POINTS = [(0.0, -54.0), (0.0, -40.0), (-7.5, -39.0), (-33.7, -53.4), (5.2, -60.1), (-0.0001, -48.3), (-20.0, -74.0), (1e-13, -50.0), (40.0, -54.0)]


def by_quadrature(p, lat, lon):
    """The definition, with the meridian's arc integrated by Gauss's rule of many short pieces."""
    phi, wide = math.radians(lat), math.radians(lon - p.lon0)
    nodes = ((-0.7745966692414834, 5 / 9), (0.0, 8 / 9), (0.7745966692414834, 5 / 9))

    def arc(to):
        n, total = 400, 0.0
        for i in range(n):
            mid, half = (i + 0.5) * to / n, to / n / 2
            total += sum(w * half * p.a * (1 - p.e2) / (1 - p.e2 * math.sin(mid + half * t) ** 2) ** 1.5 for t, w in nodes)
        return total

    start = arc(math.radians(p.lat0))
    if phi == 0:
        return p.x0 + p.a * wide, p.y0 - start
    radius = p.a / math.sqrt(1 - p.e2 * math.sin(phi) ** 2) / math.tan(phi)
    turn = wide * math.sin(phi)
    # 1 - cos is taken by half the angle, which keeps its digits near the equator
    return p.x0 + radius * math.sin(turn), p.y0 + arc(phi) - start + radius * 2 * math.sin(turn / 2) ** 2


def test_within_a_millimetre_and_back(spark):
    df = spark.createDataFrame(POINTS, "lat double, lon double")
    x, y = BRAZIL.forward(F.col("lat"), F.col("lon"))
    out = df.select("lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = BRAZIL.inverse(F.col("x"), F.col("y"))
    for r in out.select("*", lat.alias("lat2"), lon.alias("lon2")).collect():
        assert (r.x, r.y) == pytest.approx(by_quadrature(BRAZIL, r.lat, r.lon), abs=1e-3)
        assert (r.lat2, r.lon2) == pytest.approx((r.lat, r.lon), abs=1e-9)


def test_published_example(spark):
    """Snyder, Map Projections: a Working Manual, numerical example of the polyconic: 40 N 75 W, Clarke 1866."""
    f = 1 - math.sqrt(1 - 0.00676866)
    x, y = Polyconic(6378206.4, f, 30.0, -96.0, 0.0, 0.0).forward(F.lit(40.0), F.lit(-75.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == pytest.approx((1776774.5, 1319657.8), abs=0.06)
