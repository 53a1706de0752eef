"""Nearest neighbours without caps against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import spatial

RNG = random.Random(4)


def km(a, b):
    (p, q), (r, s) = ((math.radians(v) for v in x) for x in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return round(2 * 6371.0088 * math.asin(math.sqrt(min(h, 1))), 6)


def brute(rows, k, distance):
    out = []
    for g, a, o, u in rows:
        near = sorted((distance((a, o), (b, p)), h) for h, b, p, v in rows if h != g and v == u)[:k]
        out += [(g, h, pytest.approx(d, abs=1e-5), i + 1) for i, (d, h) in enumerate(near)]
    return sorted(out, key=lambda t: (t[0], t[3]))


PLACES = [(i, RNG.gauss(-10, 0.05), RNG.gauss(-40, 0.05), i % 2) for i in range(120)]
PLACES += [(200 + i, RNG.uniform(-89, 89), RNG.uniform(-180, 180), i % 2) for i in range(40)]
PLACES += [(300 + i, 5.5, 5.5, 0) for i in range(30)]
PLACES += [(400, 89.9, 10.0, 0), (401, 89.8, -170.0, 0), (402, -3.0, 179.99, 0), (403, -3.0, -179.98, 0), (404, 0.0, 180.0, 1), (405, 0.0, -180.0, 1), (406, -90.0, 3.0, 0)]


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_on_the_sphere_is_exact_for_lone_crowded_and_wrapped_places(spark, k, monkeypatch):
    monkeypatch.setattr(spatial, "CROWD", 5)
    df = spark.createDataFrame([(g, a, o) for g, a, o, _ in PLACES] + [(999, None, 1.0)], "geo int, lat double, lon double")
    got = sorted((r.src, r.dst, r.km, r.rank) for r in spatial.neighbours(df, k).collect())
    assert sorted(got, key=lambda t: (t[0], t[3])) == brute([(*p[:3], 0) for p in PLACES], k, km)


def test_nearest_in_the_plane_within_groups(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWD", 5)
    rows = [*PLACES, (500, 0.0, 0.0, 7), (501, 1.0, 1.0, 8), (502, 80.0, 1.0, 8)]
    df = spark.createDataFrame(rows, "geo int, lat double, lon double, uf int")
    got = [(r.src, r.dst, r.distance, r["rank"]) for r in spatial.nearest(df, 3, ["uf"], sphere=False).collect()]
    assert sorted(got, key=lambda t: (t[0], t[3])) == brute(rows, 3, lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]))
    assert spatial.nearest(df.limit(0), 3).count() == 0


def test_distances_that_the_weight_rounds_to_one_value_go_by_key(spark):
    # 71 lies in the middle of 17 and 125, but the distances differ in their last digit
    df = spark.createDataFrame([(k, k * 37 % 1000 / 100 - 12, k * 91 % 1000 / 100 - 45) for k in (17, 71, 125)], "geo long, lat double, lon double")
    plain = {r.dst: r.distance for r in spatial.nearest(df, 2, sphere=False).where("src = 71").collect()}
    assert plain[125] < plain[17] and math.exp(-0.5 * plain[125]) == math.exp(-0.5 * plain[17])
    got = spatial.nearest(df, 1, sphere=False, order=lambda d: -F.exp(-0.5 * d)).where("src = 71").collect()
    assert [r.dst for r in got] == [17]
