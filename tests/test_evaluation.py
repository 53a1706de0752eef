"""Scopes, calibration, guarded coverage, calendar lags, and ranks in a global order."""

import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import evaluation, ordering, spatial


def test_a_season_without_rows_has_no_measures_and_one_without_spread_no_r2(spark):
    rows = spark.createDataFrame([("s", 1, 10, 1, 4.0, 3.0, 0.0, 5.0), ("s", 2, 11, 2, 4.0, 6.0, 5.0, 7.0), ("t", 1, 10, 10, 0.0, 0.0, 0.0, 1.0)], "scope string, geo int, p int, mes int, y double, pred double, low80 double, high80 double")
    got = {r.scope: r for r in evaluation.evaluated(rows, "scope").collect()}
    s, t = got["s"], got["t"]
    assert (s.n_samples, s.wape_annual, s.mae_annual, s.r2_annual, s.ic80_annual, s.ic80_width_annual, s.recall10_annual) == (2, 0.375, 1.5, 0.0, 0.5, 3.5, 1.0)
    assert s.wape_critical is None and s.r2_critical is None and s.recall10_critical is None
    assert t.wape_annual is None and t.mape_annual is None and t.r2_critical == 0.0 and "undue_annual" not in got["s"].asDict()


def test_calibration_falls_back_from_critical_months_to_all_to_fixed_widths(spark):
    data = [("a", 10, float(i)) for i in range(11)] + [("a", 1, 100.0)] * 20 + [("b", 10, 1.0)] * 10 + [("b", 2, 3.0)] + [("c", 10, 9.0)] * 10
    q = evaluation.calibrated(spark.createDataFrame(data, "scope string, mes int, e double"))
    assert {r.scope: r.q80 for r in q.collect()} == {"a": 8.0, "b": 1.0}
    rows = spark.createDataFrame([(s, 4.0, 1.0, 1.0) for s in "abc"], "scope string, pred double, p_high double, p_extreme_regime double")
    bands = {r.scope: (r.low80, r.high80, r.high95) for r in evaluation.boosted_bands(rows, q).collect()}
    assert bands["c"] == pytest.approx((4 - 2 * 1.45, 4 + 2 * 1.45, 4 + 5 * 1.45)) and bands["a"][0] == 0.0


def test_coverage_fails_closed_and_lags_go_by_the_calendar(spark):
    good = spark.createDataFrame([(1, 0.995)], "zone int, covered double")
    assert evaluation.guarded_zonal(good).first().covered == 0.995
    for bad in (0.98, None):
        with pytest.raises(Exception, match="coverage below"):
            evaluation.guarded_zonal(spark.createDataFrame([(1, bad)], good.schema)).collect()
    rows = spark.createDataFrame([(1, p, float(p)) for p in (10, 11, 13, 14, 15, 16)], "zone int, p int, v double")
    got = {r.p: (r.v_lag1, r.v_lag2, r.v_roll3) for r in evaluation.calendar_lags(rows, ["zone"], "v").collect()}
    assert got == {10: (None, None, None), 11: (10.0, None, None), 13: (None, 11.0, None), 14: (13.0, None, None), 15: (14.0, 13.0, None), 16: (15.0, 14.0, 14.0)}


def test_global_order_equals_a_sort_in_memory(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.choice([None, 1.0, 2.0, 5.0, -3.0])) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {(r.g, r.v): (r["rank"], r.n) for r in ordering.average_ranks(df, ["g"], "v").collect()}
    for g in "ab":
        values = sorted(v for h, v in data if h == g and v is not None)
        for v in set(values):
            places = [i + 1 for i, x in enumerate(values) if x == v]
            assert got[g, v] == (sum(places) / len(places), len(values))
    sums = ordering.running(spark.range(50).withColumn("w", F.col("id") % 3), ["id"], "w").collect()
    assert sorted((r.id, r.before) for r in sums) == [(i, sum(k % 3 for k in range(i))) for i in range(50)]


def test_station_means_do_not_depend_on_how_stations_are_dealt(spark, monkeypatch):
    places = spark.createDataFrame([(g, p, float(g), 1.0) for g in range(3) for p in (1, 2)], "geo int, p int, lat double, lon double")
    stations = spark.createDataFrame([(s, 1, s / 10, 0.5, float(s) if s != 4 else None) for s in range(30)], "station int, p int, lat double, lon double, v double")
    whole = {(r.geo, r.p): (r.idw, r.stations) for r in spatial.station_means(places, stations).collect()}
    monkeypatch.setattr(spatial, "STATIONS", 4)
    parts = {(r.geo, r.p): (r.idw, r.stations) for r in spatial.station_means(places, stations).collect()}
    assert set(whole) == set(parts) == {(0, 1), (1, 1), (2, 1)}
    assert all(parts[k] == (pytest.approx(v[0]), 29) and v[1] == 29 for k, v in whole.items())
