"""Small literal cases of the panel's rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import expressions as e
from panelforge.operators import audit, features, metrics, monitoring, panel
from panelforge.sources.tables import require_columns


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rolling_and_year_to_date_exclude_the_current_month(spark):
    df = spark.createDataFrame([(1, 2024, m, 2024 * 12 + m, float(10 * m)) for m in (1, 2, 3)], "geo int, ano int, mes int, p int, y double")
    out = features.cumulative(features.rolling(df))
    assert rows(out, "mes", "roll3", "ytd") == [(1, None, 0.0), (2, 10.0, 10.0), (3, 15.0, 30.0)]


def test_zero_fill_stays_inside_the_window_and_skips_inverted_ones(spark):
    seen = spark.createDataFrame([(1, 24291, 7.0)], "geo int, p int, y double")
    windows = spark.createDataFrame([(1, 24289, 24294), (2, 24310, 24309)], "geo int, lo int, hi int")
    out = panel.zero_filled(seen, windows)
    assert rows(out, "geo", "p", "y", "assumed_zero")[:3] == [(1, 24289, 0.0, True), (1, 24290, 0.0, True), (1, 24291, 7.0, False)]
    assert out.count() == 6


def test_gap_years_are_quarantined_only_between_years_with_events(spark):
    data = [(1, y, m, y * 12 + m, 5.0 if y != 2023 and m >= 8 else 0.0) for y in (2022, 2023, 2024) for m in range(1, 13)]
    df = spark.createDataFrame(data, "geo int, ano int, mes int, p int, y double")
    bad = panel.gaps_quarantined(df).where("suspect_gap")
    assert rows(bad, "ano", "mes", "y") == [(2023, m, None) for m in range(8, 13)]
    assert panel.gaps_quarantined(df.withColumn("y", F.lit(0.0))).where("suspect_gap").count() == 0


def test_source_preference_changes_with_the_month(spark):
    a = spark.createDataFrame([(1, 10, 3.0), (1, 20, 4.0)], "geo int, p int, y double")
    b = spark.createDataFrame([(1, 10, 9.0), (1, 20, 8.0), (1, 5, 2.0)], "geo int, p int, y double")
    assert rows(panel.preferred(a, b, 12), "p", "y", "source") == [(5, 2.0, "second"), (10, 3.0, "first"), (20, 8.0, "second")]


def test_names_and_locale_numbers(spark):
    names = spark.createDataFrame([("Vale_do-Rio  Açu",), ("ÉVORA",), (None,)], "n string").select(e.plain_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["vale do rio acu", "evora", None]
    numbers = spark.createDataFrame([("3,25",), ("12.000,5",), ("-7",), (None,)], "n string").select(e.locale_number(F.col("n"))).collect()
    assert [r[0] for r in numbers] == [3.25, 12000.5, -7.0, None]


def test_intake_rules(spark):
    from panelforge.operators import intake

    df = spark.createDataFrame([("x", 1)], " A string, b int")
    assert intake.trimmed(df).columns == ["A", "b"]
    assert intake.trimmed(df).select(intake.picked(intake.trimmed(df), "nothing", "B").alias("v")).first().v == 1
    values = spark.createDataFrame([(" - ",), ("1 234,5",), ("word",), (None,), ("X",)], "v string")
    assert [r[0] for r in values.select(intake.symbolic_value(F.col("v"))).collect()] == [0.0, 1234.5, None, None, 0.0]
    times = spark.createDataFrame([("2020-01-01", "105"), ("2020-01-01", "7"), ("2020-03-01", None)], "acq_date string, acq_time string")
    assert [(r.mes, r.dia, r.time_utc.hour, r.time_utc.minute) for r in intake.acquired(times).collect()] == [(12, 31, 1, 5), (12, 31, 0, 7), (2, 29, 0, 0)]
    with pytest.raises(Exception, match="no time"):
        intake.acquired(spark.createDataFrame([("2020-01-01", "2575")], "acq_date string, acq_time string")).collect()
    with pytest.raises(ValueError, match="sensor"):
        intake.of_sensor(df, "R")
    seen = spark.createDataFrame([(1, 5, 3.0)], "geo int, p int, y double")
    ahead = spark.createDataFrame([(1, 5), (2, 5)], "geo int, p int")
    assert intake.scored_against(ahead, seen, True, "t").first()[1:] == (2, 0, 3.0)
    assert intake.scored_against(ahead, seen, False, "t").first()[1:] == (1, 1, 3.0)


def test_bootstrap_spreads_as_resampling_does(spark):
    data = [(p, float(1 + p % 7), float(p % 7) + (p * 37 % 11) / 3, float(p % 7) + (p * 53 % 13) / 3) for p in range(60)]
    df = spark.createDataFrame(data, "p int, y double, a double, b double")
    got = np.array([r.delta for r in metrics.block_bootstrap(df, "a", "b").collect()])
    p, y, a, b = map(np.array, zip(*data, strict=True))
    picks = np.random.default_rng(1).integers(0, 60, (2000, 60))
    want = (np.abs(y - a)[picks].sum(1) - np.abs(y - b)[picks].sum(1)) / y[picks].sum(1)
    assert len(np.unique(got.round(9))) > 0.9 * len(np.unique(want.round(9))) > 1000
    assert got.mean() == pytest.approx(want.mean(), abs=0.01) and got.std() == pytest.approx(want.std(), rel=0.1)



def test_gate_fails_closed(spark):
    row = spark.createDataFrame([(0.1, None)], "wape double, best double")
    out = metrics.gate(row, {"wape": 0.5, "best": 1.0}).first()
    assert not out.passed and out.reasons == "best missing"


def test_target_names_are_not_selectable():
    assert audit.safe_names(["fire_count", "occurrence", "extreme_event", "FRP_sum", "temperature"]) == ["temperature"]


def test_log_takes_each_record_once(spark):
    log = spark.createDataFrame([(1, 5)], "geo int, p int")
    batch = spark.createDataFrame([(1, 5), (2, 5), (2, 5)], "geo int, p int")
    assert rows(monitoring.new_records(batch, log, ["geo", "p"]), "geo", "p") == [(2, 5)]


def test_average_ranks_and_empty_measures(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None)], "k int, v double")
    got = [r[0] for r in df.select(e.average_rank_share(F.col("v"), ["k"]).alias("r")).collect()]
    assert sorted(x for x in got if x is not None) == [pytest.approx(1 / 3), pytest.approx(2.5 / 3), pytest.approx(2.5 / 3)]
    zero = spark.createDataFrame([(0.0, 1.0)], "y double, p double").agg(metrics.wape(F.col("y"), F.col("p"))).first()[0]
    assert zero is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="frp"):
        require_columns(spark.range(1), {"frp"})


def test_library_imports_without_the_optional_folder():
    """Nothing outside panelforge/llm names it."""
    from pathlib import Path

    root = Path(__file__).parent.parent / "panelforge"
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "panelforge.llm" in p.read_text()]
    assert not users


def test_block_bootstrap_draws_with_replacement(spark):
    rng = np.random.default_rng(3)
    y = rng.poisson(8, 60).astype(float)
    a, b = y + rng.normal(0, 3, 60), y + rng.normal(0, 3.4, 60)
    df = spark.createDataFrame([(p, *map(float, v)) for p, v in enumerate(zip(y, a, b, strict=True))], "p int, y double, a double, b double")
    deltas = metrics.block_bootstrap(df, "a", "b")
    assert deltas.selectExpr("count(DISTINCT delta)").first()[0] > 1900
    got = metrics.bootstrap_interval(deltas).first()
    i = rng.integers(0, 60, (2000, 60))
    want = (np.abs(y - a)[i].sum(1) - np.abs(y - b)[i].sum(1)) / y[i].sum(1)
    assert got.draws == 2000
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(want, [2.5, 97.5])), abs=0.02)
    assert got.better == pytest.approx((want < 0).mean(), abs=0.05)


def test_whole_names_normalise_past_60_characters(spark, tmp_path):
    from panelforge.plans import registry

    spark.createDataFrame([(1, "a" * 70 + " -Ção_FIM")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["PRJ05_PRJ07_whole_names"](spark, str(tmp_path)).first().name == "a" * 70 + " cao fim"


def test_noise_floor_by_kind_of_noise(spark):
    import math

    from panelforge.operators import metrics

    means = spark.createDataFrame([(i, 4.0) for i in range(30)] + [(30, None)], "p long, mean double")
    given = lambda x: spark.createDataFrame([(x,)], "dispersion double")
    wide = {r.kind: r for r in metrics.noise_floor(means, given(0.5), 500).collect()}
    # mean absolute deviation of a Poisson count of mean 4, over its mean
    exact = 2 * math.exp(-4) * 4**5 / math.factorial(4) / 4
    assert abs(wide["poisson"].mean - exact) < 0.02 and wide["poisson"].draws == 500
    assert wide["negative_binomial"].mean > 1.3 * exact
    for r in wide.values():
        assert r.p2_5 < r.mean < r.p90 < r.p97_5
    same = {r.kind: r.mean for r in metrics.noise_floor(means, given(None), 500).collect()}
    assert abs(same["negative_binomial"] - exact) < 0.02
    assert metrics.noise_floor(means.limit(0), given(0.5), 500).count() == 0


def test_cells_of_one_mean_are_drawn_together(spark):
    from panelforge.operators import metrics

    def totals(alpha, n):
        found = list(metrics._drawn(np.random.default_rng(5), 4.0, alpha, n, 2000))
        return len(found), [sum(part[i] for part in found) for i in (0, 1)]

    for alpha, variance in ((0.0, 4.0), (0.5, 12.0)):
        (_, (e, y)), (_, (e1, _)) = totals(alpha, 1000), totals(alpha, 1)
        assert abs(y.mean() / 1000 - 4) < 0.02 and abs(y.var() / 1000 / variance - 1) < 0.15
        assert abs(e.mean() / 1000 / e1.mean() - 1) < 0.1 and abs(e.var() / 1000 / e1.var() - 1) < 0.3
        parts, (_, y) = totals(alpha, 10**9)  # as much work as for a thousand
        assert parts == 1 and abs(y.mean() / 4e9 - 1) < 1e-4
    cells = spark.range(10**6).select(F.col("id").alias("p"), F.lit(4.0).alias("mean"))
    none = spark.createDataFrame([(None,)], "dispersion double")
    got = {r.kind: r.mean for r in metrics.noise_floor(cells, none, 300).collect()}
    assert all(abs(m - 0.390734) < 1e-4 for m in got.values())  # 2 exp(-4) 4^5 / 4! / 4


def test_columns_are_found_by_words_and_renamed_by_parts(spark):
    from panelforge.operators import intake

    df = spark.createDataFrame([(1, 2.0, 3)], "`Chuva (mm/h)` int, `Pressão-máx.` double, YEAR int")
    row = df.select(intake.holding(df, "pressao max").alias("a"), intake.holding(df, "chuva mm").alias("b"), intake.holding(df, "vento").alias("c")).first()
    assert tuple(row) == (2.0, 1, None)
    assert intake.renamed(df, {"ano": ("ano", "year"), "rain": ("chuva",)}).columns == ["rain", "Pressão-máx.", "ano"]
    twice = spark.createDataFrame([(1, 2, 3)], "year_a int, year_b int, other int")
    assert intake.renamed(twice, {"ano": ("year",)}).columns == ["ano", "year_b", "other"]


def test_station_means_weigh_every_station(spark):
    from panelforge.operators import spatial

    places = spark.createDataFrame([(1, 10, 0.0, 0.0), (1, 11, 0.0, 0.0)], "geo int, p int, lat double, lon double")
    stations = spark.createDataFrame([(1, 10, 0.0, 0.0, 4.0), (2, 10, 0.0, 90.0, 1.0), (3, 10, 0.0, 1.0, None)], "station int, p int, lat double, lon double, v double")
    [row] = spatial.station_means(places, stations).collect()
    far = 1 / (6371.0088 * 3.141592653589793 / 2 + 5) ** 2
    assert row.stations == 2 and abs(row.idw - (4 / 25 + far) / (1 / 25 + far)) < 1e-9


def test_bands_by_hand(spark):
    from panelforge.operators import bands

    rows = spark.createDataFrame([("dry", p, float(y), 0.0) for p, ys in ((1, (1, 2, 3, 4)), (2, (1, 9)), (3, (8, None))) for y in ys if y is not None] + [("dry", 3, None, 0.0)], "regime string, p int, y double, f double")
    counts = bands.residual_counts(rows, "y", "f")
    got = {r.p: (r.width, r.n, r.covered) for r in bands.rolling(counts, [0.4], 2).collect()}
    assert got == {2: (3.0, 2, 1), 3: (4.0, 1, 0)}  # ranks ceil(5 * 0.6) = 3 of 4 and ceil(7 * 0.6) = 5 of 6
    levels = {r.p: (round(r.q, 6), round(r.width, 6), r.covered) for r in bands.adaptive(counts, [0.2], 0.9, 2).collect()}
    assert levels == {2: (0.9, 3.7, 1), 3: (0.98, 8.5, 1)}
    assert bands.rolling(counts.limit(0), [0.1], 1).count() == 0
