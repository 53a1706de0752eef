"""Streams that stop in the middle, and batches that are replayed."""

import pytest
from pyspark.sql import functions as F

from panelforge.operators import bands
from panelforge.streaming import adaptive, jobs, monitor


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_adaptive_stream_that_stops_in_the_middle_equals_the_batch(spark, tmp_path):
    data = [(g, p, round(((p * 7 + i * i) % 11) / 3, 3), 1 + i % 3) for g in ("dry", "wet") for p in range(100, 112) for i in range(6) if (g, p) != ("wet", 105)]
    counts = spark.createDataFrame(data, "regime string, p int, residual double, n long")
    parts = [F.col("p") < 103, F.col("p").between(103, 106), F.col("p").between(107, 107), F.col("p") > 107]
    folder, out = str(tmp_path / "cuts"), str(tmp_path / "out")
    with adaptive.rocks(spark):
        for some in (parts[:2], parts[2:3], [], parts[3:]):
            stream = monitor.in_files(counts, some, folder)
            got = jobs.run_append(adaptive.adaptive(stream, (0.05, 0.4), 0.8, 102), "bands", out)
        assert rows(got) == rows(bands.adaptive(counts, (0.05, 0.4), 0.8, 102).select(*got.columns))
        with pytest.raises(Exception, match="came after cut"):
            jobs.run_append(adaptive.adaptive(monitor.in_files(counts, parts[:1], folder), (0.05, 0.4), 0.8, 102), "bands", out)


@pytest.mark.parametrize("zero", [True, False])
def test_scores_wait_for_observations_and_are_made_once(spark, tmp_path, zero):
    forecasts = spark.createDataFrame([(g, p, "m", float(g)) for g in (1, 2) for p in (10, 11, 12)], "geo int, p int, model string, pred double")
    observed = spark.createDataFrame([(1, 10, 3.0), (1, 11, 0.0), (2, 11, 0.0)], "geo int, p int, y double")
    log = str(tmp_path / "log")
    target = {"target": "t", "sensor": "s", "version": "v"}
    scorer = monitor.Scorer(log, str(tmp_path), forecasts.schema, target, zero, 0.5, 0.05)
    monitor.record(forecasts.where("p < 12"), 0, log)
    monitor.record(forecasts.where("p >= 11").withColumn("pred", F.lit(99.0)), 1, log)
    assert rows(spark.read.parquet(log).select("geo", "p", "pred")) == [(1, 10, 1.0), (1, 11, 1.0), (1, 12, 99.0), (2, 10, 2.0), (2, 11, 2.0), (2, 12, 99.0)]
    monitor.record(forecasts.where("p >= 11").withColumn("pred", F.lit(99.0)), 1, log)  # the same batch again
    assert spark.read.parquet(log).count() == 6
    scorer.score(observed.where("p = 10"), 0)
    first = rows(scorer.scored(spark))
    scorer.score(observed.where("p = 10"), 0)
    assert rows(scorer.scored(spark)) == first
    scorer.score(observed.where("p = 11"), 1)
    got = {r.p: r for r in scorer.scored(spark).collect()}
    assert sorted(got) == [10, 11]
    if zero:
        assert (got[10].n_scored, got[10].n_missing, got[10].wape, got[10].mae, got[10].predicted_total) == (2, 0, 4 / 3, 2.0, 3.0)
        assert got[10].alerts == "wape above reference"
    else:
        assert (got[10].n_scored, got[10].n_missing, got[10].wape, got[10].mae, got[10].predicted_total) == (1, 1, 2 / 3, 2.0, 1.0)
        assert got[10].alerts == "wape above reference;1 places not observed"
    assert (got[11].observed_total, got[11].wape, got[11].mae, got[11].alerts) == (0.0, None, 1.5, "")
    # what is logged later is not taken up by a replayed batch, but by the next one
    monitor.record(spark.createDataFrame([(1, 10, "late", 3.0)], forecasts.schema), 2, log)
    scorer.score(observed.where("p = 11"), 1)
    assert scorer.scored(spark).count() == 2
    scorer.score(observed.limit(0), 2)
    assert scorer.scored(spark).where("model = 'late'").count() == 1
