"""Append-only forecast logs and scores that arrive later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expressions import share


def new_records(batch: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch's rows that the log lacks, each once."""
    return batch.dropDuplicates(list(keys)).join(log, list(keys), "left_anti")


def scores(log: DataFrame, observed: DataFrame, scored: DataFrame, limit: float) -> DataFrame:
    """Scores of months that are observed and not scored yet, with alerts."""
    due = log.join(scored, "p", "left_anti").join(observed, ["geo", "p"])
    out = due.groupBy("p").agg(F.count(F.lit(1)).alias("n_scored"), share(F.sum(F.abs(F.col("y") - F.col("pred"))), F.when(F.sum("y") != 0, F.sum("y"))).alias("wape"))
    alerts = F.array_join(F.filter(F.array(F.when(F.col("wape") > limit, F.lit("wape"))), lambda x: x.isNotNull()), ";")
    return out.withColumn("alerts", alerts)


#: The champion's measure at release, and by how much a month may exceed it.
REFERENCE_WAPE, WAPE_INCREASE = 0.6430, 0.05


def delayed_scores(log: DataFrame, observed: DataFrame, keys: Sequence[str], absent_is_zero: bool, reference: float = REFERENCE_WAPE, increase: float = WAPE_INCREASE) -> DataFrame:
    """A row for each of keys (p among them) of logged forecasts whose month has any observation.

    Where absence means zero, places without an observation count as 0; else they are missing,
    not scored, and alerted. A month without events has no wape.
    """
    months = observed.select("p").distinct()
    joined = log.join(months, "p", "left_semi").join(observed.select("geo", "p", "y"), ["geo", "p"], "left")
    y = F.coalesce("y", F.lit(0.0)) if absent_is_zero else F.col("y")
    joined = joined.withColumn("y", y)
    miss = F.abs(F.col("y") - F.col("pred"))
    total = F.coalesce(F.sum("y"), F.lit(0.0))
    out = joined.groupBy(*keys).agg(
        F.count("y").alias("n_scored"),
        (F.count(F.lit(1)) - F.count("y")).alias("n_missing"),
        total.alias("observed_total"),
        F.sum(F.when(F.col("y").isNotNull(), F.col("pred"))).alias("predicted_total"),
        F.when(total > 0, F.sum(miss) / total).alias("wape"),
        F.avg(miss).alias("mae"),
    )
    signs = F.array(F.when(F.col("wape") > reference + increase, F.lit("wape above reference")), F.when(F.col("n_missing") > 0, F.concat(F.col("n_missing"), F.lit(" places not observed"))))
    return out.withColumn("alerts", F.array_join(F.array_compact(signs), ";"))


def pending(log: DataFrame, scored: DataFrame) -> DataFrame:
    """Months that have forecasts and no score."""
    return log.select("p").distinct().join(scored, "p", "left_anti")


#: Fixed values of a new training: limits above (coverage: below) which one is due.
WAPE_LIMIT, BRIER_LIMIT, COVERAGE_LIMIT, DRIFT_LIMIT, REGIME_LIMIT = 0.35, 0.15, 0.88, 0.25, 0.70


def retrain(wape: Column | None = None, brier: Column | None = None, coverage: Column | None = None, drift: Column | None = None, regime: Column | None = None) -> Column:
    """Whether any measure asks for a new training; a measure that is NULL or not given doesn't."""
    due = F.lit(False)
    for value, limit in ((wape, WAPE_LIMIT), (brier, BRIER_LIMIT), (drift, DRIFT_LIMIT), (regime, REGIME_LIMIT)):
        if value is not None:
            due = due | F.coalesce(value > limit, F.lit(False))
    return due if coverage is None else due | F.coalesce(coverage < COVERAGE_LIMIT, F.lit(False))
