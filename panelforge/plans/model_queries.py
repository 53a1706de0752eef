"""Queries of models that are fitted by passes: boosting, walk-forward generalised linear models, quantile grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import boosting, regression
from panelforge.plans.more_queries import NAMES, _training
from panelforge.plans.registry import query, tidy
from panelforge.sources.tables import entities

#: 2000-01, from which month on each month has a model of its own.
START = 24001


@query("MDL06_boosted")
def boosted(spark, folder):
    """100 rounds on the years before 2000, forecasts from then on."""
    train, test = _training(spark, folder)
    return tidy(boosting.predicted(test, boosting.fit(train, NAMES, "y", rounds=100)), "geo", "p", "y", "pred")


def _walk(power: float):
    def run(spark, folder):
        train, test = _training(spark, folder)
        rows = train.unionByName(test)
        models = regression.walk_forward(rows, NAMES, "y", "p", START, power)
        return tidy(regression.forecasts(rows, models, NAMES, "p"), "geo", "p", "y", "pred")

    return run


for _id, _power in (("MDL07_walk_forward", 1.0), ("MDL08_walk_forward", 1.5)):
    query(_id)(_walk(_power))


@query("MDL10_quantile_grid")
def quantile_grid(spark, folder):
    """Three quantiles of every region, fitted before 2000."""
    train, test = (part.join(entities(spark, folder).select("geo", "uf"), "geo") for part in _training(spark, folder))
    grid = regression.quantile_grid(train, NAMES, "y", "uf", (0.1, 0.5, 0.9))
    return tidy(regression.quantile_forecasts(test, grid, NAMES, "uf"), "geo", "p", "q", "y", "pred")
