"""Evaluation of forecasts by scope and season, temporal holdouts with calibration years, slices against a baseline, and boosted bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import metrics
from panelforge.operators.quantiles import wide

#: Months of the seasons, what counts as an extreme month, and rows that a regime must have more than.
CRITICAL, DRY, EXTREME, FEW = (10, 11), (8, 9, 10, 11, 12), 30, 10
#: How much a band widens with the chances of the extreme and the high regime, and the widths without a calibration.
BOOST_EXTREME, BOOST_HIGH, WIDTH80, WIDTH95 = 0.3, 0.15, 2.0, 5.0


def seasons() -> dict[str, Column]:
    return {"annual": F.lit(True), "critical": F.col("mes").isin(*CRITICAL), "dry": F.col("mes").isin(*DRY)}


def top_recall(rows: DataFrame, scope: str, k: int) -> DataFrame:
    """scope, season and recall: the share of the entities of the k largest rows that are among those of the k forecast largest.

    Ties go by entity and month. Each task keeps k rows of a group before any are shuffled.
    """
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in seasons().items()]))
    each = rows.select(scope, "geo", "p", "y", "pred", F.explode(names).alias("season"))

    def top(value: str, name: str) -> DataFrame:
        by = Window.partitionBy(scope, "season").orderBy(F.desc(value), "geo", "p")
        return each.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).select(scope, "season", "geo").distinct().withColumn(name, F.lit(1))

    both = top("y", "true").join(top("pred", "found"), [scope, "season", "geo"], "left")
    return both.groupBy(scope, "season").agg((F.count("found") / F.count(F.lit(1))).alias("recall"))


def evaluated(rows: DataFrame, scope: str, k: int = 10) -> DataFrame:
    """A row for each scope, with every measure of every season as a column.

    rows: scope, geo, p, mes, y, pred and, where there are any, p_occurrence, p_extreme, low80,
    high80, low95, high95 and past (events before). A season without rows has NULLs.
    """
    y, pred, there = F.col("y"), F.col("pred"), set(rows.columns)
    out = [F.count(F.lit(1)).alias("n_samples")]
    for name, season in seasons().items():
        a, b = F.when(season, y), F.when(season, pred)
        if_ = lambda c: F.avg(F.when(season, c.cast("double")))  # noqa: B023, E731
        measures = {"wape": metrics.wape(a, b), "mape": F.avg(F.when(a > 0, F.abs(a - b) / a)), "rmse": F.sqrt(F.avg(F.pow(a - b, 2))), "mae": F.avg(F.abs(a - b))}
        measures["r2"] = F.when(F.count(a) > 0, F.when(F.var_pop(a) > 0, 1 - F.avg(F.pow(a - b, 2)) / F.var_pop(a)).otherwise(0.0))
        if "p_occurrence" in there:
            measures["brier_occ"] = if_(F.pow(F.col("p_occurrence") - (y > 0).cast("double"), 2))
        if "p_extreme" in there:
            measures["brier_ext"] = if_(F.pow(F.col("p_extreme") - (y >= EXTREME).cast("double"), 2))
        for w in ("80", "95"):
            if {f"low{w}", f"high{w}"} <= there:
                measures[f"ic{w}"] = if_(y.between(F.col(f"low{w}"), F.col(f"high{w}")))
                measures[f"ic{w}_width"] = if_(F.col(f"high{w}") - F.col(f"low{w}"))
        if "past" in there:
            measures["undue"] = F.when(F.count(a) > 0, F.coalesce(F.avg(F.when(season & (F.col("past") > 0), (pred <= 0).cast("double"))), F.lit(0.0)))
        out += [c.alias(f"{m}_{name}") for m, c in measures.items()]
    recall = top_recall(rows, scope, k).groupBy(scope).agg(*[F.max(F.when(F.col("season") == n, F.col("recall"))).alias(f"recall{k}_{n}") for n in seasons()])
    return rows.groupBy(scope).agg(*out).join(recall, scope)


def in_scopes(rows: DataFrame, scopes: Mapping[str, Sequence | None], column: str) -> DataFrame:
    """rows once for each scope that has their column's value; None has all. Scopes are few."""
    names = F.array_compact(F.array(*[F.lit(n) if some is None else F.when(F.col(column).isin(*some), F.lit(n)) for n, some in scopes.items()]))
    return rows.withColumn("scope", F.explode(names))


def calibrated(residuals: DataFrame) -> DataFrame:
    """scope, q80 and q95 of residuals (scope, mes, e): of the critical months if they have more than FEW rows, else of all, else NULL."""
    regimes = F.array_compact(F.array(F.lit("all"), F.when(F.col("mes").isin(*CRITICAL), "critical")))
    q = wide(residuals.select("scope", "e", F.explode(regimes).alias("regime")), "e", ["scope", "regime"], {"q80": 0.8, "q95": 0.95}).where(F.col("n") > FEW)
    best = F.min_by(F.struct("q80", "q95"), F.when(F.col("regime") == "critical", 0).otherwise(1))
    return q.groupBy("scope").agg(best.alias("b")).select("scope", "b.*")


def boosted_bands(rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """rows (scope, pred, p_high, p_extreme_regime) with low80, high80, low95 and high95, wider with the chances of high regimes."""
    joined = rows.join(F.broadcast(calibration), "scope", "left")  # a row a scope
    boost = 1 + BOOST_EXTREME * F.col("p_extreme_regime") + BOOST_HIGH * F.col("p_high")
    for name, usual in (("80", WIDTH80), ("95", WIDTH95)):
        width = F.coalesce(f"q{name}", F.lit(usual)) * boost
        joined = joined.withColumn(f"low{name}", F.greatest(F.col("pred") - width, F.lit(0.0))).withColumn(f"high{name}", F.col("pred") + width)
    return joined.drop("q80", "q95")


def temporal_holdout(panel: DataFrame, scopes: Mapping[str, Sequence | None], last: int, tested: Sequence[int]) -> DataFrame:
    """evaluated() for each scope of the tested years, with best_baseline_wape.

    panel: geo, uf, p, ano, mes, y. The model is the mean of the same month up to the two
    calibration years, which end at last and give the bands; baselines learn from all years up
    to last: own and regional means of the month, and the value of a year before. No scope's
    rows are fitted apart, as none of these models looks at another entity but the region's,
    whose scope holds the region whole.
    """
    months, region = ["geo", "mes"], ["uf", "mes"]
    mean = lambda rows, keys, name: rows.groupBy(*keys).agg(F.avg("y").alias(name))
    known = panel.where(F.col("ano") <= last)
    early = mean(known.where(F.col("ano") <= last - 2), months, "pred")
    year = panel.select("geo", (F.col("p") + 12).alias("p"), F.col("y").alias("naive"))
    test = panel.where(F.col("ano").isin(*tested))
    past = known.groupBy("geo").agg(F.sum("y").alias("past"))
    joined = test.join(early, months, "left").join(mean(known, months, "own"), months, "left").join(mean(known, region, "regional"), region, "left").join(year, ["geo", "p"], "left").join(past, "geo", "left")
    names = ("own", "regional", "naive")
    rows = in_scopes(joined.na.fill(0.0, ["pred", *names]), scopes, "uf")
    held = in_scopes(known.where(F.col("ano") > last - 2).join(early, months, "left").na.fill(0.0, ["pred"]), scopes, "uf")
    bands = boosted_bands(rows.withColumns({"p_high": F.lit(0.0), "p_extreme_regime": F.lit(0.0)}), calibrated(held.select("scope", "mes", F.abs(F.col("y") - F.col("pred")).alias("e"))))
    base = rows.groupBy("scope").agg(F.least(*[metrics.wape(F.col("y"), F.col(n)) for n in names]).alias("best_baseline_wape"))
    return evaluated(bands, "scope").join(base, "scope")


def slice_table(rows: DataFrame, by: Sequence[str], baseline: str, candidate: str) -> DataFrame:
    """A row for each slice: both measures, the difference of absolute errors, its mean, and how often the candidate wins."""
    y = F.col("y")
    delta = F.abs(y - F.col(candidate)) - F.abs(y - F.col(baseline))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("observed_total"),
        metrics.wape(y, F.col(baseline)).alias("baseline_wape"),
        metrics.wape(y, F.col(candidate)).alias("candidate_wape"),
        F.sum(delta).alias("delta_abs_error"),
        F.avg(delta).alias("mean_delta_abs_error"),
        F.avg((delta < 0).cast("double")).alias("candidate_win_rate"),
    )


def guarded_zonal(zonal: DataFrame, least: float = 0.99) -> DataFrame:
    """zonal (covered); a zone and month that is covered less ends the job."""
    bad = F.raise_error(F.concat(F.lit("coverage below "), F.lit(str(least)), F.lit(": "), F.coalesce(F.col("covered").cast("string"), F.lit("NULL")))).cast("double")
    return zonal.withColumn("covered", F.when(F.col("covered") >= least, F.col("covered")).otherwise(bad))


def calendar_lags(rows: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int] = (1, 2, 3), months: int = 3) -> DataFrame:
    """rows with value_lag<n>, the value n calendar months before, and value_roll<months>, the mean of that many months before if all are there.

    Months go by p, not by rows: a month that is missing gives NULL, and not the one before it.
    """
    at = lambda n: Window.partitionBy(*keys).orderBy("p").rangeBetween(-n, -n)
    before = Window.partitionBy(*keys).orderBy("p").rangeBetween(-months, -1)
    new = {f"{value}_lag{n}": F.max(value).over(at(n)) for n in lags}
    new[f"{value}_roll{months}"] = F.when(F.count(value).over(before) == months, F.avg(value).over(before))
    return rows.withColumns(new)
