"""Queries of evaluation by scope, temporal holdouts, slices, boosted bands, zonal features and whole name keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import names
from panelforge.operators import evaluation, spatial
from panelforge.plans.common_sql import CHAMPION, ENTITIES, PANEL
from panelforge.plans.panel_queries import dense, forecasts
from panelforge.plans.registry import query, tidy
from panelforge.sources.tables import entities, table

_SEASONS = {"annual": "true", "critical": "mes IN (10, 11)", "dry": "mes IN (8, 9, 10, 11, 12)"}


def _measures(bands: tuple[str, ...], chances: bool, past: str | None) -> str:
    """SQL of evaluated() over rows r (scope, geo, p, mes, y, pred, ...), without recall."""
    out = ["count(*) AS n_samples"]
    for name, when in _SEASONS.items():
        f = f"FILTER ({when})"
        cols = {
            "wape": f"sum(abs(y - pred)) {f} / nullif(sum(abs(y)) {f}, 0)",
            "mape": f"avg(abs(y - pred) / y) FILTER ({when} AND y > 0)",
            "rmse": f"sqrt(avg(pow(y - pred, 2)) {f})",
            "mae": f"avg(abs(y - pred)) {f}",
            "r2": f"CASE WHEN count(y) {f} > 0 THEN CASE WHEN var_pop(y) {f} > 0 THEN 1 - avg(pow(y - pred, 2)) {f} / var_pop(y) {f} ELSE 0.0 END END",
        }
        if chances:
            cols["brier_occ"] = f"avg(pow(p_occurrence - CASE WHEN y > 0 THEN 1 ELSE 0 END, 2)) {f}"
            cols["brier_ext"] = f"avg(pow(p_extreme - CASE WHEN y >= 30 THEN 1 ELSE 0 END, 2)) {f}"
        for w in bands:
            cols[f"ic{w}"] = f"avg(CASE WHEN y BETWEEN low{w} AND high{w} THEN 1.0 ELSE 0.0 END) {f}"
            cols[f"ic{w}_width"] = f"avg(high{w} - low{w}) {f}"
        if past:
            cols["undue"] = f"CASE WHEN count(y) {f} > 0 THEN coalesce(avg(CASE WHEN pred <= 0 THEN 1.0 ELSE 0.0 END) FILTER ({when} AND {past} > 0), 0.0) END"
        out += [f"round({c}, 6) AS {m}_{name}" for m, c in cols.items()]
    return ", ".join(out)


_EACH = " UNION ALL ".join(f"SELECT scope, geo, p, y, pred, '{n}' AS season FROM r WHERE {w}" for n, w in _SEASONS.items())
_RECALL = f"""each AS ({_EACH}), ty AS (SELECT DISTINCT scope, season, geo FROM (SELECT *, row_number() OVER (PARTITION BY scope, season ORDER BY y DESC, geo, p) AS k FROM each) WHERE k <= 10),
 tp AS (SELECT DISTINCT scope, season, geo FROM (SELECT *, row_number() OVER (PARTITION BY scope, season ORDER BY pred DESC, geo, p) AS k FROM each) WHERE k <= 10),
 rec AS (SELECT ty.scope, {', '.join(f"round(max(x) FILTER (season = '{n}'), 6) AS recall10_{n}" for n in _SEASONS)} FROM (SELECT ty.scope, ty.season, count(tp.geo) / count(*) AS x FROM ty LEFT JOIN tp ON ty.scope = tp.scope AND ty.season = tp.season AND ty.geo = tp.geo GROUP BY ty.scope, ty.season) ty GROUP BY ty.scope)"""
_RECALLS = ", ".join(f"recall10_{n}" for n in _SEASONS)


@query("MET11_scope_evaluation", f"""WITH {CHAMPION}, {ENTITIES}, r AS (SELECT CAST(uf AS VARCHAR) AS scope, champ.geo, p, mes, y, round(champion, 9) AS pred, 1 - exp(-champion) AS p_occurrence, least(champion / 30, 1) AS p_extreme, greatest(champion - 3, 0) AS low80, champion + 3 AS high80, greatest(champion - 6, 0) AS low95, champion + 6 AS high95, clim AS past
 FROM champ JOIN ent ON ent.geo = champ.geo WHERE ano >= 2000), {_RECALL}, m AS (SELECT scope, {_measures(('80', '95'), True, 'past')} FROM r GROUP BY scope) SELECT m.*, {_RECALLS} FROM m JOIN rec ON m.scope = rec.scope""")
def scope_evaluation(spark, folder):
    """Every measure of every season for each region."""
    rows = forecasts(spark, folder).where("ano >= 2000").join(entities(spark, folder).select("geo", "uf"), "geo")
    c, low, high = F.col("champion"), (lambda w: F.greatest(F.col("champion") - w, F.lit(0.0))), (lambda w: F.col("champion") + w)
    rows = rows.select(F.col("uf").cast("string").alias("scope"), "geo", "p", "mes", "y", F.round(c, 9).alias("pred"), (1 - F.exp(-c)).alias("p_occurrence"), F.least(c / 30, F.lit(1.0)).alias("p_extreme"), low(3).alias("low80"), high(3).alias("high80"), low(6).alias("low95"), high(6).alias("high95"), F.col("clim").alias("past"))
    out = evaluation.evaluated(rows, "scope")
    return tidy(out, *out.columns)


_SCOPES = {"all": None, "first": (0, 1), "second": (2,)}
_IN = " UNION ALL ".join(f"SELECT *, '{n}' AS scope FROM {{0}}" + (f" WHERE uf IN ({', '.join(map(str, some))})" if some else "") for n, some in _SCOPES.items())


@query("ADD01_scope_holdout", f"""WITH {PANEL}, {ENTITIES}, pan AS (SELECT panel.*, uf FROM panel JOIN ent ON ent.geo = panel.geo), known AS (SELECT * FROM pan WHERE ano <= 1999), early AS (SELECT geo, mes, avg(y) AS m FROM known WHERE ano <= 1997 GROUP BY geo, mes),
 own AS (SELECT geo, mes, avg(y) AS m FROM known GROUP BY geo, mes), reg AS (SELECT uf, mes, avg(y) AS m FROM known GROUP BY uf, mes), past AS (SELECT geo, sum(y) AS past FROM known GROUP BY geo),
 t AS (SELECT pan.*, coalesce(early.m, 0) AS pred, coalesce(own.m, 0) AS own, coalesce(reg.m, 0) AS regional, coalesce(b.y, 0) AS naive, past.past FROM pan LEFT JOIN early ON early.geo = pan.geo AND early.mes = pan.mes LEFT JOIN own ON own.geo = pan.geo AND own.mes = pan.mes
  LEFT JOIN reg ON reg.uf = pan.uf AND reg.mes = pan.mes LEFT JOIN pan b ON b.geo = pan.geo AND b.p = pan.p - 12 LEFT JOIN past ON past.geo = pan.geo WHERE pan.ano IN (2000, 2001)),
 c AS (SELECT known.uf, known.mes, abs(y - coalesce(early.m, 0)) AS e FROM known LEFT JOIN early ON early.geo = known.geo AND early.mes = known.mes WHERE ano > 1997), cs AS ({_IN.format('c')}), ts AS ({_IN.format('t')}),
 q AS (SELECT scope, CASE WHEN count(*) FILTER (mes IN (10, 11)) > 10 THEN quantile_cont(e, 0.8) FILTER (mes IN (10, 11)) WHEN count(*) > 10 THEN quantile_cont(e, 0.8) ELSE 2.0 END AS q80,
  CASE WHEN count(*) FILTER (mes IN (10, 11)) > 10 THEN quantile_cont(e, 0.95) FILTER (mes IN (10, 11)) WHEN count(*) > 10 THEN quantile_cont(e, 0.95) ELSE 5.0 END AS q95 FROM cs GROUP BY scope),
 r AS (SELECT ts.*, greatest(pred - coalesce(q80, 2.0), 0) AS low80, pred + coalesce(q80, 2.0) AS high80, greatest(pred - coalesce(q95, 5.0), 0) AS low95, pred + coalesce(q95, 5.0) AS high95 FROM ts LEFT JOIN q ON q.scope = ts.scope),
 base AS (SELECT scope, round(least({', '.join(f'sum(abs(y - {n})) / nullif(sum(abs(y)), 0)' for n in ('own', 'regional', 'naive'))}), 6) AS best_baseline_wape FROM r GROUP BY scope),
 {_RECALL}, m AS (SELECT scope, {_measures(('80', '95'), False, 'past')} FROM r GROUP BY scope) SELECT m.*, {_RECALLS}, best_baseline_wape FROM m JOIN rec ON m.scope = rec.scope JOIN base ON base.scope = m.scope""")
def scope_holdout(spark, folder):
    """Trained to 1997, calibrated on 1998 and 1999, tested on 2000 and 2001, for all regions and two groups of them."""
    panel = dense(spark, folder).join(entities(spark, folder).select("geo", "uf"), "geo")
    out = evaluation.temporal_holdout(panel, _SCOPES, 1999, (2000, 2001))
    return tidy(out, *out.columns)


_BAND = "CASE WHEN y = 0 THEN 'zero' WHEN y <= 2 THEN '1-2' WHEN y <= 10 THEN '3-10' ELSE '>10' END"


@query("MET28_slice_table", f"WITH {CHAMPION}, {ENTITIES}, s AS (SELECT uf, {_BAND} AS band, y, naive, champion FROM champ JOIN ent ON ent.geo = champ.geo) SELECT uf, band, count(*) AS n, sum(y) AS observed_total, round(sum(abs(y - naive)) / nullif(sum(abs(y)), 0), 6) AS baseline_wape, round(sum(abs(y - champion)) / nullif(sum(abs(y)), 0), 6) AS candidate_wape, round(sum(abs(y - champion) - abs(y - naive)), 6) AS delta_abs_error, round(avg(abs(y - champion) - abs(y - naive)), 6) AS mean_delta_abs_error, round(avg(CASE WHEN abs(y - champion) < abs(y - naive) THEN 1.0 ELSE 0.0 END), 6) AS candidate_win_rate FROM s GROUP BY uf, band")
def slice_table(spark, folder):
    rows = forecasts(spark, folder).join(entities(spark, folder).select("geo", "uf"), "geo").withColumn("band", F.expr(_BAND))
    out = evaluation.slice_table(rows, ["uf", "band"], "naive", "champion")
    return tidy(out, *out.columns)


@query("UNC06_boosted_bands", f"""WITH {CHAMPION}, c AS (SELECT mes, abs(y - champion) AS e FROM champ WHERE ano IN (1998, 1999)),
 q AS (SELECT CASE WHEN count(*) FILTER (mes IN (10, 11)) > 10 THEN quantile_cont(e, 0.8) FILTER (mes IN (10, 11)) WHEN count(*) > 10 THEN quantile_cont(e, 0.8) ELSE 2.0 END AS q80,
  CASE WHEN count(*) FILTER (mes IN (10, 11)) > 10 THEN quantile_cont(e, 0.95) FILTER (mes IN (10, 11)) WHEN count(*) > 10 THEN quantile_cont(e, 0.95) ELSE 5.0 END AS q95 FROM c),
 b AS (SELECT geo, p, champion AS pred, 1 + 0.3 * least(champion / 30, 1) + 0.15 * least(champion / 10, 1) AS boost FROM champ WHERE ano >= 2000)
 SELECT geo, p, round(pred, 6) AS pred, round(greatest(pred - q80 * boost, 0), 6) AS low80, round(pred + q80 * boost, 6) AS high80, round(greatest(pred - q95 * boost, 0), 6) AS low95, round(pred + q95 * boost, 6) AS high95 FROM b, q""")
def boosted_bands(spark, folder):
    """Bands from the residuals of two calibration years, wider where a high regime is likely."""
    rows = forecasts(spark, folder).withColumn("scope", F.lit("all"))
    past = rows.where("ano IN (1998, 1999)").select("scope", "mes", F.abs(F.col("y") - F.col("champion")).alias("e"))
    chance = lambda size: F.least(F.col("champion") / size, F.lit(1.0))
    asked = rows.where("ano >= 2000").select("scope", "geo", "p", F.col("champion").alias("pred"), chance(30).alias("p_extreme_regime"), chance(10).alias("p_high"))
    return tidy(evaluation.boosted_bands(asked, evaluation.calibrated(past)), "geo", "p", "pred", "low80", "high80", "low95", "high95")


@query("ADD16_ADD17_zonal_features", f"""WITH {PANEL}, b AS (SELECT geo AS cell, geo % 7 AS zone, 1.0 / count(*) OVER (PARTITION BY geo % 7) AS weight FROM (SELECT DISTINCT geo FROM obs)),
 z AS (SELECT zone, p, round(sum(y * weight), 6) AS rain FROM b JOIN panel ON panel.geo = cell WHERE (zone + p) % 11 <> 0 GROUP BY zone, p)
 SELECT zone, p, rain, max(rain) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS rain_lag1, max(rain) OVER (w RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS rain_lag2, max(rain) OVER (w RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS rain_lag3,
  round(CASE WHEN count(rain) OVER (w RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN avg(rain) OVER (w RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) END, 6) AS rain_roll3 FROM z WINDOW w AS (PARTITION BY zone ORDER BY p)""")
def zonal_features(spark, folder):
    """Zonal means with their coverage guarded, some months missing, and features of calendar months before."""
    panel = dense(spark, folder)
    cells = panel.select(F.col("geo").alias("cell")).distinct().withColumn("zone", F.col("cell") % 7)
    bridge = cells.join(cells.groupBy("zone").agg((1 / F.count(F.lit(1))).alias("weight")), "zone")
    zonal = spatial.zonal(bridge, panel.select(F.col("geo").alias("cell"), "p", F.col("y").alias("v"))).where((F.col("zone") + F.col("p")) % 11 != 0)
    guarded = evaluation.guarded_zonal(zonal).where("covered IS NOT NULL").select("zone", "p", F.round("value", 6).alias("rain"))
    out = evaluation.calendar_lags(guarded, ["zone"], "rain")
    return tidy(out, *out.columns)


@query("PRJ05_PRJ06_name_keys", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'vila velha' ELSE CASE c_custkey % 3 WHEN 1 THEN 'sao joao dagua ' ELSE 'office 1⁄2 ' END || c_custkey END AS a, CASE c_custkey % 3 WHEN 0 THEN 'evora' WHEN 1 THEN 'sao joao d agua ' || c_custkey || ' ce' ELSE 'office 12 ' || c_custkey END AS b FROM customer")
def name_keys(spark, folder):
    """Both keys of names with marks, ligatures, fractions, apostrophes, regions' suffixes and an alias."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.lit("ÉVORA - PI")).when(k % 3 == 1, F.concat(F.lit("São_João  d'Água "), k, F.lit("-CE"))).otherwise(F.concat(F.lit("Oﬃce ½ "), k))
    rows = table(spark, folder, "customer").select(k.alias("k"), name.alias("n"))
    return rows.select("k", names.name_key(F.col("n"), ("ce", "pe", "pi"), {"evora": "vila velha"}).alias("a"), names.ascii_key(F.regexp_replace("n", "-CE$", " CE."), ("ce", "pi")).alias("b"))
