"""Queries of panels, features and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.expressions import clip
from panelforge.operators import features, models, panel
from panelforge.plans.common_sql import CHAMPION, CLIMATE, ENTITIES, EVENTS, GAPPED, OBSERVED, PANEL
from panelforge.plans.registry import query, tidy
from panelforge.sources.tables import entities, point_events, stored, table

MIN_HISTORY, WEIGHTS = 36, (0.0, 0.25, 0.5)


def observed(spark, folder):
    """Counts by entity and month, stored: panels read them several times, and events are scanned once."""
    return stored(panel.counts(point_events(spark, folder)), "months")


def dense(spark, folder):
    o = observed(spark, folder)
    return panel.zero_filled(o, panel.common_window(o))


def gapped(spark, folder):
    o = observed(spark, folder)
    return panel.reindexed(o, panel.common_window(o))


def forecasts(spark, folder):
    base = dense(spark, folder)
    both = models.champion(base.withColumn("naive", F.coalesce(F.lag("y", 12).over(features.ordered("geo")), F.lit(0.0))), MIN_HISTORY)
    return both.withColumn("occ", F.lit(None).cast("double"))


@query("AGG01_AGG03_monthly", f"WITH {EVENTS} SELECT geo, ano, mes, CAST(count(*) AS DOUBLE) AS y, round(sum(frp), 6) AS frp_sum, round(avg(frp), 6) AS frp_mean, max(frp) AS frp_max, round(quantile_cont(frp, 0.9), 6) AS frp_p90, round(coalesce(stddev_samp(frp), 0.0), 6) AS frp_std, round(avg(risk), 6) AS risk_mean, count(DISTINCT sensor) AS n_sensors, count(DISTINCT CAST(t AS DATE)) AS n_days, string_agg(DISTINCT sensor, ';' ORDER BY sensor) AS sensors FROM ev GROUP BY geo, ano, mes")
def monthly(spark, folder):
    return tidy(panel.monthly(point_events(spark, folder)), "geo", "ano", "mes", "y", "frp_sum", "frp_mean", "frp_max", "frp_p90", "frp_std", "risk_mean", "n_sensors", "n_days", "sensors")


@query("AGG06_AGG07_sensors", f"WITH {EVENTS}, s AS (SELECT geo, p, sensor, count(*) AS n, sum(frp) AS f, avg(risk) AS r FROM ev GROUP BY ALL) SELECT geo, p, CAST(sum(n) AS BIGINT) AS n, round(sum(f), 6) AS frp_sum, round(sum(r * n) / sum(n), 6) AS risk_mean, string_agg(sensor, ';' ORDER BY sensor) AS sensors FROM s GROUP BY geo, p")
def sensors(spark, folder):
    by = point_events(spark, folder).groupBy("geo", "p", "sensor").agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("f"), F.avg("risk").alias("r"))
    out = by.groupBy("geo", "p").agg(F.sum("n").alias("n"), F.sum("f").alias("frp_sum"), F.try_divide(F.sum(F.col("r") * F.col("n")), F.sum("n")).alias("risk_mean"), F.array_join(F.array_sort(F.collect_set("sensor")), ";").alias("sensors"))
    return tidy(out, "geo", "p", "n", "frp_sum", "risk_mean", "sensors")


@query("PAN04_zero_fill", f"WITH {PANEL} SELECT geo, p, ano, mes, y, assumed_zero FROM panel")
def zero_fill(spark, folder):
    return dense(spark, folder).select("geo", "p", "ano", "mes", "y", "assumed_zero")


@query("PAN02_PAN03_coverage", f"WITH {OBSERVED}, cap AS (SELECT max(p) - 3 AS cap FROM obs) SELECT geo, min(p) AS lo, CAST(least(max(p), min(cap)) AS INT) AS hi, sum(y) AS total, min(p) <= least(max(p), min(cap)) AS valid FROM obs, cap GROUP BY geo")
def coverage(spark, folder):
    o = observed(spark, folder)
    cap = o.agg((F.max("p") - 3).alias("cap"))
    return panel.coverage(o).crossJoin(cap).select("geo", "lo", F.least("hi", "cap").alias("hi"), "total", (F.col("lo") <= F.least("hi", "cap")).alias("valid"))


@query("PAN05_WIN18_reindex", f"WITH {GAPPED} SELECT geo, count(*) AS months, count(y) AS present, count(*) - count(y) AS missing, sum(y) AS total FROM panel GROUP BY geo")
def reindex(spark, folder):
    return gapped(spark, folder).groupBy("geo").agg(F.count(F.lit(1)).alias("months"), F.count("y").alias("present"), (F.count(F.lit(1)) - F.count("y")).alias("missing"), F.sum("y").alias("total"))


_QUIET = "CASE WHEN ano = 1998 AND mes >= 8 AND geo % 2 = 0 THEN 0.0 ELSE y END"


@query("PAN06_WIN17_gaps", f"WITH {PANEL}, q AS (SELECT geo, p, ano, mes, {_QUIET} AS y FROM panel), s AS (SELECT geo, ano, sum(y) AS s FROM q WHERE mes BETWEEN 8 AND 12 GROUP BY geo, ano), a AS (SELECT geo, ano, s, max(s) OVER (PARTITION BY geo ORDER BY ano RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b, max(s) OVER (PARTITION BY geo ORDER BY ano RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS f FROM s), bad AS (SELECT geo, ano FROM a WHERE s = 0 AND b > 0 AND f > 0) SELECT q.geo, q.p, CASE WHEN bad.geo IS NULL OR q.mes < 8 THEN q.y END AS y, bad.geo IS NOT NULL AND q.mes >= 8 AS suspect_gap FROM q LEFT JOIN bad ON q.geo = bad.geo AND q.ano = bad.ano")
def gaps(spark, folder):
    quiet = dense(spark, folder).withColumn("y", F.expr(_QUIET))
    return panel.gaps_quarantined(quiet).select("geo", "p", "y", "suspect_gap")


_SECOND = "second AS (SELECT o_custkey % 10 AS geo, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS p, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2)"


def second_source(spark, folder):
    t = table(spark, folder, "orders")
    return t.groupBy((F.col("o_custkey") % 10).alias("geo"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("y"))


@query("JON09_merge_sources", f"WITH {OBSERVED}, {_SECOND}, u AS (SELECT geo, p, y, 'first' AS source FROM obs UNION ALL SELECT geo, p, y, 'second' FROM second) SELECT geo, p, y, source FROM u QUALIFY row_number() OVER (PARTITION BY geo, p ORDER BY CASE WHEN (source = 'first') = (p <= 23980) THEN 0 ELSE 1 END, source) = 1")
def merged(spark, folder):
    return panel.preferred(observed(spark, folder), second_source(spark, folder), 23980).select("geo", "p", "y", "source")


@query("JON07_overlap", f"WITH {OBSERVED}, {_SECOND} SELECT a.geo, count(*) AS months, round(avg(CASE WHEN a.y = b.y THEN 1.0 ELSE 0.0 END), 6) AS match_share, sum(a.y) AS total_a, sum(b.y) AS total_b, round(CASE WHEN stddev_pop(a.y) > 0 AND stddev_pop(b.y) > 0 THEN corr(a.y, b.y) END, 6) AS corr FROM obs a JOIN second b ON a.geo = b.geo AND a.p = b.p GROUP BY a.geo")
def overlap(spark, folder):
    return tidy(panel.overlap(observed(spark, folder), second_source(spark, folder)), "geo", "months", "match_share", "total_a", "total_b", "corr")


@query("AGG09_longest_run", f"WITH {PANEL}, f AS (SELECT geo, ano, p, CASE WHEN y <= 6 THEN 1 ELSE 0 END AS d FROM panel), i AS (SELECT *, row_number() OVER (PARTITION BY geo, ano ORDER BY p) - sum(d) OVER (PARTITION BY geo, ano ORDER BY p) AS g FROM f), r AS (SELECT geo, ano, g, sum(d) AS n FROM i GROUP BY ALL) SELECT geo, ano, CAST(max(n) AS BIGINT) AS longest, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY geo, ano")
def longest_run(spark, folder):
    return panel.longest_run(dense(spark, folder).withColumn("dry", F.col("y") <= 6), ["geo", "ano"], "p", "dry")


@query("WIN01_WIN15_lags", f"WITH {PANEL} SELECT geo, p, y, lag(y, 1) OVER w AS lag1, lag(y, 2) OVER w AS lag2, lag(y, 3) OVER w AS lag3, lag(y, 6) OVER w AS lag6, lag(y, 12) OVER w AS lag12, lag(y, 3) OVER w - lag(y, 1) OVER w AS drop3 FROM panel WINDOW w AS (PARTITION BY geo ORDER BY p)")
def lags(spark, folder):
    return features.lags(dense(spark, folder)).select("geo", "p", "y", "lag1", "lag2", "lag3", "lag6", "lag12", "drop3")


_W = "OVER (PARTITION BY geo ORDER BY p ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"


def _full(how: str, n: int, name: str) -> str:
    return f"round(CASE WHEN count(y) {_W.format(n)} >= {n} THEN {how}(y) {_W.format(n)} END, 6) AS {name}"


@query("WIN02_WIN06_rolling", f"WITH {GAPPED} SELECT geo, p, {_full('avg', 3, 'roll3_full')}, {_full('avg', 6, 'roll6_full')}, {', '.join(f'round(avg(y) {_W.format(n)}, 6) AS roll{n}' for n in (3, 6, 12))}, {_full('sum', 3, 'sum3')}, {_full('sum', 6, 'sum6')}, round(avg(y) OVER (PARTITION BY geo ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS roll3_now, round(avg(coalesce(y, 0.0)) {_W.format(12)}, 6) AS roll12_zero FROM panel")
def rolling(spark, folder):
    return tidy(features.rolling(gapped(spark, folder)), "geo", "p", "roll3_full", "roll6_full", "roll3", "roll6", "roll12", "sum3", "sum6", "roll3_now", "roll12_zero")


_H = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("WIN07_WIN11_cumulative", f"WITH {GAPPED} SELECT geo, p, coalesce(sum(y) OVER (PARTITION BY geo, ano ORDER BY mes {_H}), 0.0) AS ytd, coalesce(sum(coalesce(y, 0.0)) OVER (PARTITION BY geo ORDER BY p {_H}), 0.0) AS prior, lag(y) OVER (PARTITION BY geo, mes ORDER BY ano) AS same_month_before, round(CASE WHEN count(y) OVER (PARTITION BY geo, mes ORDER BY ano {_H}) >= 2 THEN avg(y) OVER (PARTITION BY geo, mes ORDER BY ano {_H}) END, 6) AS month_mean, max(CAST(y > 0 AS INT)) OVER (PARTITION BY geo) AS ever FROM panel")
def cumulative(spark, folder):
    return tidy(features.cumulative(gapped(spark, folder)), "geo", "p", "ytd", "prior", "same_month_before", "month_mean", "ever")


@query("PRJ15_PRJ18_calendar", f"WITH {PANEL} SELECT geo, p, round(sin(2 * 3.141592653589793 * mes / 12), 6) AS mes_sin, round(cos(2 * 3.141592653589793 * mes / 12), 6) AS mes_cos, mes BETWEEN 8 AND 12 AS is_dry, mes IN (10, 11) AS is_critical, ano - (SELECT min(ano) FROM panel) AS trend, CAST(y > 0 AS INT) AS occurrence, format('{{}}-{{:02d}}', ano, mes) AS label FROM panel")
def calendar(spark, folder):
    return tidy(features.calendar(dense(spark, folder)), "geo", "p", "mes_sin", "mes_cos", "is_dry", "is_critical", "trend", "occurrence", "label")


@query("WIN12_WIN16_anomalies", f"WITH {GAPPED} SELECT geo, p, round(y - avg(y) OVER (PARTITION BY mes), 6) AS anomaly, round(coalesce(y, avg(y) OVER (PARTITION BY mes)), 6) AS filled, y - lag(y) OVER (PARTITION BY geo ORDER BY p) AS diff1, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY geo ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(y IGNORE NULLS) OVER (PARTITION BY geo ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS carried FROM panel")
def anomalies(spark, folder):
    return tidy(features.anomalies(gapped(spark, folder)), "geo", "p", "anomaly", "filled", "diff1", "carried")


@query("WIN19_WIN22_within_cut", f"WITH {GAPPED} SELECT geo, p, round(coalesce(CASE WHEN y IS NOT NULL THEN (rank() OVER (PARTITION BY p ORDER BY y NULLS LAST) + (count(*) OVER (PARTITION BY p, y) - 1) / 2) / count(y) OVER (PARTITION BY p) END, 0.5), 6) AS rank_share, round(coalesce(least(greatest((y - avg(y) OVER c) / nullif(stddev_pop(y) OVER c, 0), CASE WHEN y IS NULL THEN NULL ELSE -4.0 END), 4.0), 0.0) * CASE WHEN y IS NULL OR stddev_pop(y) OVER c = 0 THEN 0.0 ELSE 1.0 END, 6) AS z, round(coalesce(y, avg(y) OVER c, 0.0), 6) AS neutral, round(CASE WHEN sum(y) OVER c > 1e-12 THEN y / sum(y) OVER c ELSE 1 / count(*) OVER c END, 6) AS share FROM panel WINDOW c AS (PARTITION BY p)")
def within_cut(spark, folder):
    return tidy(features.within_cut(gapped(spark, folder)), "geo", "p", "rank_share", "z", "neutral", "share")


@query("WIN23_quantile_buckets", f"WITH {OBSERVED}, t AS (SELECT geo, sum(y) AS total FROM obs GROUP BY geo), r AS (SELECT *, row_number() OVER (ORDER BY total, geo) AS r, count(*) OVER () AS n FROM t) SELECT geo, total, CAST((r > 1 + (n - 1) * 1 / 4)::INT + (r > 1 + (n - 1) * 2 / 4)::INT + (r > 1 + (n - 1) * 3 / 4)::INT AS INT) AS bucket FROM r")
def buckets(spark, folder):
    totals = observed(spark, folder).groupBy("geo").agg(F.sum("y").alias("total"))
    return features.quantile_buckets(totals, "total", 4).select("geo", "total", "bucket")


@query("JON10_asof_year", f"WITH {PANEL}, yr AS (SELECT o_custkey % 10 AS geo, CAST(year(o_orderdate) AS INT) AS ano, round(sum(o_totalprice), 2) AS v FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY 1, 2) SELECT a.geo, a.ano, a.mes, (SELECT max_by(b.v, b.ano) FROM yr b WHERE b.geo = a.geo AND b.ano <= a.ano - 1) AS asof FROM panel a")
def asof_year(spark, folder):
    t = table(spark, folder, "orders").where(F.year("o_orderdate") % 2 == 1)
    yearly = t.groupBy((F.col("o_custkey") % 10).alias("geo"), F.year("o_orderdate").alias("ano")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return features.asof_year(dense(spark, folder), yearly, "v")


_FS = "sum(y) OVER (PARTITION BY geo ORDER BY p ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@query("PAN11_feature_store", f"WITH {PANEL}, {ENTITIES} SELECT a.geo, p, uf, y, lag(y, 1) OVER w AS lag1, lag(y, 12) OVER w AS lag12, round(avg(y) OVER (PARTITION BY a.geo ORDER BY p ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS roll3, coalesce(sum(y) OVER (PARTITION BY a.geo, ano ORDER BY mes {_H}), 0.0) AS ytd, mes BETWEEN 8 AND 12 AS is_dry, area FROM panel a LEFT JOIN ent ON a.geo = ent.geo WINDOW w AS (PARTITION BY a.geo ORDER BY p)")
def feature_store(spark, folder):
    out = features.calendar(features.cumulative(features.rolling(features.lags(dense(spark, folder)))))
    return tidy(out.join(entities(spark, folder), "geo", "left"), "geo", "p", "uf", "y", "lag1", "lag12", "roll3", "ytd", "is_dry", "area")


@query("MDL12_champion", f"WITH {CHAMPION} SELECT geo, p, y, round(clim, 6) AS clim, round(ratio, 6) AS ratio, round(champion, 6) AS champion FROM champ")
def champion(spark, folder):
    return tidy(models.champion(dense(spark, folder), MIN_HISTORY), "geo", "p", "y", "clim", "ratio", "champion")


@query("AGG18_MDL13_ratio", f"WITH {CHAMPION} SELECT p, round(ratio, 6) AS ratio FROM ratio")
def ratio(spark, folder):
    return tidy(models.regional_ratio(models.climatology(dense(spark, folder))), "p", "ratio")


@query("AGG15_MDL13_climatology", f"WITH {PANEL} SELECT geo, mes, round(avg(y), 6) AS mean, count(y) AS n, sum(y) AS total FROM panel GROUP BY geo, mes")
def climatology_table(spark, folder):
    return tidy(dense(spark, folder).groupBy("geo", "mes").agg(F.avg("y").alias("mean"), F.count("y").alias("n"), F.sum("y").alias("total")), "geo", "mes", "mean", "n", "total")


@query("MDL02_MDL05_baselines", f"WITH {PANEL}, {CLIMATE}, {ENTITIES}, c AS (SELECT clim.*, uf FROM clim JOIN ent ON clim.geo = ent.geo), g AS (SELECT uf, mes, ano, sum(y) AS s, count(y) AS n FROM c GROUP BY ALL), r AS (SELECT uf, mes, ano, coalesce(sum(s) OVER w / sum(n) OVER w, 0.0) AS regional FROM g WINDOW w AS (PARTITION BY uf, mes ORDER BY ano {_H})) SELECT c.geo, c.p, c.naive, round(c.clim, 6) AS clim, round(r.regional, 6) AS regional, round(coalesce(avg(y) OVER (PARTITION BY c.geo, c.mes ORDER BY c.ano RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.0), 6) AS recent FROM c JOIN r ON c.uf = r.uf AND c.mes = r.mes AND c.ano = r.ano")
def baselines(spark, folder):
    base = dense(spark, folder).join(entities(spark, folder), "geo")
    return tidy(models.baselines(base), "geo", "p", "naive", "clim", "regional", "recent")


@query("MDL15_AGG17_quantile", f"WITH {PANEL} SELECT a.geo, a.p, round(coalesce((SELECT quantile_cont(b.y, 0.65) FROM panel b WHERE b.geo = a.geo AND b.mes = a.mes AND b.ano < a.ano), 0.0), 6) AS upper_clim FROM panel a")
def quantile(spark, folder):
    return tidy(models.quantile_climatology(dense(spark, folder), 0.65), "geo", "p", "upper_clim")


@query("MDL23_hurdle", f"WITH {CHAMPION} SELECT geo, p, round(occ, 6) AS occurrence, round(CASE WHEN occ >= 0.9 THEN clim ELSE 0.0 END, 6) AS hurdle FROM champ")
def hurdle(spark, folder):
    past = models.history("geo", "mes", order="ano")
    base = dense(spark, folder).withColumn("occurrence", F.coalesce(F.avg((F.col("y") > 0).cast("double")).over(past), F.lit(0.0)))
    out = models.champion(base, MIN_HISTORY)
    return tidy(out, "geo", "p", "occurrence", hurdle=models.hurdle(out, "clim", 0.9))


@query("MDL21_MDL22_blend", f"WITH {CHAMPION} SELECT weight, geo, p, round(weight * naive + (1 - weight) * champion, 6) AS blend FROM champ, (VALUES (0.0::DOUBLE), (0.25), (0.5)) g(weight)")
def blend(spark, folder):
    return tidy(models.blended(forecasts(spark, folder), "naive", "champion", WEIGHTS), "weight", "geo", "p", "blend")


@query("MDL25_JON21_allocate", f"WITH {CHAMPION}, s AS (SELECT *, sum(champion) OVER c AS total, CASE WHEN sum(champion) OVER c > 1e-12 THEN champion / sum(champion) OVER c ELSE 1 / count(*) OVER c END AS bs, CASE WHEN sum(naive) OVER c > 1e-12 THEN naive / sum(naive) OVER c ELSE 1 / count(*) OVER c END AS ss FROM champ WINDOW c AS (PARTITION BY p)) SELECT weight, geo, p, round(total * ((1 - weight) * bs + weight * ss), 6) AS allocated FROM s, (VALUES (0.0::DOUBLE), (0.25), (0.5)) g(weight)")
def allocate(spark, folder):
    return tidy(models.allocated(forecasts(spark, folder), "champion", "naive", WEIGHTS), "weight", "geo", "p", "allocated")


_Z = "CASE WHEN stddev_pop(naive) OVER c > 0 THEN least(greatest((naive - avg(naive) OVER c) / stddev_pop(naive) OVER c, -4.0), 4.0) ELSE 0.0 END"


@query("MDL27_MDL20_tilt", f"WITH {CHAMPION}, s AS (SELECT *, {_Z} AS z FROM champ WINDOW c AS (PARTITION BY p)), t AS (SELECT *, champion * exp(0.2 * z) AS tilt FROM s) SELECT geo, p, round(coalesce(sum(champion) OVER c * tilt / nullif(sum(tilt) OVER c, 0), 0.0), 5) AS tilted FROM t WINDOW c AS (PARTITION BY p)")
def tilt(spark, folder):
    out = features.within_cut(forecasts(spark, folder), "naive")
    return models.tilted(out, "champion", "z", 0.2).select("geo", "p", F.round("tilted", 5).alias("tilted"))


@query("WIN28_MDL28_ratio", f"WITH {CHAMPION} SELECT geo, p, round(least(greatest((coalesce(sum(y) OVER w, 0.0) + 10.0) / (coalesce(sum(clim) OVER w, 0.0) + 10.0), 0.5), 2.0) * clim, 6) AS local FROM clim WINDOW w AS (PARTITION BY geo ORDER BY p RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)")
def local_ratio(spark, folder):
    base = models.climatology(dense(spark, folder))
    return tidy(base, "geo", "p", local=clip(models.trailing_ratio(base, ["geo"], 12, 10.0), 0.5, 2.0) * F.col("clim"))


@query("PAN09_scenarios", f"WITH {PANEL}, c AS (SELECT geo, mes, avg(y) AS clim FROM panel GROUP BY geo, mes) SELECT geo, CAST(ano AS INT) AS ano, CAST(c.mes AS INT) AS mes, scenario, round(clim * f, 6) AS forecast FROM c, (VALUES (2002), (2003)) y(ano), (VALUES ('base', 1.0::DOUBLE), ('high', 1.3), ('low', 0.7)) s(scenario, f)")
def scenarios(spark, folder):
    clim = dense(spark, folder).groupBy("geo", "mes").agg(F.avg("y").alias("clim"))
    options = F.explode(F.array(*[F.struct(F.lit(y).alias("ano"), F.lit(n).alias("scenario"), F.lit(f).alias("f")) for y in (2002, 2003) for n, f in (("base", 1.0), ("high", 1.3), ("low", 0.7))])).alias("o")
    return tidy(clim.select("*", options), "geo", "o.ano", "mes", "o.scenario", forecast=F.col("clim") * F.col("o.f"))
