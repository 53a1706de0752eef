"""Queries of bands from past residuals, station means, roll-ups and drift triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import bands, monitoring, spatial
from panelforge.plans.common_sql import CHAMPION, ENTITIES, PANEL
from panelforge.plans.evaluation_queries import _REGIME
from panelforge.plans.panel_queries import dense, forecasts, observed
from panelforge.plans.registry import query, tidy
from panelforge.plans.spatial_queries import _KM
from panelforge.sources.tables import entities, new_folder, stored, table
from panelforge.streaming import adaptive as streaming
from panelforge.streaming import jobs, monitor

#: 1999-01, and the year 2000 in which levels are chosen; later cuts choose nothing.
START, CHOICE_FIRST, CHOICE_LAST = 23989, 24001, 24012
ALPHAS, GAMMAS, TARGET = (0.05, 0.04, 0.03, 0.02), (0.05, 0.1, 0.2, 0.3), 0.9

_PAST = f"""{CHAMPION}, h AS (SELECT {_REGIME} AS regime, p, round(abs(y - champion), 3) AS e, count(*) AS n FROM champ GROUP BY ALL),
 cuts AS (SELECT DISTINCT regime, p FROM h WHERE p >= {START}),
 past AS (SELECT cuts.regime, cuts.p, h.e, CAST(sum(h.n) AS BIGINT) AS n FROM cuts JOIN h ON cuts.regime = h.regime AND h.p < cuts.p GROUP BY ALL),
 cum AS (SELECT *, CAST(sum(n) OVER (PARTITION BY regime, p ORDER BY e) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY regime, p) AS BIGINT) AS total FROM past)"""


def _counts(spark, folder):
    rows = forecasts(spark, folder).withColumn("regime", F.expr(_REGIME))
    return bands.residual_counts(rows, "y", "champion")


@query("UNC04_rolling_conformal", f"""WITH {_PAST}, g AS (SELECT CAST(unnest({list(ALPHAS)}) AS DOUBLE) AS alpha),
 w AS (SELECT alpha, regime, p, min(e) AS width FROM cum, g WHERE upto >= least(greatest(ceil((total + 1) * (1 - alpha)), 1), total) GROUP BY ALL),
 k AS (SELECT alpha, regime, p, min(width) AS width, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN e <= width THEN n ELSE 0 END) AS BIGINT) AS covered FROM w JOIN h USING (regime, p) GROUP BY alpha, regime, p),
 v AS (SELECT alpha, sum(covered) / sum(n) AS whole, sum(CASE WHEN regime = 'dry' THEN covered END) / sum(CASE WHEN regime = 'dry' THEN n END) AS dry,
  sum(CASE WHEN regime = 'wet' THEN covered END) / sum(CASE WHEN regime = 'wet' THEN n END) AS wet FROM k WHERE p BETWEEN {CHOICE_FIRST} AND {CHOICE_LAST} GROUP BY alpha),
 s AS (SELECT coalesce((SELECT max(alpha) FROM v WHERE whole BETWEEN 0.94 AND 0.98 AND dry BETWEEN 0.94 AND 0.98 AND wet BETWEEN 0.94 AND 0.98), (SELECT alpha FROM v ORDER BY whole DESC, alpha LIMIT 1)) AS best)
 SELECT alpha, regime, p, round(width, 6) AS width, n, covered, alpha = best AS selected FROM k, s""")
def rolling_conformal(spark, folder):
    out = bands.guarded_choice(bands.rolling(_counts(spark, folder), ALPHAS, START), CHOICE_FIRST, CHOICE_LAST)
    return out.select("alpha", "regime", "p", F.round("width", 6).alias("width"), "n", "covered", "selected")


_ADAPTIVE = f"""WITH RECURSIVE {_PAST}, o AS (SELECT regime, p, row_number() OVER (PARTITION BY regime ORDER BY p) AS k, min(total) AS total FROM cum GROUP BY regime, p),
 r AS (SELECT CAST(gamma AS DOUBLE) AS gamma, regime, CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS p, CAST(NULL AS DOUBLE) AS q, CAST(NULL AS DOUBLE) AS width, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS covered, CAST({TARGET} AS DOUBLE) AS level
   FROM (SELECT unnest({list(GAMMAS)}) AS gamma), (SELECT DISTINCT regime FROM o)
  UNION ALL SELECT gamma, regime, k, p, q, width, n, covered, level + gamma * (CAST({TARGET} AS DOUBLE) - covered / n) FROM (
   SELECT x.gamma, x.regime, x.k, x.p, x.q, x.level, min(a.e + (b.e - a.e) * (x.place - floor(x.place))) AS width, CAST(sum(h.n) AS BIGINT) AS n,
     CAST(sum(CASE WHEN h.e <= a.e + (b.e - a.e) * (x.place - floor(x.place)) THEN h.n ELSE 0 END) AS BIGINT) AS covered
   FROM (SELECT r.gamma, r.regime, o.k, o.p, o.total, r.level, least(greatest(r.level, 0.5), 0.999) AS q, (o.total - 1) * least(greatest(r.level, 0.5), 0.999) AS place FROM r JOIN o ON o.regime = r.regime AND o.k = r.k + 1) x
   JOIN cum a ON a.regime = x.regime AND a.p = x.p AND a.upto > floor(x.place) AND a.upto - a.n <= floor(x.place)
   JOIN cum b ON b.regime = x.regime AND b.p = x.p AND b.upto > least(floor(x.place) + 1, x.total - 1) AND b.upto - b.n <= least(floor(x.place) + 1, x.total - 1)
   JOIN h ON h.regime = x.regime AND h.p = x.p GROUP BY x.gamma, x.regime, x.k, x.p, x.q, x.level)),
 m AS (SELECT gamma, abs(sum(covered) / sum(n) - CAST({TARGET} AS DOUBLE)) AS miss FROM r WHERE k > 0 AND p <= {CHOICE_LAST} GROUP BY gamma),
 s AS (SELECT gamma AS best FROM m ORDER BY miss, gamma LIMIT 1)
 SELECT gamma, regime, p, round(q, 6) AS q, round(width, 6) AS width, n, covered, gamma = best AS selected FROM r, s WHERE k > 0"""


@query("UNC05_STR08_adaptive", _ADAPTIVE)
def adaptive(spark, folder):
    out = bands.nearest_choice(bands.adaptive(_counts(spark, folder), GAMMAS, TARGET, START), TARGET, CHOICE_LAST)
    return out.select("gamma", "regime", "p", F.round("q", 6).alias("q"), F.round("width", 6).alias("width"), "n", "covered", "selected")


@query("STR08_adaptive_stream", _ADAPTIVE)
def adaptive_stream(spark, folder):
    """The same bands from a stream of cuts, a file a year."""
    counts = stored(_counts(spark, folder), "counts")
    year = F.floor((F.col("p") - 1) / 12)
    years = [r[0] for r in counts.select(year.alias("a")).distinct().orderBy("a").collect()]
    cuts = monitor.in_files(counts, [year == a for a in years], new_folder(spark, "cuts"))
    with streaming.rocks(spark):
        out = jobs.run_append(streaming.adaptive(cuts, GAMMAS, TARGET, START), "bands")
    out = bands.nearest_choice(out, TARGET, CHOICE_LAST)
    return out.select("gamma", "regime", "p", F.round("q", 6).alias("q"), F.round("width", 6).alias("width"), "n", "covered", "selected")


@query("STR01_STR02_stream", f"""WITH {CHAMPION}, s AS (SELECT champ.p, count(*) AS n_scored, sum(panel.y) AS observed_total, sum(champion) AS predicted_total, sum(abs(panel.y - champion)) / nullif(sum(panel.y), 0) AS wape, avg(abs(panel.y - champion)) AS mae
  FROM champ JOIN panel ON panel.geo = champ.geo AND panel.p = champ.p WHERE champ.p BETWEEN 24000 AND 24009 GROUP BY champ.p)
 SELECT p, 'champion' AS model, 'panel' AS target, '' AS sensor, 'v1' AS version, n_scored, CAST(0 AS BIGINT) AS n_missing, round(observed_total, 6) AS observed_total, round(predicted_total, 6) AS predicted_total, round(wape, 6) AS wape, round(mae, 6) AS mae, CASE WHEN wape > CAST(0.35 AS DOUBLE) THEN 'wape above reference' ELSE '' END AS alerts FROM s""")
def monitored_stream(spark, folder):
    """Forecasts from 24000 on are logged with repeats, months before 24010 observed in three parts, and a batch of each is replayed."""
    base = new_folder(spark, "monitor")
    rows = stored(forecasts(spark, folder).where("p >= 24000").select("geo", "p", F.lit("champion").alias("model"), F.col("champion").alias("pred")), "log")
    seen = stored(dense(spark, folder).where("p BETWEEN 24000 AND 24009").select("geo", "p", "y"), "seen")
    scorer = monitor.Scorer(f"{base}/log", base, rows.schema, {"target": "panel", "sensor": "", "version": "v1"}, False, 0.3, 0.05)
    record = lambda r, b: monitor.record(r, b, f"{base}/log")
    p = F.col("p")
    logged = monitor.in_files(rows, [p <= 24004, p.between(24003, 24006), p >= 24005], f"{base}/forecasts")
    observed = monitor.in_files(seen, [p <= 24002, p.between(24003, 24005), p >= 24006], f"{base}/observed")
    monitor.run(logged, record, f"{base}/log-state")
    monitor.run(observed, scorer.score, f"{base}/score-state")
    record(rows.where(p.between(24003, 24006)), 1)
    scorer.score(seen.where(p.between(24003, 24005)), 1)
    return tidy(scorer.scored(spark), *monitor.SCORE_KEYS, "n_scored", "n_missing", "observed_total", "predicted_total", "wape", "mae", "alerts")


@query("AGG12_JON17_station_idw", f"""WITH {PANEL}, {ENTITIES}, st AS (SELECT s_nationkey AS station, min_by(lat, geo) AS lat, min_by(lon, geo) AS lon FROM ent JOIN supplier ON s_suppkey = geo GROUP BY s_nationkey),
 sv AS (SELECT s_nationkey AS station, p, sum(y) AS v FROM obs JOIN supplier ON s_suppkey = geo GROUP BY s_nationkey, p),
 d AS (SELECT a.geo, b.station, {_KM} AS km FROM ent a, st b)
 SELECT panel.geo, panel.p, round(sum(v / pow(km + 5, 2)) / sum(1 / pow(km + 5, 2)), 5) AS idw, CAST(count(*) AS INTEGER) AS stations FROM panel JOIN d ON d.geo = panel.geo JOIN sv ON sv.station = d.station AND sv.p = panel.p GROUP BY panel.geo, panel.p""")
def station_idw(spark, folder):
    """Stations are the 25 nations, at their first supplier, with a value in the months that have events."""
    places = entities(spark, folder).select("geo", "lat", "lon")
    owner = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("geo"), F.col("s_nationkey").alias("station"))
    stations = places.join(owner, "geo").groupBy("station").agg(F.min_by("lat", "geo").alias("lat"), F.min_by("lon", "geo").alias("lon"))
    values = observed(spark, folder).join(owner, "geo").groupBy("station", "p").agg(F.sum("y").alias("v"))
    out = spatial.station_means(dense(spark, folder).select("geo", "p").join(places, "geo"), values.join(stations, "station"))
    return out.select("geo", "p", F.round("idw", 5).alias("idw"), "stations")


@query("SRV03_monthly", f"WITH {CHAMPION} SELECT ano, mes, sum(y) AS actual, round(sum(champion), 6) AS pred, round(abs(sum(y) - sum(champion)), 6) AS abs_error, round(CASE WHEN sum(y) <> 0 THEN abs(sum(y) - sum(champion)) / sum(y) END, 6) AS wape FROM champ GROUP BY ano, mes")
def monthly(spark, folder):
    m = forecasts(spark, folder).groupBy("ano", "mes").agg(F.sum("y").alias("actual"), F.sum("champion").alias("pred"))
    error = F.abs(F.col("actual") - F.col("pred"))
    return tidy(m, "ano", "mes", "actual", "pred", abs_error=error, wape=F.when(F.col("actual") != 0, error / F.col("actual")))


@query("SRV03_ranking", f"WITH {CHAMPION}, {ENTITIES}, g AS (SELECT geo, sum(y) AS volume, round(avg(abs(y - champion)), 6) AS mae, round(CASE WHEN sum(y) > 0 THEN sum(abs(y - champion)) / sum(y) END, 6) AS wape FROM champ WHERE ano >= 2001 GROUP BY geo ORDER BY wape DESC NULLS LAST, geo LIMIT 15) SELECT g.*, round(lat, 6) AS lat, round(lon, 6) AS lon FROM g LEFT JOIN ent ON ent.geo = g.geo")
def ranking(spark, folder):
    """The 15 hardest entities, with their place on the map if they have one."""
    miss = F.abs(F.col("y") - F.col("champion"))
    g = forecasts(spark, folder).where("ano >= 2001").groupBy("geo").agg(F.sum("y").alias("volume"), F.round(F.avg(miss), 6).alias("mae"), F.round(F.when(F.sum("y") > 0, F.sum(miss) / F.sum("y")), 6).alias("wape"))
    top = g.orderBy(F.desc_nulls_last("wape"), "geo").limit(15)
    return tidy(top.join(entities(spark, folder).select("geo", "lat", "lon"), "geo", "left"), "geo", "volume", "mae", "wape", "lat", "lon")


@query("STR09_triggers", f"WITH {CHAMPION}, m AS (SELECT p, round(sum(abs(y - champion)) / nullif(sum(y), 0), 6) AS wape, round(avg(CASE WHEN abs(y - champion) <= 2 * sqrt(champion) + 1 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM champ GROUP BY p) SELECT p, wape, coverage, coalesce(wape, 0) > 0.35 OR coalesce(coverage, 1) < 0.88 AS retrain FROM m")
def triggers(spark, folder):
    miss = F.abs(F.col("y") - F.col("champion"))
    inside = (miss <= 2 * F.sqrt("champion") + 1).cast("double")
    m = forecasts(spark, folder).groupBy("p").agg(F.round(F.sum(miss) / F.nullif(F.sum("y"), F.lit(0.0)), 6).alias("wape"), F.round(F.avg(inside), 6).alias("coverage"))
    return m.select("p", "wape", "coverage", monitoring.retrain(wape=F.col("wape"), coverage=F.col("coverage")).alias("retrain"))
