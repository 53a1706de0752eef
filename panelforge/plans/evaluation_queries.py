"""Queries of measures, gates, resampling, uncertainty, audits and monitoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import audit, metrics, models, monitoring
from panelforge.plans.common_sql import CHAMPION, ENTITIES, PANEL
from panelforge.plans.panel_queries import dense, forecasts
from panelforge.plans.registry import query, tidy
from panelforge.sources.tables import entities, table

_LONG = ", long AS (SELECT geo, p, ano, mes, y, clim, 'champion' AS model, champion AS pred FROM champ UNION ALL SELECT geo, p, ano, mes, y, clim, 'naive', naive FROM champ UNION ALL SELECT geo, p, ano, mes, y, clim, 'climatology', clim FROM champ)"
LONG = CHAMPION + _LONG


def predictions(spark, folder):
    """Long table: model, cut p, geo, y, pred."""
    wide = forecasts(spark, folder)
    return wide.withColumn("climatology", F.col("clim")).unpivot(["geo", "p", "ano", "mes", "y", "clim"], ["champion", "naive", "climatology"], "model", "pred")


def _w(where: str | None = None, y: str = "y", p: str = "pred") -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"sum(abs({y} - {p})){f} / nullif(sum(abs({y})){f}, 0)"


@query("MET01_MET08_metrics", f"WITH {LONG} SELECT model, count(*) AS n, round({_w()}, 6) AS wape, round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(avg(abs(y - pred) / y) FILTER (WHERE y > 0), 6) AS mape, round(CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - pred) * (y - pred)) / var_pop(y) ELSE 0.0 END, 6) AS r2, round(sum(pred) - sum(y), 4) AS bias, round(coalesce(avg(CASE WHEN pred <= 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE clim > 0), 0.0), 6) AS undue FROM long GROUP BY model")
def measures(spark, folder):
    e = metrics.errors(F.col("y"), F.col("pred"))
    out = predictions(spark, folder).groupBy("model").agg(*[c.alias(k) for k, c in e.items()], metrics.undue_zeros(F.col("pred"), F.col("clim")).alias("undue"))
    return tidy(out.withColumn("bias", F.round("bias", 4)), "model", *e, "undue")


@query("MET15_MET19_seasons", f"WITH {LONG} SELECT model, round({_w()}, 6) AS wape_all, round({_w('mes IN (10, 11)')}, 6) AS wape_critical, round({_w('mes BETWEEN 8 AND 12')}, 6) AS wape_dry, round({_w('y >= 10')}, 6) AS wape_high FROM long GROUP BY model")
def seasons(spark, folder):
    y, p = F.col("y"), F.col("pred")
    out = predictions(spark, folder).groupBy("model").agg(
        metrics.wape(y, p).alias("wape_all"), metrics.wape(y, p, F.col("mes").isin(10, 11)).alias("wape_critical"), metrics.wape(y, p, F.col("mes").between(8, 12)).alias("wape_dry"), metrics.wape(y, p, y >= 10).alias("wape_high")
    )
    return tidy(out, "model", "wape_all", "wape_critical", "wape_dry", "wape_high")


@query("AGG27_MET25_slices", f"WITH {LONG}, {ENTITIES} SELECT model, uf, mes, count(*) AS n, round({_w()}, 6) AS wape FROM long JOIN ent ON long.geo = ent.geo GROUP BY GROUPING SETS ((model, uf), (model, uf, mes), (model, mes), (model))")
def slices(spark, folder):
    joined = predictions(spark, folder).join(entities(spark, folder), "geo")
    sets = [["model", "uf"], ["model", "uf", "mes"], ["model", "mes"], ["model"]]
    out = joined.groupingSets([[F.col(c) for c in s] for s in sets], "model", "uf", "mes").agg(F.count(F.lit(1)).alias("n"), metrics.wape(F.col("y"), F.col("pred")).alias("wape"))
    return tidy(out, "model", "uf", "mes", "n", "wape")


@query("AGG21_levels", f"WITH {CHAMPION} SELECT geo, ano, mes, sum(y) AS y, round(sum(champion), 6) AS pred FROM champ GROUP BY GROUPING SETS ((geo, ano), (ano, mes), (ano))")
def levels(spark, folder):
    out = forecasts(spark, folder).groupingSets([[F.col("geo"), F.col("ano")], [F.col("ano"), F.col("mes")], [F.col("ano")]], "geo", "ano", "mes").agg(F.sum("y").alias("y"), F.sum("champion").alias("pred"))
    return tidy(out, "geo", "ano", "mes", "y", "pred")


@query("MET17_by_year", f"WITH {LONG} SELECT model, ano, round({_w()}, 6) AS wape, round(avg(abs(y - pred)), 6) AS mae FROM long GROUP BY model, ano")
def by_year(spark, folder):
    out = predictions(spark, folder).groupBy("model", "ano").agg(metrics.wape(F.col("y"), F.col("pred")).alias("wape"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))
    return tidy(out, "model", "ano", "wape", "mae")


@query("SRT06_MET09_recall", f"WITH {CHAMPION}, t AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY y DESC, geo) AS ry, row_number() OVER (PARTITION BY p ORDER BY round(champion, 9) DESC, geo) AS rp FROM champ) SELECT p, round(sum(CASE WHEN ry <= 10 AND rp <= 10 THEN 1 ELSE 0 END) / sum(CASE WHEN ry <= 10 THEN 1 ELSE 0 END), 6) AS recall FROM t GROUP BY p")
def recall(spark, folder):
    return tidy(metrics.recall_at_k(forecasts(spark, folder).withColumn("pred", F.round("champion", 9)), 10), "p", "recall")


@query("MET10_stability", f"WITH {PANEL}, e AS (SELECT y FROM panel WHERE ano <= 1998), a AS (SELECT y FROM panel WHERE ano > 1998), r AS (SELECT min(y) AS lo, max(y) AS hi FROM e), eb AS (SELECT least(floor((y - lo) / (hi - lo) * 10), 9) AS b, count(*) AS n FROM e, r GROUP BY 1), ab AS (SELECT least(floor((y - lo) / (hi - lo) * 10), 9) AS b, count(*) AS n FROM a, r WHERE y BETWEEN lo AND hi GROUP BY 1), j AS (SELECT coalesce(eb.n, 0) AS e, coalesce(ab.n, 0) AS a FROM eb FULL JOIN ab ON eb.b = ab.b), s AS (SELECT e / sum(e) OVER () AS e, a / sum(a) OVER () AS a FROM j) SELECT round(sum((a - e) * ln((a + 1e-6) / (e + 1e-6))), 6) AS psi FROM s")
def stability(spark, folder):
    panel = dense(spark, folder)
    return tidy(metrics.stability_index(panel.where("ano <= 1998"), panel.where("ano > 1998"), "y", 10), "psi")


@query("MET12_MET20_gate", f"WITH {LONG}, m AS (SELECT model, {_w()} AS wape, {_w('mes = 13')} AS wape_none, avg(abs(y - pred)) AS mae FROM long GROUP BY model) SELECT model, concat_ws('; ', CASE WHEN wape IS NULL THEN 'wape missing' WHEN wape > 0.35 THEN 'wape above limit' END, CASE WHEN wape_none IS NULL THEN 'wape_none missing' WHEN wape_none > 1 THEN 'wape_none above limit' END, CASE WHEN mae IS NULL THEN 'mae missing' WHEN mae > 2.5 THEN 'mae above limit' END) AS reasons, false AS passed FROM m")
def gate(spark, folder):
    y, p = F.col("y"), F.col("pred")
    rows = predictions(spark, folder).groupBy("model").agg(metrics.wape(y, p).alias("wape"), metrics.wape(y, p, F.col("mes") == 13).alias("wape_none"), F.avg(F.abs(y - p)).alias("mae"))
    return metrics.gate(rows, {"wape": 0.35, "wape_none": 1.0, "mae": 2.5}).select("model", "reasons", "passed")


@query("MET16_wins", f"WITH {CHAMPION}, c AS (SELECT p, sum(abs(y - champion)) AS a, sum(abs(y - naive)) AS b FROM champ GROUP BY p) SELECT count(*) AS cuts, CAST(sum(CASE WHEN a < b THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM c")
def wins(spark, folder):
    return metrics.wins(forecasts(spark, folder), "champion", "naive")


_DRAWN = "CAST(('0x' || substr(md5('42:' || d || ':' || t), 1, 8)) AS BIGINT) % n"


_DELTAS = f"WITH {CHAMPION}, c AS (SELECT p, sum(abs(y - champion)) AS a, sum(abs(y - naive)) AS b, sum(y) AS s FROM champ GROUP BY p), k AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM c), x AS (SELECT d, {_DRAWN} AS i FROM (SELECT unnest(range(2000)) AS d), (SELECT n, unnest(range(n)) AS t FROM (SELECT DISTINCT n FROM k)))"


@query("MET18_bootstrap", _DELTAS + " SELECT d AS draw, round(sum(a) / sum(s) - sum(b) / sum(s), 6) AS delta FROM x JOIN k USING (i) GROUP BY d")
def bootstrap(spark, folder):
    return tidy(metrics.block_bootstrap(forecasts(spark, folder), "champion", "naive"), "draw", "delta")


@query("MET18_block_bootstrap", _DELTAS + ", v AS (SELECT sum(a) / sum(s) - sum(b) / sum(s) AS delta FROM x JOIN k USING (i) GROUP BY d) SELECT count(*) AS draws, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, round(avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END), 6) AS better FROM v")
def block_bootstrap(spark, folder):
    deltas = metrics.block_bootstrap(forecasts(spark, folder), "champion", "naive")
    return tidy(metrics.bootstrap_interval(deltas), "draws", "low", "high", "better")


_REGIME = "CASE WHEN mes BETWEEN 8 AND 12 THEN 'dry' ELSE 'wet' END"


@query("UNC01_UNC03_conformal", f"WITH {CHAMPION}, r AS (SELECT {_REGIME} AS regime, round(abs(y - champion), 9) AS e FROM champ WHERE ano < 2001), k AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY e) AS r, count(*) OVER (PARTITION BY regime) AS n FROM r), q AS (SELECT regime, e AS width FROM k WHERE r = least(greatest(ceil((n + 1) * (1 - 0.1)), 1), n)), t AS (SELECT champ.*, {_REGIME} AS regime FROM champ WHERE ano >= 2001) SELECT t.regime, round(min(width), 6) AS width, count(*) AS n, round(avg(CASE WHEN y >= greatest(champion - width, 0) AND y <= champion + width THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM t JOIN q ON t.regime = q.regime GROUP BY t.regime")
def conformal(spark, folder):
    rows = forecasts(spark, folder).withColumn("regime", F.expr(_REGIME))
    past = rows.where("ano < 2001").select("regime", F.round(F.abs(F.col("y") - F.col("champion")), 9).alias("residual"))
    bands = rows.where("ano >= 2001").join(F.broadcast(metrics.conformal_width(past, 0.1, ["regime"])), "regime")  # a row a regime
    hit = F.col("y").between(F.greatest(F.col("champion") - F.col("width"), F.lit(0.0)), F.col("champion") + F.col("width"))
    return tidy(bands.groupBy("regime").agg(F.min("width").alias("width"), F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("coverage")), "regime", "width", "n", "coverage")


@query("AGG20_UNC09_dispersion", f"WITH {PANEL}, g AS (SELECT geo, mes, avg(y) AS m, var_samp(y) AS v, count(*) AS n FROM panel GROUP BY geo, mes HAVING count(*) >= 2) SELECT round(sum(greatest(v - m, 0)) / nullif(sum(m * m), 0), 6) AS dispersion, count(*) AS groups FROM g")
def dispersion(spark, folder):
    g = dense(spark, folder).groupBy("geo", "mes").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return tidy(g.agg(F.try_divide(F.sum(F.greatest(F.col("v") - F.col("m"), F.lit(0.0))), F.sum(F.col("m") * F.col("m"))).alias("dispersion"), F.count(F.lit(1)).alias("groups")), "dispersion", "groups")


@query("UNC08_noise_floor")
def noise_floor(spark, folder):
    means = forecasts(spark, folder).select(F.xxhash64("geo", "p").alias("p"), F.col("champion").alias("mean"))
    return metrics.noise_floor(means, dispersion(spark, folder), 4000)


@query("MET24_SRT07_robustness", f"WITH {CHAMPION}, g AS (SELECT geo, {_w(p='champion')} AS wape, sum(y) AS volume FROM champ GROUP BY geo), o AS (SELECT {_w(p='champion')} AS overall FROM champ) SELECT geo, round(wape, 6) AS wape, volume, wape > 1.2 * overall AND volume >= 10 AS flagged FROM g, o")
def robustness(spark, folder):
    rows = forecasts(spark, folder)
    y, p = F.col("y"), F.col("champion")
    each = rows.groupBy("geo").agg(metrics.wape(y, p).alias("wape"), F.sum("y").alias("volume"))
    out = each.crossJoin(rows.agg(metrics.wape(y, p).alias("overall")))
    return tidy(out, "geo", "wape", "volume", flagged=(F.col("wape") > 1.2 * F.col("overall")) & (F.col("volume") >= 10))


@query("SRT04_top_errors", f"WITH {CHAMPION} SELECT geo, p, y, round(abs(y - champion), 6) AS error FROM champ ORDER BY round(abs(y - champion), 6) DESC, geo, p LIMIT 15")
def top_errors(spark, folder):
    return forecasts(spark, folder).select("geo", "p", "y", F.round(F.abs(F.col("y") - F.col("champion")), 6).alias("error")).orderBy(F.desc("error"), "geo", "p").limit(15)


@query("PRJ26_MET26_bands", f"WITH {CHAMPION}, b AS (SELECT *, CASE WHEN y <= 3 THEN 'low' WHEN y <= 9 THEN 'mid' ELSE 'high' END AS band FROM champ) SELECT band, count(*) AS n, round({_w(p='champion')}, 6) AS wape, round(sum(champion) - sum(y), 4) AS bias FROM b GROUP BY band")
def bands(spark, folder):
    band = F.when(F.col("y") <= 3, "low").when(F.col("y") <= 9, "mid").otherwise("high")
    out = forecasts(spark, folder).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), metrics.wape(F.col("y"), F.col("champion")).alias("wape"), (F.sum("champion") - F.sum("y")).alias("bias"))
    return tidy(out.withColumn("bias", F.round("bias", 4)), "band", "n", "wape", "bias")


@query("AGG31_correlations", f"WITH {CHAMPION}, r AS (SELECT y, champion, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY round(champion, 9)) + (count(*) OVER (PARTITION BY round(champion, 9)) - 1) / 2 AS rp FROM champ) SELECT round(corr(y, champion), 6) AS pearson, round(corr(ry, rp), 6) AS spearman FROM r")
def correlations(spark, folder):
    return tidy(audit.correlations(forecasts(spark, folder).withColumn("champion", F.round("champion", 9)), "y", "champion"), "pearson", "spearman")


@query("AGG29_null_fractions", f"WITH {CHAMPION}, f AS (SELECT lag(y, 3) OVER (PARTITION BY geo ORDER BY p) AS lag3, lag(y, 12) OVER (PARTITION BY geo ORDER BY p) AS lag12, y FROM panel) SELECT unnest(['y', 'lag3', 'lag12']) AS name, unnest([round(avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END), 6), round(avg(CASE WHEN lag3 IS NULL THEN 1.0 ELSE 0.0 END), 6), round(avg(CASE WHEN lag12 IS NULL THEN 1.0 ELSE 0.0 END), 6)]) AS null_fraction FROM f")
def null_fractions(spark, folder):
    w = models.ordered("geo")
    return tidy(audit.null_fractions(dense(spark, folder).select("y", F.lag("y", 3).over(w).alias("lag3"), F.lag("y", 12).over(w).alias("lag12"))), "name", "null_fraction")


@query("AGG30_AUD01_leakage", f"WITH {PANEL}, f AS (SELECT y, lag(y) OVER (PARTITION BY geo ORDER BY p) AS lag1, y * 2 + 1 AS copied, CAST(mes AS DOUBLE) AS mes FROM panel) SELECT unnest(['lag1', 'copied', 'mes']) AS name, unnest([round(corr(lag1, y), 6), round(corr(copied, y), 6), round(corr(mes, y), 6)]) AS corr, unnest([abs(corr(lag1, y)) > 0.95, abs(corr(copied, y)) > 0.95, abs(corr(mes, y)) > 0.95]) AS leaks FROM f")
def leakage(spark, folder):
    f = dense(spark, folder).select("y", F.lag("y").over(models.ordered("geo")).alias("lag1"), (F.col("y") * 2 + 1).alias("copied"), F.col("mes").cast("double").alias("mes"))
    return tidy(audit.leakage(f, "y", 0.95), "name", "corr", "leaks")


@query("AGG28_census", "SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates, count(DISTINCT l_suppkey) AS entities FROM lineitem")
def census(spark, folder):
    return audit.census(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey")


@query("AGG32_STR04_freshness", f"WITH {PANEL}, l AS (SELECT geo, max(p) AS latest FROM obs GROUP BY geo) SELECT geo, latest, (SELECT max(p) FROM obs) - latest AS behind, (SELECT max(p) FROM obs) - latest > 2 AS stale FROM l")
def freshness(spark, folder):
    return audit.freshness(dense(spark, folder).where("y > 0"))


@query("STR02_STR05_delayed_scores", f"WITH {CHAMPION}, log AS (SELECT geo, p, champion FROM champ WHERE p >= 24000), obs2 AS (SELECT geo, p, y FROM panel WHERE p < 24010) SELECT log.p, count(*) AS n_scored, round(sum(abs(y - champion)) / nullif(sum(y), 0), 6) AS wape, CASE WHEN sum(abs(y - champion)) / nullif(sum(y), 0) > 0.3 THEN 'wape' ELSE '' END AS alerts FROM log JOIN obs2 ON log.geo = obs2.geo AND log.p = obs2.p WHERE log.p <> 24001 GROUP BY log.p")
def delayed_scores(spark, folder):
    log = forecasts(spark, folder).where("p >= 24000").select("geo", "p", F.col("champion").alias("pred"))
    seen = dense(spark, folder).where("p < 24010").select("geo", "p", "y")
    done = spark.createDataFrame([(24001,)], "p int")
    return tidy(monitoring.scores(log, seen, done, 0.3), "p", "n_scored", "wape", "alerts")


@query("STR01_append_once", f"WITH {CHAMPION} SELECT DISTINCT geo, p FROM champ WHERE p > 23990")
def append_once(spark, folder):
    rows = forecasts(spark, folder).select("geo", "p")
    return monitoring.new_records(rows.where("p > 23990").unionByName(rows.where("p > 24000")), rows.where("p <= 23990"), ["geo", "p"])


@query("MDL37_MET27_strategies", f"WITH {CHAMPION}, s AS (SELECT p, sum(y) AS y, sum(clim) AS none, sum(clim * ratio) AS monthly, sum(clim * (SELECT max_by(ratio, p) FROM ratio WHERE p < 23990)) AS fixed FROM champ WHERE p >= 23990 GROUP BY p) SELECT round(sum(abs(none - y)), 4) AS none, round(sum(abs(monthly - y)), 4) AS monthly, round(sum(abs(fixed - y)), 4) AS fixed FROM s")
def strategies(spark, folder):
    rows = forecasts(spark, folder)
    fixed = models.regional_ratio(models.climatology(dense(spark, folder))).where("p < 23990").agg(F.max_by("ratio", "p").alias("last"))
    s = rows.where("p >= 23990").crossJoin(fixed).groupBy("p").agg(F.sum("y").alias("y"), F.sum("clim").alias("none"), F.sum("champion").alias("monthly"), F.sum(F.col("clim") * F.col("last")).alias("fixed"))
    return s.agg(*[F.round(F.sum(F.abs(F.col(c) - F.col("y"))), 4).alias(c) for c in ("none", "monthly", "fixed")])
