"""Queries of joins, composite scores, lookups, learned models and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import clip, share
from panelforge.operators import features, learners, metrics, models, serving, spatial
from panelforge.operators.quantiles import wide
from panelforge.plans.common_sql import CHAMPION, CLIMATE, ENTITIES, EVENTS, GAPPED, OBSERVED, PANEL
from panelforge.plans.evaluation_queries import _REGIME, LONG, predictions
from panelforge.plans.panel_queries import dense, forecasts, gapped, observed
from panelforge.plans.registry import query, tidy
from panelforge.plans.spatial_queries import EDGES, edges, squares
from panelforge.sources.tables import entities, point_events, stored, table


@query("UNC02_UNC07_stratified", f"WITH {CHAMPION}, r AS (SELECT {_REGIME} AS regime, geo % 5 AS g, abs(y - champion) AS e FROM champ WHERE ano < 2001), q AS (SELECT regime, g, quantile_cont(e, 0.9) AS w, count(*) AS n FROM r GROUP BY regime, g), a AS (SELECT regime, quantile_cont(e, 0.9) AS w FROM r GROUP BY regime) SELECT q.regime, q.g, n, round(CASE WHEN n >= 40 THEN q.w ELSE a.w END, 6) AS width FROM q JOIN a ON q.regime = a.regime")
def stratified(spark, folder):
    r = forecasts(spark, folder).where("ano < 2001").select(F.expr(_REGIME).alias("regime"), (F.col("geo") % 5).alias("g"), F.abs(F.col("y") - F.col("champion")).alias("e"))
    r = stored(r, "residuals")  # both quantiles are of the same values
    small = wide(r, "e", ["regime", "g"], {"w": 0.9})
    whole = wide(r, "e", ["regime"], {"all": 0.9}).drop("n")
    return tidy(small.join(whole, "regime"), "regime", "g", "n", width=F.when(F.col("n") >= 40, F.col("w")).otherwise(F.col("all")))


@query("UNC04_rolling_band", f"WITH {CHAMPION}, e AS (SELECT p, {_REGIME} AS regime, abs(y - champion) AS e FROM champ), c AS (SELECT p, regime, avg(e) AS m, count(*) AS n FROM e GROUP BY p, regime), b AS (SELECT p, regime, sum(m * n) OVER w / sum(n) OVER w AS past FROM c WINDOW w AS (PARTITION BY regime ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT b.p, b.regime, round(min(past), 6) AS past_error, round(avg(CASE WHEN e <= 3 * past THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM b JOIN e ON b.p = e.p AND b.regime = e.regime WHERE past IS NOT NULL GROUP BY b.p, b.regime")
def rolling_band(spark, folder):
    """Bands of three mean past errors by regime: sums by cut first, so history is a row a cut."""
    e = forecasts(spark, folder).select("p", F.expr(_REGIME).alias("regime"), F.abs(F.col("y") - F.col("champion")).alias("e"))
    c = e.groupBy("p", "regime").agg(F.sum("e").alias("s"), F.count(F.lit(1)).alias("n"))
    past = models.history("regime")
    b = c.select("p", "regime", (F.sum("s").over(past) / F.sum("n").over(past)).alias("past")).where("past IS NOT NULL")
    out = e.join(b, ["p", "regime"]).groupBy("p", "regime").agg(F.min("past").alias("past_error"), F.avg((F.col("e") <= 3 * F.col("past")).cast("double")).alias("coverage"))
    return tidy(out, "p", "regime", "past_error", "coverage")


@query("MDL13_lookup", f"WITH {CHAMPION}, t AS (SELECT geo, mes, avg(y) AS base FROM panel GROUP BY geo, mes), l AS (SELECT max_by(ratio, p) AS last FROM ratio) SELECT t.geo, t.mes, round(base * last, 6) AS pred FROM t, l")
def lookup(spark, folder):
    base = dense(spark, folder)
    table_ = base.groupBy("geo", "mes").agg(F.avg("y").alias("base"))
    last = models.regional_ratio(models.climatology(base)).agg(F.max_by("ratio", "p").alias("last"))
    return tidy(table_.crossJoin(last), "geo", "mes", pred=F.col("base") * F.col("last"))


_STATE = "CASE WHEN (p // 6) % 3 = 0 THEN 'warm' WHEN (p // 6) % 3 = 1 THEN 'cold' ELSE 'neutral' END"


@query("MDL14_AGG19_regime", f"WITH {PANEL}, {CLIMATE}, s AS (SELECT p, {_STATE} AS state, sum(y) AS o, sum(clim) AS e FROM clim GROUP BY p), r AS (SELECT p, state, least(greatest(coalesce(sum(o) OVER w / nullif(sum(e) OVER w, 0), 1.0), 0.5), 2.0) AS r FROM s WINDOW w AS (PARTITION BY state ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT geo, clim.p, round(clim * r, 6) AS pred FROM clim JOIN r ON clim.p = r.p")
def regime(spark, folder):
    base = models.climatology(dense(spark, folder))
    state = F.when(F.floor(F.col("p") / 6) % 3 == 0, "warm").when(F.floor(F.col("p") / 6) % 3 == 1, "cold").otherwise("neutral")
    month = base.groupBy("p").agg(F.sum("y").alias("o"), F.sum("clim").alias("e")).withColumn("state", state)
    past = models.history("state")
    e = F.sum("e").over(past)
    r = month.select("p", clip(F.coalesce(share(F.sum("o").over(past), F.when(e != 0, e)), F.lit(1.0)), 0.5, 2.0).alias("r"))
    return tidy(base.join(F.broadcast(r), "p"), "geo", "p", pred=F.col("clim") * F.col("r"))  # a row a month


@query("MDL24_total_scaling", f"WITH {CHAMPION} SELECT geo, p, round(naive * sum(champion) OVER c / nullif(sum(naive) OVER c, 0), 6) AS scaled FROM champ WINDOW c AS (PARTITION BY p)")
def scaling(spark, folder):
    rows = models.with_sums(forecasts(spark, folder), "p", _champion=F.col("champion"), _naive=F.col("naive"))
    return tidy(rows, "geo", "p", scaled=F.col("naive") * share(F.col("_champion"), F.when(F.col("_naive") != 0, F.col("_naive"))))


@query("MDL29_PRJ28_PRJ29_risk", f"WITH {CHAMPION}, x AS (SELECT geo, p, champion / (1 + champion) AS level, naive / (1 + naive) AS recent, clim / (1 + clim) AS usual FROM champ) SELECT geo, p, round(0.5 * level + 0.3 * recent + 0.2 * usual, 6) AS risk, CASE WHEN round(level, 9) >= greatest(round(recent, 9), round(usual, 9)) THEN 'level' WHEN round(recent, 9) >= round(usual, 9) THEN 'recent' ELSE 'usual' END AS lead FROM x")
def risk(spark, folder):
    x = forecasts(spark, folder)
    squashed = lambda c: F.col(c) / (1 + F.col(c))
    x = x.select("geo", "p", *[squashed(a).alias(b) for a, b in (("champion", "level"), ("naive", "recent"), ("clim", "usual"))])
    r = {c: F.round(c, 9) for c in ("level", "recent", "usual")}
    lead = F.when(r["level"] >= F.greatest(r["recent"], r["usual"]), "level").when(r["recent"] >= r["usual"], "recent").otherwise("usual")
    return tidy(x, "geo", "p", risk=0.5 * F.col("level") + 0.3 * F.col("recent") + 0.2 * F.col("usual"), lead=lead)


@query("MDL33_shock", f"WITH {PANEL}, s AS (SELECT *, coalesce(sum(y) OVER (PARTITION BY geo, ano ORDER BY mes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS ytd FROM panel), n AS (SELECT *, avg(ytd) OVER (PARTITION BY geo, mes ORDER BY ano ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual FROM s) SELECT geo, p, ytd, round(tanh((ytd - usual) / (1 + usual)), 6) AS shock FROM n")
def shock(spark, folder):
    s = features.cumulative(dense(spark, folder))
    s = s.withColumn("usual", F.avg("ytd").over(models.history("geo", "mes", order="ano")))
    return tidy(s, "geo", "p", "ytd", shock=F.tanh((F.col("ytd") - F.col("usual")) / (1 + F.col("usual"))))


@query("MDL34_GEO11_contagion", f"WITH {PANEL}, {EDGES}, w AS (SELECT src, dst, (1 / (1 + km)) / sum(1 / (1 + km)) OVER (PARTITION BY src) AS w FROM edges WHERE rank <= 2), l AS (SELECT geo, p, lag(y) OVER (PARTITION BY geo ORDER BY p) AS lag1 FROM panel) SELECT src AS geo, p, round(sum(w * lag1), 5) AS contagion FROM w JOIN l ON l.geo = dst WHERE lag1 IS NOT NULL GROUP BY src, p")
def contagion(spark, folder):
    e = edges(spark, folder).where("rank <= 2").withColumn("w", 1 / (1 + F.col("km")))
    e = e.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "w")
    lagged = features.lags(dense(spark, folder), (1,)).where("lag1 IS NOT NULL").select(F.col("geo").alias("dst"), "p", "lag1")
    return lagged.join(e, "dst").groupBy(F.col("src").alias("geo"), "p").agg(F.round(F.sum(F.col("w") * F.col("lag1")), 5).alias("contagion"))


@query("WIN29_WIN23_cluster_ratio", f"WITH {PANEL}, {CLIMATE}, t AS (SELECT geo, sum(y) AS total FROM panel WHERE ano < 1998 GROUP BY geo), k AS (SELECT geo, CAST((r > 1 + (n - 1) / 2)::INT AS INT) AS cluster FROM (SELECT geo, row_number() OVER (ORDER BY total, geo) AS r, count(*) OVER () AS n FROM t)), m AS (SELECT cluster, p, sum(y) AS o, sum(clim) AS e FROM clim JOIN k ON clim.geo = k.geo GROUP BY cluster, p) SELECT cluster, p, round((coalesce(sum(o) OVER w, 0.0) + 50.0) / (coalesce(sum(e) OVER w, 0.0) + 50.0), 6) AS ratio FROM m WINDOW w AS (PARTITION BY cluster ORDER BY p RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)")
def cluster_ratio(spark, folder):
    base = models.climatology(dense(spark, folder))
    totals = base.where("ano < 1998").groupBy("geo").agg(F.sum("y").alias("total"))
    k = features.quantile_buckets(totals, "total", 2).select("geo", F.col("bucket").alias("cluster"))
    m = base.join(k, "geo").groupBy("cluster", "p").agg(F.sum("y").alias("y"), F.sum("clim").alias("clim"))
    return tidy(m, "cluster", "p", ratio=models.trailing_ratio(m, ["cluster"], 12, 50.0))


@query("WIN30_structure_guard", f"WITH {PANEL}, l AS (SELECT geo, y, lag(y) OVER (PARTITION BY geo ORDER BY p) AS lag1 FROM panel) SELECT bool_and(abs(y - lag1) < 1e-9) AS same_everywhere, count(*) AS n FROM l WHERE lag1 IS NOT NULL")
def structure_guard(spark, folder):
    lagged = features.lags(dense(spark, folder), (1,)).where("lag1 IS NOT NULL")
    return lagged.agg(F.bool_and(F.abs(F.col("y") - F.col("lag1")) < 1e-9).alias("same_everywhere"), F.count(F.lit(1)).alias("n"))


@query("AGG04_sensor_month", f"WITH {EVENTS} SELECT geo, p, round(avg(CASE WHEN dry >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS dry_share, round(min(risk), 6) AS risk_min, count(risk) AS valid, count(*) AS total, round(quantile_cont(risk, 0.9), 6) AS risk_p90 FROM ev GROUP BY geo, p")
def sensor_month(spark, folder):
    e = point_events(spark, folder).groupBy("geo", "p")
    out = e.agg(F.avg((F.col("dry") >= 0.05).cast("double")).alias("dry_share"), F.min("risk").alias("risk_min"), F.count("risk").alias("valid"), F.count(F.lit(1)).alias("total"), F.percentile("risk", 0.9).alias("risk_p90"))
    return tidy(out, "geo", "p", "dry_share", "risk_min", "valid", "total", "risk_p90")


@query("AGG22_MDL28_regional_signal", f"WITH {PANEL}, {ENTITIES}, m AS (SELECT uf, mes, ano, sum(y) AS s FROM panel JOIN ent ON panel.geo = ent.geo GROUP BY ALL) SELECT uf, mes, round(coalesce(quantile_cont(s, 0.5) FILTER (WHERE s > 0), avg(s)), 6) AS signal FROM m GROUP BY uf, mes")
def regional_signal(spark, folder):
    m = dense(spark, folder).join(entities(spark, folder), "geo").groupBy("uf", "mes", "ano").agg(F.sum("y").alias("s"))
    return tidy(m.groupBy("uf", "mes").agg(F.coalesce(F.percentile(F.when(F.col("s") > 0, F.col("s")), 0.5), F.avg("s")).alias("signal")), "uf", "mes", "signal")


@query("AGG24_pivot_models", f"WITH {LONG} SELECT geo, p, round(max(pred) FILTER (WHERE model = 'champion'), 6) AS champion, round(max(pred) FILTER (WHERE model = 'naive'), 6) AS naive FROM long GROUP BY geo, p")
def pivot_models(spark, folder):
    out = predictions(spark, folder).groupBy("geo", "p").pivot("model", ["champion", "naive"]).agg(F.first("pred"))
    return tidy(out, "geo", "p", "champion", "naive")


@query("AGG33_fusion_weights", f"WITH {CHAMPION}, v AS (SELECT 1 / var_samp(y - champion) AS a, 1 / var_samp(y - naive) AS b, 1 / var_samp(y - clim) AS c FROM champ) SELECT round(a / (a + b + c), 6) AS champion, round(b / (a + b + c), 6) AS naive, round(c / (a + b + c), 6) AS clim FROM v")
def fusion(spark, folder):
    names = ("champion", "naive", "clim")
    v = forecasts(spark, folder).agg(*[(1 / F.var_samp(F.col("y") - F.col(n))).alias(n) for n in names])
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return tidy(v, **{n: F.col(n) / total for n in names})


@query("JON01_JON03_joins", f"WITH {OBSERVED}, {ENTITIES}, m AS (SELECT p, sum(y) AS all_y FROM obs GROUP BY p) SELECT obs.geo, obs.p, obs.y, all_y, uf, round(obs.y / all_y, 6) AS part FROM obs LEFT JOIN m ON obs.p = m.p LEFT JOIN ent ON obs.geo = ent.geo")
def joins(spark, folder):
    o = observed(spark, folder)
    m = o.groupBy("p").agg(F.sum("y").alias("all_y"))
    out = o.join(F.broadcast(m), "p", "left").join(entities(spark, folder).dropDuplicates(["geo"]), "geo", "left")  # m: a row a month
    return tidy(out, "geo", "p", "y", "all_y", "uf", part=F.col("y") / F.col("all_y"))


@query("JON04_JON05_compare", f"WITH {LONG}, a AS (SELECT geo, p, y, pred FROM long WHERE model = 'champion'), b AS (SELECT geo, p, pred FROM long WHERE model = 'naive') SELECT a.geo, count(*) AS n, round(sum(abs(a.y - a.pred)) - sum(abs(a.y - b.pred)), 4) AS delta FROM a JOIN b ON a.geo = b.geo AND a.p = b.p GROUP BY a.geo")
def compare(spark, folder):
    long = predictions(spark, folder)
    a = long.where("model = 'champion'").select("geo", "p", "y", F.col("pred").alias("a"))
    b = long.where("model = 'naive'").select("geo", "p", F.col("pred").alias("b"))
    e = lambda c: F.sum(F.abs(F.col("y") - F.col(c)))
    return a.join(b, ["geo", "p"]).groupBy("geo").agg(F.count(F.lit(1)).alias("n"), F.round(e("a") - e("b"), 4).alias("delta"))


@query("JON11_shifted_regime", f"WITH {PANEL}, r AS (SELECT p, sum(y) AS s FROM panel GROUP BY p) SELECT a.geo, a.p, CASE WHEN r.s IS NULL THEN 'none' WHEN r.s > 50 THEN 'high' ELSE 'low' END AS last_month FROM panel a LEFT JOIN r ON a.p = r.p + 1")
def shifted_regime(spark, folder):
    base = dense(spark, folder)
    r = base.groupBy((F.col("p") + 1).alias("p")).agg(F.sum("y").alias("s"))
    out = base.join(F.broadcast(r), "p", "left")  # a row a month
    return out.select("geo", "p", F.when(F.col("s").isNull(), "none").when(F.col("s") > 50, "high").otherwise("low").alias("last_month"))


@query("JON20_PAN07_absence", f"WITH {EVENTS}, g AS (SELECT e.geo, CAST(m.p AS INT) AS p FROM (SELECT DISTINCT geo FROM ev) e, (SELECT unnest(generate_series(23990, 23995)) AS p) m), o AS (SELECT geo, p, count(*) AS n FROM ev WHERE sensor = 'R' GROUP BY geo, p) SELECT g.geo, g.p, CAST(coalesce(o.n, 0) AS BIGINT) AS n FROM g LEFT JOIN o ON g.geo = o.geo AND g.p = o.p")
def absence(spark, folder):
    """Months without an event of the chosen sensor are 0: absence is known for event data."""
    e = point_events(spark, folder)
    grid = e.select("geo").distinct().select("geo", F.explode(F.sequence(F.lit(23990), F.lit(23995))).alias("p"))
    seen = e.where("sensor = 'R'").groupBy("geo", "p").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(seen, ["geo", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


@query("PAN08_SET01_splice", f"WITH {GAPPED} SELECT geo, p, y, 'frozen' AS source FROM panel WHERE p <= 23990 UNION ALL SELECT geo, p, coalesce(y, 0.0), 'public' FROM panel WHERE p > 23990")
def splice(spark, folder):
    base = gapped(spark, folder).select("geo", "p", "y")
    public = base.where("p > 23990").withColumn("y", F.coalesce("y", F.lit(0.0))).withColumn("source", F.lit("public"))
    return base.where("p <= 23990").withColumn("source", F.lit("frozen")).unionByName(public)


@query("PAN10_grid", "SELECT CAST(x AS INT) AS col, CAST(y AS INT) AS row, CAST(-46 + x * 0.25 AS DOUBLE) AS lon, CAST(-12 + y * 0.25 AS DOUBLE) AS lat FROM generate_series(0, 39) a(x), generate_series(0, 39) b(y)")
def grid(spark, folder):
    cells = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(39))).alias("col")).select("col", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("row"))
    return cells.select("col", "row", (-46 + F.col("col") * 0.25).alias("lon"), (-12 + F.col("row") * 0.25).alias("lat"))


@query("SRT03_SRT05_selection", f"WITH {LONG}, m AS (SELECT model, CASE WHEN model = 'naive' THEN NULL ELSE round(sum(abs(y - pred)) / nullif(sum(y), 0), 9) END AS wape FROM long GROUP BY model) SELECT model, round(wape, 6) AS wape FROM m ORDER BY wape ASC NULLS LAST, model LIMIT 1")
def selection(spark, folder):
    m = predictions(spark, folder).groupBy("model").agg(metrics.wape(F.col("y"), F.col("pred")).alias("wape"))
    m = m.withColumn("wape", F.when(F.col("model") != "naive", F.round("wape", 9)))
    return tidy(m.orderBy(F.asc_nulls_last("wape"), "model").limit(1), "model", "wape")


@query("MET13_MET14_improvement", f"WITH {CHAMPION}, m AS (SELECT sum(abs(y - champion)) / sum(y) AS a, sum(abs(y - naive)) / sum(y) AS b FROM champ) SELECT round(100 * (b - a) / b, 6) AS improvement, a > 0.5 OR (b - a) / b < 0.05 AS retrain FROM m")
def improvement(spark, folder):
    rows = forecasts(spark, folder)
    m = rows.agg(*[metrics.wape(F.col("y"), F.col(c)).alias(n) for c, n in (("champion", "a"), ("naive", "b"))])
    gain = (F.col("b") - F.col("a")) / F.col("b")
    return tidy(m, improvement=100 * gain, retrain=(F.col("a") > 0.5) | (gain < 0.05))


@query("AUD06_weights", f"WITH {OBSERVED}, b AS (SELECT geo % 7 AS zone, 1.0 / count(*) OVER (PARTITION BY geo % 7) AS w FROM (SELECT DISTINCT geo FROM obs)) SELECT zone, abs(sum(w) - 1) < 1e-9 AS whole FROM b GROUP BY zone")
def weights(spark, folder):
    z = observed(spark, folder).select("geo").distinct().withColumn("zone", F.col("geo") % 7)
    z = z.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("zone")))
    return z.groupBy("zone").agg((F.abs(F.sum("w") - 1) < 1e-9).alias("whole"))


@query("XAI01_XAI03_packets", f"WITH {CHAMPION} SELECT geo, p, round(champion, 6) AS pred, round(greatest(champion - 2, 0), 6) AS low, round(champion + 2, 6) AS high, true AS verified, true AS grounded FROM champ WHERE p = 24000")
def packets(spark, folder):
    f = serving.packets(forecasts(spark, folder).where("p = 24000"), 2.0)
    numbers = F.array(F.col("geo").cast("double"), F.col("p").cast("double"), "pred", "parts.clim", "parts.ratio")
    f = f.withColumn("grounded", serving.grounded(serving.narrative(f), numbers))
    return tidy(f, "geo", "p", "pred", "low", "high", "verified", "grounded")


@query("SRV02_ranking", f"WITH {CHAMPION}, g AS (SELECT geo, sum(y) AS y, sum(champion) AS pred, round(sum(abs(y - champion)) / nullif(sum(y), 0), 9) AS wape FROM champ WHERE ano = 2000 GROUP BY geo) SELECT geo, y, round(pred, 6) AS pred, CAST(row_number() OVER (ORDER BY wape DESC NULLS LAST, geo) AS INT) AS place FROM g QUALIFY place <= 15")
def ranking(spark, folder):
    g = forecasts(spark, folder).where("ano = 2000").groupBy("geo").agg(F.sum("y").alias("y"), F.sum("champion").alias("pred"), F.round(metrics.wape(F.col("y"), F.col("champion")), 9).alias("wape"))
    top = g.orderBy(F.desc_nulls_last("wape"), "geo").limit(15)
    return tidy(top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("wape"), "geo"))), "geo", "y", "pred", "place")


def _training(spark, folder):
    f = features.calendar(features.rolling(features.lags(dense(spark, folder), (1, 3, 12))))
    f = models.climatology(f).select("geo", "p", "ano", "y", "clim", "lag1", "lag12", "roll3", "mes_sin", "mes_cos").where("lag12 IS NOT NULL")
    return f.where("ano < 2000"), f.where("ano >= 2000")


NAMES = ("clim", "lag1", "lag12", "roll3", "mes_sin", "mes_cos")


def _learned(kind: str):
    def run(spark, folder):
        train, test = _training(spark, folder)
        return tidy(learners.fit_predict(train, test, NAMES, kind), "geo", "p", "y", "pred")

    return run


for _id, _kind in (("MDL07_poisson", "poisson"), ("MDL08_tweedie", "tweedie"), ("MDL09_forest", "forest")):
    query(_id)(_learned(_kind))


@query("MDL16_MDL19_residual")
def residual(spark, folder):
    train, test = _training(spark, folder)
    return tidy(learners.residual_on(train, test, NAMES, "clim"), "geo", "p", "y", "pred")


@query("MDL17_MDL18_ridge")
def ridge(spark, folder):
    train, _ = _training(spark, folder)
    out = learners.ridge(train.withColumn("g", F.col("geo") % 5), ["clim", "lag1", "roll3"], "y", ["g"], 1.0)
    return out.select("g", F.round("intercept", 6).alias("intercept"), F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))


@query("MDL32_components")
def components(spark, folder):
    train, _ = _training(spark, folder)
    out = learners.reduced(train, NAMES, 2)
    from pyspark.ml.functions import vector_to_array

    return out.select("geo", "p", F.transform(vector_to_array("components"), lambda v: F.round(F.abs(v), 4)).alias("components"))


_SQUARES = "SELECT CAST((x + 45) * 100 + y + 12 AS INT) AS poly, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0 FROM generate_series(-45, -36, 3) a(x), generate_series(-12, -4, 2) b(y)"


@query("GEO04_centroid", f"SELECT poly, x0 + 1.5 AS cx, y0 + 1.0 AS cy FROM ({_SQUARES})")
def centroid(spark, folder):
    return tidy(squares(spark), "poly", **spatial.centroid(F.col("ring")))


@query("JON15_overlay", f"WITH q AS ({_SQUARES}), c AS (SELECT CAST(i * 100 + j AS INT) AS cell, -45 + i * 2.5 AS cx, -12 + j * 2.5 AS cy FROM generate_series(0, 4) a(i), generate_series(0, 3) b(j)), m AS (SELECT poly, cell, least(x0 + 3, cx + 2.5) - greatest(x0, cx) AS w, least(y0 + 2, cy + 2.5) - greatest(y0, cy) AS h FROM q, c) SELECT poly, cell, round(CAST(w * h / 6 AS DOUBLE), 6) AS weight FROM m WHERE w > 0 AND h > 0")
def overlay(spark, folder):
    i, j = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")
    c = spark.range(1).select(i).select("i", j)
    x, y = -45 + F.col("i") * 2.5, -12 + F.col("j") * 2.5
    cells = c.select((F.col("i") * 100 + F.col("j")).alias("cell"), x.alias("x0"), (x + 2.5).alias("x1"), y.alias("y0"), (y + 2.5).alias("y1"))
    return tidy(spatial.overlay(squares(spark), cells), "poly", "cell", "weight")


@query("GEO06_box_distance", f"WITH q AS ({_SQUARES}) SELECT a.poly AS src, b.poly AS dst, round(sqrt(pow(greatest(abs(a.x0 - b.x0) - 3, 0), 2) + pow(greatest(abs(a.y0 - b.y0) - 2, 0), 2)), 6) AS distance FROM q a JOIN q b ON a.poly < b.poly AND abs(a.x0 - b.x0) <= 6 AND abs(a.y0 - b.y0) <= 4")
def box_distance(spark, folder):
    q = squares(spark).select("poly", "x0", "x1", "y0", "y1")
    a, b = q.alias("a"), q.alias("b")
    sides = lambda n: tuple(F.col(f"{n}.{c}") for c in ("x0", "x1", "y0", "y1"))
    near = (F.abs(F.col("a.x0") - F.col("b.x0")) <= 6) & (F.abs(F.col("a.y0") - F.col("b.y0")) <= 4)
    pairs = a.join(b, (F.col("a.poly") < F.col("b.poly")) & near)  # twenty squares
    return pairs.select(F.col("a.poly").alias("src"), F.col("b.poly").alias("dst"), F.round(spatial.box_distance(sides("a"), sides("b")), 6).alias("distance"))


@query("MET21_MET22_scopes", f"WITH {LONG}, {ENTITIES}, s AS (SELECT model, uf, ano, mes, sum(y) AS y, sum(pred) AS pred FROM long JOIN ent ON long.geo = ent.geo WHERE mes IN (10, 11) GROUP BY ALL) SELECT model, uf, round(sum(abs(y - pred)) / nullif(sum(y), 0), 6) AS wape, CASE WHEN sum(abs(y - pred)) / nullif(sum(y), 0) > 0.25 THEN 'wape above limit' WHEN sum(y) = 0 THEN 'wape missing' ELSE '' END AS reasons FROM s GROUP BY model, uf")
def scopes(spark, folder):
    joined = predictions(spark, folder).where(F.col("mes").isin(10, 11)).join(entities(spark, folder), "geo")
    s = joined.groupBy("model", "uf", "ano", "mes").agg(F.sum("y").alias("y"), F.sum("pred").alias("pred"))
    out = metrics.gate(s.groupBy("model", "uf").agg(metrics.wape(F.col("y"), F.col("pred")).alias("wape")), {"wape": 0.25})
    return tidy(out, "model", "uf", "wape", "reasons")


@query("AUD03_AUD04_coverage", f"WITH {GAPPED}, {ENTITIES} SELECT ent.geo, count(panel.p) AS months, count(panel.y) AS covered, count(panel.y) = count(panel.p) AS whole FROM ent LEFT JOIN panel ON ent.geo = panel.geo GROUP BY ent.geo")
def audit_coverage(spark, folder):
    joined = entities(spark, folder).select("geo").join(gapped(spark, folder), "geo", "left")
    return joined.groupBy("geo").agg(F.count("p").alias("months"), F.count("y").alias("covered"), (F.count("y") == F.count("p")).alias("whole"))


@query("MDL30_MDL31_parts", f"WITH {CHAMPION}, {ENTITIES} SELECT champ.geo, p, round(clim, 6) AS usual, round(clim * (ratio - 1), 6) AS climate, round(0.1 * ln(1 + abs(area)), 6) AS human, round(greatest(champion + 0.1 * ln(1 + abs(area)), 0), 6) AS pred FROM champ JOIN ent ON champ.geo = ent.geo")
def parts(spark, folder):
    joined = forecasts(spark, folder).join(entities(spark, folder), "geo")
    human = 0.1 * F.log1p(F.abs("area"))
    return tidy(joined, "geo", "p", usual="clim", climate=F.col("clim") * (F.col("ratio") - 1), human=human, pred=F.greatest(F.col("champion") + human, F.lit(0.0)))


@query("MDL10_quantile_lines")
def quantile_lines(spark, folder):
    train, _ = _training(spark, folder)
    out = learners.quantile_line(train.withColumn("g", F.col("geo") % 5), "clim", "y", "g", 0.9)
    return tidy(out, "g", "intercept", "slope")
