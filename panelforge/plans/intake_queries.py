"""Queries of intake and selection: vendor formats, symbolic values, filters, joins to observations, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import expressions as e
from panelforge.operators import intake, spatial
from panelforge.operators.quantiles import wide
from panelforge.plans.common_sql import CHAMPION, ENTITIES, EVENTS, OBSERVED, PANEL
from panelforge.plans.evaluation_queries import forecasts
from panelforge.plans.panel_queries import dense
from panelforge.plans.registry import query, tidy
from panelforge.sources.tables import entities, point_events, table

_STATES = "regexp_replace(trim(regexp_replace(replace(translate(lower({}), 'áàâãéêíóôõúç', 'aaaaeeiooouc'), '''', ''), '[_\\s-]+', ' ', 'g')), ' (fr|de)$', '')"


@query("PRJ05_suffix_alias", f"WITH n AS (SELECT c_custkey AS k, {_STATES.format('c_name || CASE c_custkey % 4 WHEN 0 THEN $$_FR$$ WHEN 1 THEN $$ - De$$ WHEN 2 THEN $$ d''Água$$ ELSE $$$$ END')} AS name FROM customer) SELECT k, CASE name WHEN 'customer#000000003' THEN 'customer three' ELSE name END AS name FROM n")
def suffix_alias(spark, folder):
    """Customer names with a state's suffix or an apostrophe added."""
    tail = F.element_at(F.array(F.lit("_FR"), F.lit(" - De"), F.lit(" d'Água"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    name = intake.entity_name(F.concat("c_name", tail), ("fr", "de"), {"customer#000000003": "customer three"})
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), name.alias("name"))


_A = "SELECT event_id AS id, ts AS time_utc, 'S' || (user_id % 3) AS satellite, try_cast(value AS DOUBLE) AS power, 'a.csv' AS source_file, ts - INTERVAL 3 HOUR AS local FROM events WHERE event_id % 2 = 0"
_B = "SELECT event_id AS id, NULL AS time_utc, 'UNKNOWN' AS satellite, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS power, 'b.csv' AS source_file, date_trunc('minute', ts) AS local FROM events WHERE event_id % 2 = 1"


@query("PRJ01_PRJ04_vendor_formats", f"SELECT id, CAST(time_utc AS TIMESTAMP) AS time_utc, satellite, round(power, 6) AS power, source_file, CAST(year(local) AS INT) AS ano, CAST(month(local) AS INT) AS mes FROM ({_A} UNION ALL {_B})")
def vendor_formats(spark, folder):
    """Events written in two formats with untrimmed headers, read into one schema. The second has local times, day first, and no satellite."""
    ev = table(spark, folder, "events")
    a = ev.where("event_id % 2 = 0").select(F.col("event_id").alias(" Id"), F.col("ts").cast("string").alias("Data / Hora "), F.concat(F.lit(" S"), F.col("user_id") % 3).alias("SATELITE"), F.col("value").cast("string").alias("FRP"))
    power = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    b = ev.where("event_id % 2 = 1").select(F.col("event_id").alias("ID"), F.date_format("ts", "dd/MM/yyyy HH:mm").alias("DataHora"), power.alias(" frp"))
    out = intake.first_format(a, "a.csv").unionByName(intake.second_format(b, "b.csv"))
    return tidy(out, "id", "time_utc", "satellite", "power", "source_file", "ano", "mes")


@query("PRJ10_symbolic_values", "SELECT k, round(CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 3 THEN 1000.0 * k + 0.5 WHEN 4 THEN NULL ELSE k END, 6) AS v FROM (SELECT p_partkey AS k FROM part)")
def symbolic(spark, folder):
    """Nothing, dashes and X are 0; other text that is no number is missing; blanks inside numbers go."""
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 1, " - ").when(k % 6 == 2, "X").when(k % 6 == 3, F.concat(k.cast("string"), F.lit(" 000,5"))).when(k % 6 == 4, "abc").when(k % 6 == 5, k.cast("string"))
    return tidy(table(spark, folder, "part").select(k.alias("k"), intake.symbolic_value(raw).alias("v")), "k", "v")


@query("PRJ13_hour_minute_times", "SELECT event_id, date_trunc('minute', ts) AS time_utc, CAST(year(ts - INTERVAL 3 HOUR) AS INT) AS ano, CAST(month(ts - INTERVAL 3 HOUR) AS INT) AS mes, CAST(day(ts - INTERVAL 3 HOUR) AS INT) AS dia FROM events")
def hour_minute(spark, folder):
    """Dates with times as whole numbers such as 905; a row that is no time fails the job."""
    ev = table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), (F.hour("ts") * 100 + F.minute("ts")).cast("string").alias("acq_time"))
    return intake.acquired(ev).select("event_id", "time_utc", "ano", "mes", "dia")


@query("PRJ24_confidence", "SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_linenumber % 4 = 0 THEN 30.0 WHEN l_linenumber % 4 = 1 THEN 60.0 WHEN l_linenumber % 4 = 2 THEN CAST(l_linenumber * 10 AS DOUBLE) END AS confidence, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, l_tax) AS proxy FROM lineitem")
def confidence(spark, folder):
    i = F.col("l_linenumber")
    raw = F.when(i % 4 == 0, "L").when(i % 4 == 1, "n").when(i % 4 == 2, (i * 10).cast("string")).otherwise("?")
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), i.alias("i"), intake.confidence(raw).alias("confidence"), F.coalesce(F.when(i % 2 == 0, F.col("l_quantity")), F.col("l_tax")).alias("proxy"))


@query("PRJ27_PAN01_provenance", "SELECT CAST(1992 + k % 7 AS INT) AS ano, count(*) AS files, max(k % 12 + 1) AS last_month FROM (SELECT o_custkey AS k FROM orders) GROUP BY 1")
def provenance(spark, folder):
    """Archive and year out of names such as a.zip:points_1995_3.csv, and the last month of each as its export cap."""
    k = F.col("o_custkey")
    name = F.concat(F.lit("a.zip:points_"), 1992 + k % 7, F.lit("_"), k % 12 + 1, F.lit(".csv"))
    member = F.element_at(F.split(name, ":", 2), 2)
    rows = table(spark, folder, "orders").select(F.regexp_extract(member, r"_(\d{4})_\d+\.csv$", 1).cast("int").alias("ano"), F.regexp_extract(member, r"_(\d+)\.csv$", 1).cast("long").alias("mes"))
    return rows.groupBy("ano").agg(F.count(F.lit(1)).alias("files"), F.max("mes").alias("last_month"))


@query("PRJ32_PRJ33_columns", "SELECT c_custkey AS k, c_acctbal AS balance, 'customer' AS source FROM customer")
def merged_columns(spark, folder):
    """Columns that a merge has doubled go; a column's source is told by what its name holds."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_acctbal").alias("balance_y"))
    return intake.without_suffixes(c, ("_x", "_y")).withColumn("source", F.lit(intake.source_of("c_acctbal", {"c_": "customer", "s_": "supplier"})))


@query("FLT01_valid", f"WITH {EVENTS} SELECT geo, count(*) AS n FROM ev WHERE geo IS NOT NULL AND frp > 0 AND risk BETWEEN 0 AND 45 GROUP BY geo")
def valid(spark, folder):
    return point_events(spark, folder).where("geo IS NOT NULL AND frp > 0 AND risk BETWEEN 0 AND 45").groupBy("geo").agg(F.count(F.lit(1)).alias("n"))


@query("FLT02_member", f"WITH {EVENTS}, {ENTITIES} SELECT geo, count(*) AS n FROM ev WHERE geo IN (SELECT geo FROM ent WHERE uf = 2) GROUP BY geo")
def member(spark, folder):
    wanted = entities(spark, folder).where("uf = 2").select("geo")
    return point_events(spark, folder).join(wanted, "geo", "left_semi").groupBy("geo").agg(F.count(F.lit(1)).alias("n"))


@query("FLT03_season_range", f"WITH {EVENTS} SELECT ano, mes, count(*) AS n FROM ev WHERE ano BETWEEN 1993 AND 1996 AND mes IN (10, 11) GROUP BY ano, mes")
def season_range(spark, folder):
    return point_events(spark, folder).where(F.col("ano").between(1993, 1996) & F.col("mes").isin(10, 11)).groupBy("ano", "mes").agg(F.count(F.lit(1)).alias("n"))


@query("FLT04_as_of", f"WITH {OBSERVED} SELECT geo, sum(CASE WHEN p < 23960 THEN y ELSE 0 END) AS before, sum(CASE WHEN p = 23960 THEN y ELSE 0 END) AS at FROM obs WHERE p <= 23960 GROUP BY geo")
def as_of(spark, folder):
    p, one = F.col("p"), F.lit(1.0)
    rows = point_events(spark, folder).where(p <= 23960)
    return rows.groupBy("geo").agg(F.sum(F.when(p < 23960, one).otherwise(0.0)).alias("before"), F.sum(F.when(p == 23960, one).otherwise(0.0)).alias("at"))


@query("FLT05_enough_months", f"WITH {OBSERVED} SELECT geo, p FROM obs QUALIFY count(y) OVER (PARTITION BY geo ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 12")
def enough_months(spark, folder):
    obs = point_events(spark, folder).groupBy("geo", "p").agg(F.count(F.lit(1)).alias("y"))
    return obs.withColumn("n", F.count("y").over(e.history("geo"))).where("n >= 12").select("geo", "p")


@query("FLT06_scope", f"WITH {ENTITIES} SELECT geo, 'region' AS scope FROM ent WHERE uf = 1 UNION ALL SELECT geo, 'weights' FROM ent WHERE area > 5000")
def scopes(spark, folder):
    ent = entities(spark, folder)
    return ent.select("geo", F.explode(F.array_compact(F.array(F.when(F.col("uf") == 1, "region"), F.when(F.col("area") > 5000, "weights")))).alias("scope"))


@query("FLT07_sensor", f"WITH {EVENTS} SELECT geo, p, count(*) AS y FROM ev WHERE sensor = 'R' GROUP BY geo, p")
def one_sensor(spark, folder):
    return intake.of_sensor(point_events(spark, folder), "R").groupBy("geo", "p").agg(F.count(F.lit(1)).alias("y"))


@query("FLT08_train_end", f"WITH {PANEL} SELECT geo, sum(y) AS y, count(*) AS months FROM panel WHERE p <= 23952 GROUP BY geo")
def train_end(spark, folder):
    return dense(spark, folder).where("p <= 23952").groupBy("geo").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("months"))


@query("FLT09_region_holdout", f"WITH {OBSERVED}, {ENTITIES} SELECT h.uf AS held, CAST(sum(CASE WHEN e.uf = h.uf THEN y END) AS DOUBLE) AS test_y, CAST(sum(CASE WHEN e.uf <> h.uf THEN y END) AS DOUBLE) AS train_y FROM (SELECT DISTINCT uf FROM ent) h, obs JOIN ent e ON obs.geo = e.geo GROUP BY h.uf")
def region_holdout(spark, folder):
    """Every region in turn is held out: sums by region first, so the pairs are of a few regions."""
    by = point_events(spark, folder).groupBy("geo").agg(F.count(F.lit(1)).cast("double").alias("y")).join(entities(spark, folder), "geo").groupBy("uf").agg(F.sum("y").alias("test_y"))
    total = by.agg(F.sum("test_y").alias("total"))
    return by.crossJoin(F.broadcast(total)).select(F.col("uf").alias("held"), "test_y", F.when(F.col("total") > F.col("test_y"), F.col("total") - F.col("test_y")).alias("train_y"))  # one row


@query("FLT10_observed_floor", f"WITH {EVENTS} SELECT geo, CASE WHEN count(DISTINCT p) / 84.0 >= 0.5 THEN round(avg(frp), 6) END AS frp, CASE WHEN count(DISTINCT p) / 84.0 >= 0.9 THEN round(avg(risk), 6) END AS risk FROM ev GROUP BY geo")
def observed_floor(spark, folder):
    months = point_events(spark, folder).groupBy("geo", "p").agg(F.sum("frp").alias("frp"), F.sum("risk").alias("risk"), F.count(F.lit(1)).alias("n"))
    out = months.groupBy("geo").agg((F.count(F.lit(1)) / 84).alias("seen"), (F.sum("frp") / F.sum("n")).alias("frp"), (F.sum("risk") / F.sum("n")).alias("risk"))
    return tidy(out, "geo", frp=F.when(F.col("seen") >= 0.5, F.col("frp")), risk=F.when(F.col("seen") >= 0.9, F.col("risk")))


_J24 = f"WITH {OBSERVED}, {ENTITIES}, f AS (SELECT geo, p FROM ent, (SELECT unnest(generate_series(23940, 23942)) AS p)), j AS (SELECT f.geo, f.p, o.y FROM f LEFT JOIN obs o ON f.geo = o.geo AND f.p = o.p)"


@query("JON24_delayed_observed", _J24 + " SELECT 'events' AS target, count(*) AS valid, CAST(0 AS BIGINT) AS missing, sum(coalesce(y, 0.0)) AS y FROM j UNION ALL SELECT 'panel', count(y), count(*) - count(y), sum(y) FROM j")
def delayed_observed(spark, folder):
    """Forecasts meet what was observed later: no event is 0 for event targets, missing for others."""
    ahead = entities(spark, folder).select("geo", F.explode(F.sequence(F.lit(23940), F.lit(23942))).alias("p"))
    seen = point_events(spark, folder).groupBy("geo", "p").agg(F.count(F.lit(1)).cast("double").alias("y"))
    return intake.scored_against(ahead, seen, True, "events").unionByName(intake.scored_against(ahead, seen, False, "panel"))


@query("AGG05_discovered", "SELECT l_returnflag AS sensor, count(*) AS n, round(avg(l_discount), 6) AS l_discount_mean, round(max(l_discount), 6) AS l_discount_max, round(avg(l_tax), 6) AS l_tax_mean, round(max(l_tax), 6) AS l_tax_max FROM lineitem GROUP BY 1")
def discovered(spark, folder):
    """Means and maxima of whatever columns of a list the table has."""
    rows = table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "sensor")
    return intake.aggregated(rows, "sensor", ("l_discount", "l_tax", "frp_not_there"))


@query("AGG25_unstacked_years", f"WITH {OBSERVED}, a AS (SELECT geo, ano, sum(y) AS y FROM obs GROUP BY geo, ano) SELECT geo, " + ", ".join(f"coalesce(sum(y) FILTER (ano = {a}), 0.0) AS y{a}" for a in range(1995, 2002)) + " FROM a GROUP BY geo")
def unstacked(spark, folder):
    """A column for each year that the events have."""
    wide = point_events(spark, folder).withColumn("year", F.concat(F.lit("y"), "ano")).groupBy("geo").pivot("year").agg(F.count(F.lit(1)).cast("double"))
    return wide.na.fill(0.0)


@query("WIN25_top_weights", f"WITH {ENTITIES}, w AS (SELECT a.geo AS a, b.geo AS b, exp(-0.5 * sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2))) AS w FROM ent a JOIN ent b ON a.uf = b.uf AND a.geo <> b.geo), k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 5) SELECT a, b, round(w / (sum(w) OVER (PARTITION BY a) + 1e-6), 6) AS w FROM k")
def top_weights(spark, folder):
    """The five strongest weights of each entity within its region, shared out to 1; equal weights go by key."""
    weight = lambda distance: F.exp(-0.5 * distance)
    near = spatial.nearest(entities(spark, folder).select("geo", "uf", "lat", "lon"), 5, ["uf"], sphere=False, order=lambda d: -weight(d))
    return tidy(intake.row_normalised(near.select(F.col("src").alias("a"), F.col("dst").alias("b"), weight(F.col("distance")).alias("w")), 5), "a", "b", "w")


@query("SRT08_audit_sample", "SELECT o_orderkey AS k, o_totalprice AS total FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 50")
def audit_sample(spark, folder):
    """A bounded sample by a hash of key and seed, the same on every run."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    return o.orderBy(F.md5(F.concat(F.col("k").cast("string"), F.lit(":42"))), "k").limit(50)


@query("SET09_prediction_blocks", f"WITH {CHAMPION} SELECT geo, p, round(champion, 6) AS prediction, 'champion' AS model FROM champ UNION ALL SELECT geo, p, round(naive, 6), 'naive' FROM champ WHERE p >= 23960")
def blocks_of_predictions(spark, folder):
    rows = forecasts(spark, folder)
    return tidy(intake.prediction_blocks({"champion": rows.select("geo", "p", F.col("champion").alias("prediction")), "naive": rows.where("p >= 23960").select("geo", "p", F.col("naive").alias("prediction"))}), "geo", "p", "prediction", "model")


_STRENGTH = "WITH t AS (SELECT l_suppkey AS geo, greatest(l_extendedprice, 0) AS frp, l_discount AS risk FROM lineitem), s AS (SELECT median(ln(1 + frp)) FILTER (frp > 0) AS scale FROM t)"


@query("GEO10_MDL26_strength", _STRENGTH + " SELECT geo, round(sum(1.0), 4) AS count_score, round(sum(least(greatest(1 + ln(1 + frp) / scale, 1), 6)), 4) AS frp_score, round(sum(least(greatest(1 + ln(1 + frp) / scale, 1), 6) * least(greatest(0.5 + least(greatest(risk, 0), 1), 0.5), 1.5)), 4) AS frp_risk_score FROM t, s GROUP BY geo")
def strengths(spark, folder):
    """Scores of entities by three strengths of their events: number, magnitude over its median, and that by risk."""
    ev = point_events(spark, folder).select("geo", "frp", F.col("dry").alias("risk"))
    out = ev.crossJoin(F.broadcast(intake.magnitude_scale(ev)))  # one row
    modes = {m: F.sum(intake.strength(m)) for m in ("count", "frp", "frp_risk")}
    out = out.groupBy("geo").agg(*[s.alias(f"{m}_score") for m, s in modes.items()])
    return out.select("geo", *[F.round(f"{m}_score", 4).alias(f"{m}_score") for m in modes])


@query("UNC06_residual_quantiles", f"WITH {CHAMPION}, r AS (SELECT mes, abs(y - champion) AS e FROM champ) SELECT 'global' AS regime, round(quantile_cont(e, 0.8), 6) AS q80, round(quantile_cont(e, 0.95), 6) AS q95 FROM r UNION ALL SELECT 'critical', round(quantile_cont(e, 0.8), 6), round(quantile_cont(e, 0.95), 6) FROM r WHERE mes IN (10, 11) HAVING count(*) > 10")
def residual_quantiles(spark, folder):
    return tidy(intake.regime_quantiles(forecasts(spark, folder)), "regime", "q80", "q95")


@query("MET28_slice_wins", f"WITH {CHAMPION} SELECT mes, count(*) AS n, round(sum(abs(y - champion)) - sum(abs(y - naive)), 6) AS delta, round(avg(CASE WHEN abs(y - champion) < abs(y - naive) THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM champ GROUP BY mes")
def slice_wins(spark, folder):
    a, b = (F.abs(F.col("y") - F.col(c)) for c in ("champion", "naive"))
    return tidy(forecasts(spark, folder).groupBy("mes").agg(F.count(F.lit(1)).alias("n"), (F.sum(a) - F.sum(b)).alias("delta"), F.avg((a < b).cast("double")).alias("win_rate")), "mes", "n", "delta", "win_rate")


@query("ADD02_evidence", f"WITH {CHAMPION}, r AS (SELECT p, y, abs(y - champion) AS e FROM champ), l AS (SELECT max(p) AS last FROM r) SELECT count(*) AS n, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.9), 6) AS p90, round(quantile_cont(e, 0.95), 6) AS p95, round(sum(e) / sum(y), 6) AS wape, round(sum(e) FILTER (p > last - 12) / sum(y) FILTER (p > last - 12), 6) AS wape12 FROM r, l")
def evidence(spark, folder):
    rows = forecasts(spark, folder).withColumn("e", F.abs(F.col("y") - F.col("champion")))
    late = F.col("p") > F.col("last") - 12
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("p").alias("last"))))  # one row
    out = rows.agg(F.count(F.lit(1)).alias("n"), e.share(F.sum("e"), F.sum("y")).alias("wape"), e.share(F.sum(F.when(late, F.col("e"))), F.sum(F.when(late, F.col("y")))).alias("wape12"))
    q = wide(rows, "e", [], {"p50": 0.5, "p90": 0.9, "p95": 0.95}).drop("n")
    return tidy(out.crossJoin(F.broadcast(q)), "n", "wape", "wape12", "p50", "p90", "p95")  # one row


@query("ADD01_temporal_holdout", f"WITH {PANEL}, m AS (SELECT geo, mes, avg(y) AS c FROM panel WHERE ano <= 1996 GROUP BY geo, mes) SELECT p.ano, count(*) AS n, round(sum(abs(y - coalesce(c, 0))) / sum(y), 6) AS wape FROM panel p LEFT JOIN m ON p.geo = m.geo AND p.mes = m.mes WHERE p.ano > 1996 GROUP BY p.ano")
def temporal_holdout(spark, folder):
    """Trained to 1996, tested on the years after: one climatology for all of them."""
    rows = dense(spark, folder)
    past = rows.where("ano <= 1996").groupBy("geo", "mes").agg(F.avg("y").alias("c"))
    test = rows.where("ano > 1996").join(past, ["geo", "mes"], "left")
    error = F.abs(F.col("y") - F.coalesce("c", F.lit(0.0)))
    return tidy(test.groupBy("ano").agg(F.count(F.lit(1)).alias("n"), e.share(F.sum(error), F.sum("y")).alias("wape")), "ano", "n", "wape")


@query("ADD07_period_bounds", f"WITH {OBSERVED} SELECT geo, printf('%04d-%02d', (min(p) - 1) // 12, (min(p) - 1) % 12 + 1) AS first, printf('%04d-%02d', (max(p) - 1) // 12, (max(p) - 1) % 12 + 1) AS last FROM obs GROUP BY geo")
def period_bounds(spark, folder):
    label = lambda p: F.format_string("%04d-%02d", F.floor((p - 1) / 12).cast("int"), ((p - 1) % 12 + 1).cast("int"))
    return point_events(spark, folder).groupBy("geo").agg(label(F.min("p")).alias("first"), label(F.max("p")).alias("last"))


@query("ADD10_drying", "WITH m AS (SELECT user_id, CAST(month(ts) AS INT) AS mes, sum(value) AS rain, max(value) AS heat FROM events GROUP BY ALL), t AS (SELECT max(rain) AS a, max(heat) AS b FROM m) SELECT user_id, mes, CAST(rain < 20 AS INT) AS dry_month, round((rain / (a + 1e-6) + heat / (b + 1e-6)) / 2, 6) AS drying FROM m, t")
def drying(spark, folder):
    m = table(spark, folder, "events").groupBy("user_id", F.month("ts").alias("mes")).agg(F.sum("value").alias("rain"), F.max("value").alias("heat"))
    top = F.broadcast(m.agg(F.max("rain").alias("a"), F.max("heat").alias("b")))  # one row
    index = (F.col("rain") / (F.col("a") + 1e-6) + F.col("heat") / (F.col("b") + 1e-6)) / 2
    return m.crossJoin(top).select("user_id", "mes", (F.col("rain") < 20).cast("int").alias("dry_month"), F.round(index, 6).alias("drying"))


@query("GEO03_discovered_places", f"WITH {ENTITIES}, t AS (SELECT lat, lon FROM ent WHERE geo % 25 = 0), d AS (SELECT e.geo, min(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(t.lat - e.lat) / 2), 2) + cos(radians(e.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - e.lon) / 2), 2))))) AS km FROM ent e, t GROUP BY e.geo) SELECT geo, round(km, 4) AS km FROM d WHERE km <= 250")
def discovered_places(spark, folder):
    """Places within 250 km of some target point, by cells of three degrees and their neighbours."""
    ent = entities(spark, folder).select("geo", "lat", "lon")
    return intake.within(ent, ent.where("geo % 25 = 0"), 250.0, 3.0).select("geo", F.round("km", 4).alias("km"))
