"""Queries of parsing, normalising, deduplicating and reshaping events and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import expressions as e
from panelforge.plans.registry import query, tidy
from panelforge.sources.tables import table
from panelforge.streaming import jobs

_FOLD = f"translate(lower({{}}), '{e.ACCENTED}', '{e.PLAIN}')"


_WHOLE = f"SELECT doc_id, trim(regexp_replace({_FOLD.format('text')}, '[\\s_''-]+', ' ', 'g')) AS name FROM documents"


@query("PRJ05_PRJ07_names", _WHOLE)
@query("PRJ05_PRJ07_whole_names", _WHOLE)
def names(spark, folder):
    """Whole texts stand in for messy names."""
    return table(spark, folder, "documents").select("doc_id", e.plain_name(F.col("text")).alias("name"))


@query("PRJ09_locale_numbers", "WITH n AS (SELECT s_suppkey AS k, replace(printf('%.1f', abs(round(s_acctbal, 1))), '.', ',') AS v FROM supplier) SELECT k, round(CAST(replace(v, ',', '.') AS DOUBLE), 6) AS number, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS other FROM n")
def locale_numbers(spark, folder):
    v = F.replace(F.format_string("%.1f", F.abs(F.round("s_acctbal", 1))), F.lit("."), F.lit(","))
    other = F.when(F.col("s_suppkey") % 3 == 0, F.lit("-9999")).otherwise(F.col("s_suppkey").cast("string"))
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.round(e.locale_number(v), 6).alias("number"), e.locale_number(other).alias("other"))


@query("PRJ34_XAI03_numeric_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS n FROM documents")
def tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(e.numeric_tokens(F.col("text"))).cast("long").alias("n"))


@query("PRJ31_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_fields(spark, folder):
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("PRJ11_PRJ14_times", "SELECT event_id, CAST(year(ts - INTERVAL 3 HOUR) AS INT) AS ano, CAST(month(ts - INTERVAL 3 HOUR) AS INT) AS mes, CAST(day(ts - INTERVAL 3 HOUR) AS INT) AS dia FROM events")
def times(spark, folder):
    """Written as text in two formats, parsed by whichever fits, then moved to local time."""
    t = table(spark, folder, "events").withColumn("raw", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    parsed = F.coalesce(F.try_to_timestamp("raw", F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp("raw", F.lit("yyyy-MM-dd HH:mm:ss")))
    local = parsed - F.expr("INTERVAL 3 HOURS")
    return t.select("event_id", F.year(local).alias("ano"), F.month(local).alias("mes"), F.dayofmonth(local).alias("dia"))


@query("PRJ19_PRJ20_regimes", "WITH x AS (SELECT s_suppkey AS k, s_acctbal / 5000 AS v FROM supplier) SELECT k, CASE WHEN v >= 0.5 THEN 'warm' WHEN v <= -0.5 THEN 'cold' ELSE 'neutral' END AS regime, CAST(trunc(least(greatest(50 + 40 * v, 5), 95)) AS INT) AS chance, round(0.6108 * exp(17.27 * (20 + v) / (20 + v + 237.3)), 6) AS pressure FROM x")
def regimes(spark, folder):
    v = F.col("s_acctbal") / 5000
    return tidy(
        table(spark, folder, "supplier"),
        k="s_suppkey",
        regime=F.when(v >= 0.5, "warm").when(v <= -0.5, "cold").otherwise("neutral"),
        chance=e.clip(50 + 40 * v, 5.0, 95.0).cast("int"),
        pressure=e.saturation_pressure_kpa(20 + v),
    )


@query("PRJ21_PRJ23_ratios", "SELECT p_partkey AS k, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 6) AS relative, round(ln(1 + p_size), 6) AS logged, round(p_retailprice / greatest(p_size, 1e-6), 6) AS density FROM part")
def ratios(spark, folder):
    t = table(spark, folder, "part")
    top = t.agg(F.max("p_retailprice").alias("top"))
    return tidy(t.crossJoin(top), k="p_partkey", relative=F.col("p_retailprice") / F.col("top"), logged=F.log1p("p_size"), density=F.col("p_retailprice") / F.greatest(F.col("p_size").cast("double"), F.lit(1e-6)))


@query("SET02_SET06_dedup", "WITH d AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 5 = 0) SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type, ts FROM d) GROUP BY ALL")
def dedup(spark, folder):
    t = table(spark, folder, "events")
    twice = t.unionByName(t.where("event_id % 5 = 0"))
    return twice.dropDuplicates(["event_id", "ts"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SET03_SET04_rounded", "SELECT DISTINCT l_suppkey AS geo, round(l_extendedprice / 1000, 1) AS lat, round(l_discount, 1) AS lon FROM lineitem")
def rounded(spark, folder):
    t = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("geo"), F.round(F.col("l_extendedprice") / 1000, 1).alias("lat"), F.round("l_discount", 1).alias("lon"))
    return t.dropDuplicates(["geo", "lat", "lon"])


@query("SET07_SET08_sets", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def sets(spark, folder):
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    both = o.select("o_custkey").intersect(c.where("c_acctbal > 0").select("c_custkey")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("kind"), "n")
    only = c.select("c_custkey").subtract(o.select("o_custkey")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("only").alias("kind"), "n")
    return both.unionByName(only)


@query("AGG23_pivot", "SELECT l_suppkey AS geo, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0.0) AS A, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0.0) AS N, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0.0) AS R FROM lineitem GROUP BY l_suppkey")
def pivot(spark, folder):
    return table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("geo")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).na.fill(0.0)


@query("AGG26_unpivot", "SELECT k, name, v FROM (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR name IN (size, price))")
def unpivot(spark, folder):
    t = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return t.unpivot(["k"], ["size", "price"], "name", "v")


@query("AGG08_AGG11_daily", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL) SELECT user_id, round(sum(s), 6) AS total, max(n) AS busiest, count(*) AS days, round(count(*) / 31.0, 6) AS observed FROM d GROUP BY user_id")
def daily(spark, folder):
    d = table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return tidy(d.groupBy("user_id").agg(F.sum("s").alias("total"), F.max("n").alias("busiest"), F.count(F.lit(1)).alias("days"), (F.count(F.lit(1)) / 31).alias("observed")), "user_id", "total", "busiest", "days", "observed")


@query("JON08_JON22_lookup", "SELECT s_suppkey AS k, coalesce(n_name, 'none') AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup(spark, folder):
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    out = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"], "left").join(F.broadcast(r), F.col("n_regionkey") == r["r_regionkey"], "left")  # 25 and 5 rows at any scale
    return out.select(F.col("s_suppkey").alias("k"), F.coalesce("n_name", F.lit("none")).alias("nation"), F.col("r_name").alias("region"))


@query("MET06_brier", "SELECT toxic, count(*) AS n, round(avg(pow(least(n_chars / 5000.0, 1.0) - quality, 2)), 6) AS brier FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY toxic")
def brier(spark, folder):
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    score = F.least(F.col("n_chars") / 5000, F.lit(1.0))
    return tidy(joined.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(score - F.col("quality"), 2)).alias("brier")), "toxic", "n", "brier")


@query("WIN26_WIN27_latest", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) <= 2")
def latest(spark, folder):
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role"))
    return table(spark, folder, "conversations").withColumn("r", last).where("r <= 2").select("conv_id", "turn", "role")


@query("STR06_stream_months", "SELECT CAST(year(ts) AS INT) AS ano, CAST(month(ts) AS INT) AS mes, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_months(spark, folder):
    return jobs.run_complete(jobs.monthly(jobs.event_stream(spark, f"{folder}/events.parquet")), "months")


@query("STR06_stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, folder):
    rows = jobs.run_append(jobs.distinct(jobs.event_stream(spark, f"{folder}/events.parquet")), "distinct_events")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("STR06_stream_windows", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_windows(spark, folder):
    out = jobs.run_complete(jobs.tumbling(jobs.event_stream(spark, f"{folder}/events.parquet"), "1 day"), "days")
    return out.select(F.to_date("window.start").alias("day"), "n", F.round("total", 4).alias("total"))
