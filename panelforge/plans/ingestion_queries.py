"""Queries of archives, GeoJSON, projection, whole vendor schemas, name maps, ingestion with its report, and report audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.projection import BRAZIL
from panelforge.operators import ingestion, metrics, reports, spatial
from panelforge.plans.common_sql import CHAMPION, ENTITIES
from panelforge.plans.evaluation_queries import LONG, predictions
from panelforge.plans.registry import query, tidy
from panelforge.sources import archives, geojson, readers
from panelforge.sources.tables import entities, new_folder, point_events, table

_VENDORS = """SELECT CASE WHEN a THEN date_trunc('second', ts) END AS time_utc, CASE WHEN a THEN 'S' || (user_id % 3) ELSE 'UNKNOWN' END AS satellite, CASE WHEN a THEN 'Ceará' ELSE 'PIAUÍ' END AS state_name,
 'Vila ' || user_id AS municipality_raw, CASE WHEN NOT a THEN 'Caatinga' END AS biome, CAST(user_id % 7 AS DOUBLE) AS dry_days, CASE WHEN a AND user_id % 2 = 0 THEN 1.5 END AS rain, CASE WHEN a THEN value / 100 ELSE 0.5 END AS risk,
 user_id / 10 AS lat, CAST(user_id % 90 AS DOUBLE) AS lon, CASE WHEN a THEN CAST(value AS DOUBLE) END AS frp, CASE WHEN a THEN 'a.csv' ELSE 'b.csv' END AS source_file,
 CASE WHEN a THEN ts - INTERVAL 3 HOUR ELSE ts END AS local FROM (SELECT *, event_id % 2 = 0 AS a FROM events)"""


@query("PRJ04_whole_schema", f"SELECT CAST(time_utc AS TIMESTAMP) AS time_utc, satellite, state_name, municipality_raw, biome, dry_days, CAST(rain AS DOUBLE) AS rain, round(CAST(risk AS DOUBLE), 6) AS risk, round(CAST(lat AS DOUBLE), 6) AS lat, lon, frp, source_file, CAST(year(local) AS INT) AS ano, CAST(month(local) AS INT) AS mes, strftime(local, '%Y-%m-%d') AS event_date FROM ({_VENDORS})")
def whole_schema(spark, folder):
    """Events written as two vendors write them, with other names, marks and formats, as canonical events."""
    ev, text = table(spark, folder, "events"), lambda c: c.cast("string")
    user, value = F.col("user_id"), F.col("value")
    both = [F.concat(F.lit("Vila "), user).alias(" MUNICIPIO "), text(user / 10).alias("Latitude"), text(user % 90).alias("LONGITUDE")]
    a = ev.where("event_id % 2 = 0").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Data / Hora "), F.concat(F.lit(" S"), user % 3).alias("Satélite"), F.lit(" Ceará").alias("Estado"), *both, text(user % 7).alias("N. Dias Sem Chuva"), F.when(user % 2 == 0, "1.5").otherwise("n/a").alias("Precipitacao"), text(value / 100).alias("Risco Fogo"), text(value).alias("FRP"))
    b = ev.where("event_id % 2 = 1").select(F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("DataHora"), F.lit("PIAUÍ").alias("estado"), *both, text(user % 7).alias("DiaSemChuva"), F.lit("0.5").alias("RiscoFogo"), F.lit("Caatinga").alias("Bioma"))
    out = ingestion.first_vendor(a, F.lit("a.csv")).unionByName(ingestion.second_vendor(b, F.lit("b.csv")))
    return tidy(out, *out.columns)


def places(spark, folder):
    """A lookup, in lines of JSON, of the suppliers as places of three regions, read back."""
    path = new_folder(spark, "places")
    k = F.col("s_suppkey")
    uf = F.element_at(F.array(*map(F.lit, ("CE", "PE", "PI"))), (k % 3 + 1).cast("int"))
    table(spark, folder, "supplier").select((k + 1000).alias("geocodigo"), F.concat(F.lit("Vila do Açu-"), k).alias("nome"), uf.alias("uf")).write.json(path)
    return ingestion.lookup(spark, path, lines=True)


def _named(spark, folder):
    """Events of suppliers with a region's and a place's name; the first of each order says its place by its archive member only."""
    k, first = F.col("l_suppkey"), F.col("l_linenumber") == 1
    state = F.element_at(F.array(*map(F.lit, ("Ceará", "PERNAMBUCO", "Piauí"))), (k % 3 + 1).cast("int"))
    member = F.when(k % 2 == 0, F.concat(F.lit("m/Vila_do Acu "), k, F.lit("/2020.csv"))).otherwise(F.concat(F.lit("vila do açu_"), k, F.lit("_2020_01.csv")))
    name = F.when(~first, F.concat(F.lit("VILA DO AÇU "), k)).when(k % 5 == 0, F.lit(" "))
    return table(spark, folder, "lineitem").select(state.alias("state_name"), name.alias("municipality_raw"), F.concat(F.lit("x.zip:"), member).alias("source_file"), F.col("l_extendedprice").alias("frp"))


@query("ADD04_SRC09_name_map", "SELECT l_suppkey + 1000 AS geo, CASE l_suppkey % 3 WHEN 0 THEN 'CE' WHEN 1 THEN 'PE' ELSE 'PI' END AS uf, 'Vila do Açu-' || l_suppkey AS name, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def name_map(spark, folder):
    return ingestion.mapped(_named(spark, folder), places(spark, folder)).groupBy("geo", "uf", "name").agg(F.count(F.lit(1)).alias("n"))


@query("ADD09_coordinates", f"WITH {ENTITIES} SELECT geo + 1000 AS geo, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ent")
def coordinates(spark, folder):
    """Places get coordinates that another table has under names in other letters."""
    points = entities(spark, folder).select(F.concat(F.lit("  VILA_DO AÇU "), "geo").alias("name"), "lat", "lon")
    return tidy(ingestion.located(places(spark, folder).select("geo", "name"), points), "geo", "lat", "lon")


_INGESTED = """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS i, l_suppkey AS geo, l_suppkey % 3 AS uf, CAST(year(l_shipdate) AS INT) AS ano, CAST(month(l_shipdate) AS INT) AS mes, l_extendedprice AS frp FROM lineitem),
 m AS (SELECT DISTINCT geo, uf, ano, mes FROM r)
 SELECT (SELECT count(*) FROM r WHERE i <= 4) AS read_local, (SELECT count(*) FROM r WHERE i >= 3) AS read_api, (SELECT count(*) FROM r WHERE i <= 4) + (SELECT count(*) FROM r WHERE i >= 3) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS repeats, count(*) AS rows, CAST(7 AS INT) AS columns,
 min(ano) || '-' || lpad(CAST(min(mes) AS VARCHAR), 2, '0') AS date_min, max(ano) || '-' || lpad(CAST(max(mes) AS VARCHAR), 2, '0') AS date_max,
 printf('%d-%02d', (min(ano * 12 + mes) - 1) // 12, (min(ano * 12 + mes) - 1) % 12 + 1) AS first, printf('%d-%02d', (max(ano * 12 + mes) - 1) // 12, (max(ano * 12 + mes) - 1) % 12 + 1) AS last, count(DISTINCT geo) AS entities, CAST(count(DISTINCT uf) AS INT) AS regions FROM m"""


def hybrid(spark, folder):
    """Line items as events of a local and a service's source, which overlap in lines 3 and 4 of orders."""
    t = table(spark, folder, "lineitem")
    rows = t.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("geo"), (F.col("l_suppkey") % 3).alias("uf"), F.year("l_shipdate").alias("ano"), F.month("l_shipdate").alias("mes"), F.col("l_extendedprice").alias("frp"))
    return ingestion.Ingestion("hybrid", {"local": rows.where("l_linenumber <= 4"), "api": rows.where("l_linenumber >= 3")}, rows.columns)


@query("ADD06_ingestion_report", _INGESTED)
def ingestion_report(spark, folder):
    job = hybrid(spark, folder)
    job.write(new_folder(spark, "months"))
    return job.report(spark).drop("path")


_MEMBERS = "WITH e AS (SELECT event_type || '.zip' AS archive, 100 + user_id % 4 AS code, date_trunc('month', ts) + INTERVAL 40 DAY AS modified, event_id, CAST(year(ts) * 12 + month(ts) AS INT) AS p, value FROM events)"


def event_archives(spark, folder):
    """Archives of events by type, with a member for each of four stations, each dated in the month after its own."""
    path = new_folder(spark, "archives")
    ev = table(spark, folder, "events")
    code, month = F.col("user_id") % 4 + 100, F.date_trunc("month", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")
    named = ev.select(F.concat("event_type", F.lit(".zip")).alias("archive"), F.concat(F.lit("INMET_NE_A"), code, F.lit("_"), F.date_format("ts", "yyyyMM"), F.lit(".CSV")).alias("member"), (month + F.expr("INTERVAL 40 DAY")).alias("modified"), "event_id", F.concat_ws(",", "event_id", (F.year("ts") * 12 + F.month("ts")), "value").alias("value"))
    lines = named.select("archive", "member", "modified", F.col("event_id").alias("line"), "value")
    heads = named.select("archive", "member", "modified", F.lit(-1).cast("long").alias("line"), F.lit("id, p ,value").alias("value")).distinct()
    archives.write(heads.unionByName(lines), path).agg(F.sum("members")).collect()
    return path


@query("PAN01_ADD13_archives", _MEMBERS + ", c AS (SELECT archive, max(CAST(year(modified) * 12 + month(modified) AS INT)) AS export FROM e GROUP BY archive) SELECT e.archive, any_value(export) AS export, count(*) FILTER (p < export) AS n, round(coalesce(sum(value) FILTER (p < export), 0), 4) AS total FROM e JOIN c ON e.archive = c.archive WHERE code IN (100, 102) GROUP BY e.archive")
def archived(spark, folder):
    """Two stations' members out of all archives, up to the month before each archive's export."""
    path = event_archives(spark, folder)
    ends = archives.export_ends(spark, path)
    rows = archives.read(spark, path, members=archives.station_members(["A100", "A102"])).select("archive", F.col("fields")["p"].cast("int").alias("p"), F.col("fields")["value"].cast("double").alias("value"))
    out = archives.capped(rows, ends).groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.join(ends, "archive").select("archive", F.col("p").alias("export"), "n", F.round("total", 4).alias("total"))


_C = BRAZIL._series()


def _arc(phi: str) -> str:
    return f"({_C[0]!r} * {phi} + {_C[1]!r} * sin(2 * {phi}) + {_C[2]!r} * sin(4 * {phi}) + {_C[3]!r} * sin(6 * {phi}) + {_C[4]!r} * sin(8 * {phi}))"


_PHI, _WIDE = "radians(lat)", f"radians(lon - {BRAZIL.lon0!r})"
_COT = f"(cos({_PHI}) / sin({_PHI}) / sqrt(1 - {BRAZIL.e2!r} * pow(sin({_PHI}), 2)))"
_X = f"{BRAZIL.x0!r} + {BRAZIL.a!r} * {_COT} * sin({_WIDE} * sin({_PHI}))"
_Y = f"{BRAZIL.y0!r} + {BRAZIL.a!r} * ({_arc(_PHI)} + {_COT} * (1 - cos({_WIDE} * sin({_PHI}))))"


@query("SRC11_projected", f"WITH {ENTITIES} SELECT geo, round({_X}, 3) AS x, round({_Y}, 3) AS y, round(lat, 7) AS lat, round(lon, 7) AS lon FROM ent WHERE lat <> 0")
def projected(spark, folder):
    """Entities' places in metres, and back in degrees."""
    x, y = BRAZIL.forward(F.col("lat"), F.col("lon"))
    out = entities(spark, folder).where("lat <> 0").select("geo", x.alias("x"), y.alias("y"))
    lat, lon = BRAZIL.inverse(F.col("x"), F.col("y"))
    return out.select("geo", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


_RING = f"""WITH {ENTITIES}, c AS (SELECT geo, i, lat + [0.005, 0.005, 0.105, 0.105, 0.005][i] AS lat, lon + [0.0, 0.1, 0.1, 0.0, 0.0][i] AS lon FROM ent, generate_series(1, 5) g(i)), m AS (SELECT geo, i, {_X} AS x, {_Y} AS y FROM c),
 e AS (SELECT a.geo, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM m a JOIN m b ON a.geo = b.geo AND b.i = a.i + 1)
 SELECT CAST(geo AS VARCHAR) AS id, round(abs(sum(ax * by_ - ay * bx)) / 2 / 1e6, 3) AS area_km2, round(sum(sqrt(pow(ax - bx, 2) + pow(ay - by_, 2))) / 1e3, 4) AS perimeter_km FROM e GROUP BY geo"""


@query("SNK04_SRC10_geojson", _RING)
def geojson_round_trip(spark, folder):
    """Boxes of a tenth of a degree at all entities, written as GeoJSON, read back, and measured in metres."""
    path = new_folder(spark, "boxes")
    corners = [(0.005, 0.0), (0.005, 0.1), (0.105, 0.1), (0.105, 0.0), (0.005, 0.0)]
    ring = F.array(*[F.struct((F.col("lon") + o).alias("x"), (F.col("lat") + a).alias("y")) for a, o in corners])
    geojson.write(entities(spark, folder).select(F.col("geo").cast("string").alias("id"), F.concat(F.lit("Vila "), "geo").alias("name"), ring.alias("ring")), path)
    measured = spatial.shape(BRAZIL.ring(F.col("ring")))
    out = readers.features(spark, f"{path}/*.geojson")
    return out.select(F.col("poly").alias("id"), F.round(measured["area"] / 1e6, 3).alias("area_km2"), F.round(measured["perimeter"] / 1e3, 4).alias("perimeter_km"))


_FIELDS = {
    "experiment": ("string", ["$.experiment_id", "$.meta.id"]),
    "selected_model": ("string", ["$.selected.model", "$.results.selected.name"]),
    "selected_wape": ("double", ["$.selected.wape", "$.results.selected.gate.wape"]),
    "passed": ("boolean", ["$.selected.passes"]),
    "best_model": ("string", ["$.best[0].model", "$.results.best.name"]),
    "best_wape": ("double", ["$.best[0].wape", "$.results.best.wape"]),
}


def _year_reports(spark, folder):
    """A JSON report for each year; even and odd years have other shapes, and only even ones say whether they passed."""
    y, pred = F.col("y"), F.col("pred")
    each = predictions(spark, folder).groupBy("ano", "model").agg(F.round(metrics.wape(y, pred), 6).alias("wape")).where("wape IS NOT NULL")
    g = each.groupBy("ano").agg(F.max(F.when(F.col("model") == "champion", F.col("wape"))).alias("w"), F.min(F.struct("wape", "model")).alias("b"))
    name = F.concat(F.lit("E"), "ano")
    best = F.struct(F.col("b.model").alias("model"), F.col("b.wape").alias("wape"))
    even = F.to_json(F.struct(name.alias("experiment_id"), F.struct(F.lit("champion").alias("model"), F.col("w").alias("wape"), (F.col("w") <= 0.33).alias("passes")).alias("selected"), F.array(best).alias("best")))
    gate = F.struct(F.col("w").cast("string").alias("wape"))
    odd = F.to_json(F.struct(F.struct(name.alias("id"), F.array(F.lit(1), F.lit(2)).alias("seeds")).alias("meta"), F.struct(F.struct(F.lit("champion").alias("name"), gate.alias("gate")).alias("selected"), F.struct(F.col("b.model").alias("name"), F.col("b.wape").alias("wape")).alias("best")).alias("results")))
    path = new_folder(spark, "reports")
    g.select(F.concat(F.lit("﻿"), F.when(F.col("ano") % 2 == 0, even).otherwise(odd)).alias("value"), "ano").write.partitionBy("ano").text(path)
    return f"{path}/*/*.txt"


@query("MET23_ADD26_line_audit", f"WITH {LONG}, w AS (SELECT ano, model, round(sum(abs(y - pred)) / nullif(sum(abs(y)), 0), 6) AS wape FROM long GROUP BY ano, model), g AS (SELECT ano, max(wape) FILTER (model = 'champion') AS w, min(wape) AS b FROM w WHERE wape IS NOT NULL GROUP BY ano) SELECT 'E' || g.ano AS experiment, 'champion' AS selected_model, w AS selected_wape, CASE WHEN g.ano % 2 = 0 THEN w <= 0.33 ELSE w <= 0.34 END AS passed, min(model) AS best_model, b AS best_wape FROM g JOIN w ON w.ano = g.ano AND w.wape = g.b GROUP BY g.ano, w, b")
def line_audit(spark, folder):
    found = reports.loaded(spark, _year_reports(spark, folder))
    audit = reports.line_audit(found, _FIELDS, {"passed": ("selected_wape", 0.34)})
    return audit.select(*_FIELDS)
