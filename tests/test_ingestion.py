"""Whole vendor schemas, fail-closed maps, the ingestion's report and report audits."""

import json

import pytest
from pyspark.sql import functions as F

from panelforge.operators import ingestion, reports


def test_vendors_columns_are_found_whatever_their_marks(spark):
    a = spark.createDataFrame([("2024-01-01 01:30:00", " X ", "Ceará", "Açu", "3", "n/a", "0.5", "-7", "-39")], ["Data / Hora ", "SATELITE", "Estado", "Municipio", "N. Dias Sem Chuva", "Precipitacao", "Risco Fogo", "Latitude", "Longitude"])
    r = ingestion.first_vendor(a, F.lit("a")).first()
    assert (r.satellite, r.municipality_raw, r.dry_days, r.rain, r.frp, r.biome, r.ano, r.mes, r.event_date) == ("X", "Açu", 3.0, None, None, None, 2023, 12, "2023-12-31")
    b = spark.createDataFrame([("05/02/2020 10:00", "PI", "b"), ("2/2020", "PI", "b")], "DataHora string, Estado string, Municipio string")
    assert [(r.mes, r.event_date, r.satellite, r.time_utc) for r in ingestion.second_vendor(b, F.lit("b")).collect()] == [(2, "2020-02-05", "UNKNOWN", None), (None, None, "UNKNOWN", None)]


def test_names_map_by_region_and_member_or_fail(spark, tmp_path):
    rows = [{"geocodigo": 1, "nome": "Açu", "uf": "ce"}, {"geocodigo": 2, "municipio_ibge": "Açu", "nome": "x", "uf": "PE"}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    places = ingestion.lookup(spark, str(tmp_path / "p.json"))
    events = lambda *r: spark.createDataFrame(list(r), "state_name string, municipality_raw string, source_file string")
    good = events(("CEARÁ", "acu", "z.zip:a.csv"), ("Pernambuco", None, "z.zip:x/Açu/b.csv"), ("Ceará", " ", "z.zip:AÇU_2020_1.csv"), ("Ceará", "", "Acu/b.csv"))
    assert [r.geo for r in ingestion.mapped(good, places).orderBy("source_file").collect()] == [1, 1, 1, 2]
    for bad, word in ((("Bahia", "Açu", "z"), "no such region: Bahia"), (("Ceará", "Natal", "z"), "no such place: natal, CE"), ((None, "Açu", "z"), "no such region: NULL")):
        with pytest.raises(Exception, match=word):
            ingestion.mapped(events(bad), places).collect()
    (tmp_path / "q.json").write_text(json.dumps([*rows, {"geocodigo": 3, "nome": "ACU", "uf": "CE"}]))
    with pytest.raises(Exception, match="two places"):
        ingestion.lookup(spark, str(tmp_path / "q.json")).collect()
    points = spark.createDataFrame([("AÇU", 1.0, 2.0)], "name string, lat double, lon double")
    with pytest.raises(Exception, match="no coordinates: Natal"):
        ingestion.located(spark.createDataFrame([(1, "Açu"), (2, "Natal")], "geo int, name string"), points).collect()


def test_the_report_is_made_by_the_pass_that_writes(spark, tmp_path):
    schema = "id int, geo int, uf string, ano int, mes int, frp double"
    local = spark.createDataFrame([(1, 1, "CE", 2003, 6, 1.0), (2, 1, "CE", 2004, 2, None), (2, 1, "CE", 2004, 2, None)], schema)
    api = spark.createDataFrame([(2, 1, "CE", 2004, 2, None, "s"), (3, 2, "PE", 2004, 2, 4.0, "s"), (4, 2, "PE", 2004, 2, 6.0, "s")], schema + ", extra string")
    job = ingestion.Ingestion("hybrid", {"local": local, "api": api}, ["id"])
    plan = job.months()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 3 and plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") == 2
    job = ingestion.Ingestion("hybrid", {"local": local, "api": api}, ["id"])
    job.write(str(tmp_path / "m"))
    r = job.report(spark).first()
    out = spark.read.parquet(str(tmp_path / "m"))
    assert (r.read_local, r.read_api, r.repeats, r["rows"], r["columns"]) == (3, 3, 2, out.count(), len(out.columns)) == (3, 3, 2, 3, 7)
    assert (r.date_min, r.date_max, r["first"], r["last"], r.entities, r.regions) == ("2003-02", "2004-06", "2003-06", "2004-02", 2, 2)
    assert sorted(((x.geo, x.events, x.frp_sum) for x in out.collect()), key=str) == [(1, 1, 1.0), (1, 1, None), (2, 2, 10.0)]
    empty = ingestion.Ingestion("local", {"local": local.limit(0), "api": api}, ["id"])
    empty.write(str(tmp_path / "e"))
    assert tuple(empty.report(spark).first())[1:] == (0, 0, 0, 0, 7, "N/A", "N/A", "N/A", "N/A", 0, 0)
    with pytest.raises(ValueError):
        ingestion.Ingestion("api", {"local": local}, ["id"])
    with pytest.raises(ValueError):
        ingestion.Ingestion("other", {"local": local}, ["id"])


def test_reports_of_any_shape(spark, tmp_path):
    for name, text in (("a.json", '﻿{"id": "A", "m": {"w": 0.2, "ok": false}, "d": "2020"}'), ("b.json", '{"meta": {"id": "B"}, "r": [{"w": "0.31"}]}'), ("c.json", "{bad"), ("d.json", '{"id": 7, "m": [1, 2]}')):
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = reports.loaded(spark, str(tmp_path))
    fields = {"id": ("string", ["$.id", "$.meta.id"]), "w": ("double", ["$.m.w", "$.r[0].w"]), "ok": ("boolean", ["$.m.ok"])}
    audit = reports.line_audit(found, fields, {"ok": ("w", 0.35), "low": ("w", 0.25)})
    assert sorted(map(tuple, audit.collect())) == [("a.json", "A", 0.2, False, True), ("b.json", "B", 0.31, True, False), ("c.json", None, None, False, False), ("d.json", "7", None, False, False)]
    assert tuple(reports.summary(audit, ["w"], "ok").first()) == (4, 1, 0.2)
    assert reports.shapes(found.where("report IS NOT NULL")).count() == 3
