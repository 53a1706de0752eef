"""Readers on files made here."""

import datetime
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from panelforge.operators import spatial
from panelforge.sources import fetch, readers
from panelforge.streaming import jobs


def test_zip_members_keep_their_source_and_bad_text_is_latin(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", " id ,name\n1,Açu\n2,b\n".encode())
        z.writestr("y.csv", "id,name\n3,Pará\n".encode("latin-1"))
        z.writestr("notes.txt", "no")
        z.writestr("cut.csv", b"id,name\n4,\xc3")
    rows = readers.zipped_csv(spark, str(tmp_path)).collect()
    assert sorted((r.source, r.fields["id"], r.fields["name"]) for r in rows) == [("a.zip:cut.csv", "4", "Ã"), ("a.zip:x.csv", "1", "Açu"), ("a.zip:x.csv", "2", "b"), ("a.zip:y.csv", "3", "Pará")]


def test_station_files(spark, tmp_path):
    head = "REGIAO:;NE\nUF:;CE\nESTACAO:;JATI\nCODIGO:;A1\nLATITUDE:;-7,5\nLONGITUDE:;-39\nALTITUDE:;400\nFUNDACAO:;01/01/07\n"
    (tmp_path / "s.csv").write_text(head + "Data;Hora;PRECIPITACAO TOTAL (mm);TEMPERATURA (C)\n2024/01/01;0000;812,4;31\n2024/01/01;0100;-9999;\n")
    out = readers.station_files(spark, str(tmp_path / "s.csv"))
    rows = out.select("line", F.element_at("head", "codigo").alias("code"), readers.station_value(F.col("names"), F.col("parts"), "precip").alias("rain"), readers.station_value(F.col("names"), F.col("parts"), "temper").alias("temp")).orderBy("line").collect()
    assert [(r.rain, r.temp) for r in rows] == [(812.4, 31.0), (None, None)]


def test_geojson_and_location(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"id": "7", "name": "sq"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    polygons = readers.features(spark, str(tmp_path / "g.json"))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0)], "geo int, lon double, lat double")
    assert sorted((r.geo, r.poly) for r in spatial.located(points, polygons).collect()) == [(1, "7"), (2, None)]


def test_index_table_and_daily_payload(spark, tmp_path):
    (tmp_path / "i.txt").write_text("  1950 2024\n 1950 " + " ".join(["0.5"] * 11) + " -99.90\nend\n")
    rows = readers.index_table(spark, str(tmp_path / "i.txt")).collect()
    assert len(rows) == 12 and rows[0].value == 0.5 and rows[11].value is None
    body = json.dumps({"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_mean": [25.0, None], "precipitation_sum": [0.0, 1.5]}})
    out = readers.daily_payload(spark.createDataFrame([("c1", body)], "cell string, body string")).collect()
    assert [(str(r.day), r.temp, r.rain) for r in out] == [("2024-01-01", 25.0, 0.0), ("2024-01-02", None, 1.5)]


def test_request_windows_and_point_source(spark, tmp_path):
    w = readers.windows(spark, "2024-01-01", "2024-01-12", 5).collect()
    assert [(str(r["first"]), str(r["last"])) for r in w] == [("2024-01-01", "2024-01-05"), ("2024-01-06", "2024-01-10"), ("2024-01-11", "2024-01-12")]
    for k in (1, 2):
        (tmp_path / f"{k}.0.json").write_text(f"answer {k}")
    spark.dataSource.register(readers.PointSource)
    df = spark.read.format("points").option("points", json.dumps([["a", 1.0, 0], ["b", 2.0, 0]])).option("url", f"file://{tmp_path}/{{lat}}.json").load()
    assert sorted(map(tuple, df.collect())) == [("a", "answer 1"), ("b", "answer 2")]


def test_manifest_counts_what_was_written(spark, tmp_path):
    m = readers.write_with_manifest(spark.range(5), str(tmp_path / "t"), ["id"])
    assert m["rows"] == 5 and m["keys"] == ["id"]
    twice = readers.write_with_manifest(spark.range(5).union(spark.range(5)), str(tmp_path / "u"), ["id"])
    none = readers.write_with_manifest(spark.range(0), str(tmp_path / "v"), ["id"])
    assert len({m["content"], twice["content"], none["content"]}) == 3 and none["rows"] == 0
    readers.append_lines(spark.range(2), str(tmp_path / "log"))
    readers.append_lines(spark.range(3), str(tmp_path / "log"))
    assert readers.json_lines(spark, str(tmp_path / "log"), "id long").count() == 5


@pytest.mark.parametrize("n", [0, 6])
def test_append_streams_are_files(spark, tmp_path, n):
    rows = [(i % 3, datetime.datetime(2024, 1, 1 + i)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = jobs.run_append(jobs.distinct(jobs.event_stream(spark, f"{tmp_path}/events.parquet")), "t")
    assert sorted(r.event_id for r in got.collect()) == list(range(min(n, 3)))
    assert n == 0 or got.inputFiles()


def test_fetch_pauses_and_goes_on(spark, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    folder = str(calls)

    def ask(lat, lon):
        import uuid

        n = sum(f.startswith(f"{lat}-") for f in os.listdir(folder))
        open(f"{folder}/{lat}-{uuid.uuid4()}", "w").close()
        if lat == 2.0 and n < 2:
            return 429, 0.0, None
        if lat == 3.0:
            return 404, None, None
        return 200, None, f"answer {lat}"

    cells = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 0.0), ("b", 2.0, 0.0), (None, 9.0, 0.0)], "cell string, lat double, lon double").coalesce(1)
    first = fetch.resumed(cells, cache, ask, lanes=1, pause=0.0, refusals=2)
    assert first.get("paused", 0) >= 1 and first["cached"] == 0
    second = fetch.resumed(cells, cache, ask, lanes=1, pause=0.0, refusals=2)
    assert second["cached"] == first.get("done", 0) and second["cached"] + second["done"] == 2
    assert sorted((r.cell, r.body) for r in spark.read.parquet(cache).collect()) == [("a", "answer 1.0"), ("b", "answer 2.0")]
    assert sum(f.startswith("1.0-") for f in os.listdir(folder)) == 1
    third = fetch.resumed(spark.createDataFrame([("c", 3.0, 0.0)], cells.schema), cache, ask, pause=0.0)
    assert third == {"failed": 1, "cached": 0}
    # a run that was stopped after its answers were written, and one that was stopped while they were
    left = spark.createDataFrame([("d", 4.0, 0.0, "done", "old"), ("a", 1.0, 0.0, "done", "again"), ("e", 5.0, 0.0, "paused", None)], fetch.ANSWER)
    left.write.parquet(f"{cache}.run-1")
    os.makedirs(f"{cache}.run-2/_temporary")
    more = spark.createDataFrame([("d", 4.0, 0.0), ("a", 1.0, 0.0)], cells.schema)
    assert fetch.resumed(more, cache, ask, pause=0.0) == {"cached": 2}
    assert sorted((r.cell, r.body) for r in spark.read.parquet(cache).collect()) == [("a", "answer 1.0"), ("b", "answer 2.0"), ("d", "old")]
    assert not [f for f in os.listdir(os.path.dirname(cache)) if ".run-" in f]


def test_rounds_end_when_a_circuit_opens(spark, tmp_path):
    cells = spark.range(20).selectExpr("cast(id AS string) AS cell", "cast(id AS double) AS lat", "0D AS lon")
    done = fetch.resumed(cells, str(tmp_path / "c"), lambda lat, lon: (200, None, "x"), lanes=2, pause=0.0, batch=3)
    assert done == {"done": 20, "cached": 0}
    none = fetch.resumed(cells, str(tmp_path / "d"), lambda lat, lon: (429, 0.0, None), lanes=1, pause=0.0, batch=3, refusals=1)
    assert none == {"paused": 20, "cached": 0}
