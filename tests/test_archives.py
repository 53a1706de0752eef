"""Archives by range and GeoJSON with commits."""

import datetime
import glob
import os
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from panelforge.sources import archives, geojson, readers


def put(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, when, text in members:
            z.writestr(zipfile.ZipInfo(name, when), text)


def test_members_are_partitions_with_their_time(spark, tmp_path):
    put(tmp_path / "a.zip", [("INMET_NE_A101_X.CSV", (2024, 3, 1, 2, 4, 6), "id,v\n1,2\n3,4\n"), ("notes.txt", (2025, 1, 1, 0, 0, 0), "x"), ("INMET_B202_.csv", (2024, 2, 9, 0, 0, 0), "id,v\n5,6\n")])
    put(tmp_path / "b.zip", [("INMET_A103_.csv", (2023, 12, 31, 0, 0, 0), 'id,v\n7,"two\nlines"\n')])
    df = archives.read(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r.archive, r.member, r.line, r.fields["v"]) for r in df.collect()) == [("a.zip", "INMET_B202_.csv", 0, "6"), ("a.zip", "INMET_NE_A101_X.CSV", 0, "2"), ("a.zip", "INMET_NE_A101_X.CSV", 1, "4"), ("b.zip", "INMET_A103_.csv", 0, "two\nlines")]
    assert df.where("line = 1").first().modified == datetime.datetime(2024, 3, 1, 2, 4, 6)
    assert sorted(map(tuple, archives.export_ends(spark, str(tmp_path)).collect())) == [("a.zip", 2024 * 12 + 3), ("b.zip", 2023 * 12 + 12)]
    some = archives.read(spark, f"file:{tmp_path}", members=archives.station_members(["A101", "A103"]))
    assert {r.member for r in some.collect()} == {"INMET_NE_A101_X.CSV", "INMET_A103_.csv"}
    assert archives.read(spark, str(tmp_path), members=archives.station_members([])).count() == 0
    seen = spark.createDataFrame([("a.zip", 24290), ("a.zip", 24291), ("b.zip", 24287)], "archive string, p int")
    assert sorted(map(tuple, archives.capped(seen, archives.export_ends(spark, str(tmp_path))).collect())) == [("a.zip", 24290), ("b.zip", 24287)]


def test_a_member_larger_than_the_memory_it_may_take_streams(tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.csv", "w") as m:
        m.write(b"id,text\n")
        for i in range(300):
            m.write(b"".join(b"%d,%s\n" % (i * 1000 + k, b"x" * 90) for k in range(1000)))
    reader = archives.ArchiveSource({"path": str(tmp_path)}).reader(None)
    (part,) = reader.partitions()
    tracemalloc.start()
    n = sum(1 for _ in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000 and os.path.getsize(tmp_path / "big.zip") < 3e6 and peak < 12e6  # the member has 30 MB


def test_written_archives_read_back(spark, tmp_path):
    rows = [(f"{a}.zip", f"{m}.csv", datetime.datetime(2020, m, 2), i, "n" if i == 0 else str(a * m * i)) for a in (1, 2, 3) for m in (1, 2) for i in range(4)]
    df = spark.createDataFrame(rows, "archive string, member string, modified timestamp_ntz, line long, value string").repartition(5)
    assert {r.archive: r.members for r in archives.write(df, str(tmp_path / "out")).collect()} == {"1.zip": 2, "2.zip": 2, "3.zip": 2}
    got = archives.read(spark, str(tmp_path / "out")).collect()
    assert sorted((r.archive, r.member, r.fields["n"]) for r in got) == sorted((a, m, v) for a, m, _, i, v in rows if i)


SQUARE = "array(named_struct('x', a, 'y', 0D), named_struct('x', a + 1, 'y', 0D), named_struct('x', a + 1, 'y', 1D), named_struct('x', a, 'y', 1D), named_struct('x', a, 'y', 0D))"


def test_geojson_round_trip_and_failed_jobs_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(20).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("é \""), "id").alias("name"), F.col("id").cast("double").alias("a")).repartition(4).select("id", "name", F.expr(SQUARE).alias("ring"))
    geojson.write(df, out)
    assert len(glob.glob(f"{out}/*.geojson")) == 4 and not glob.glob(f"{out}/.writing*")
    got = readers.features(spark, f"{out}/*.geojson").select("poly", "name", "ring").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in df.withColumnRenamed("id", "poly").collect())
    bad = df.withColumn("ring", F.when(F.col("id") == "17", F.slice("ring", 1, 3)).otherwise(F.col("ring")))
    with pytest.raises(Exception, match="closed ring"):
        geojson.write(bad, str(tmp_path / "bad"))
    assert not [f for f in glob.glob(f"{tmp_path}/bad/**", recursive=True, include_hidden=True) if os.path.isfile(f)]
    with pytest.raises(Exception, match="closed ring"):
        geojson.write(bad, out)
    assert readers.features(spark, f"{out}/*.geojson").count() == 20
    geojson.write(df.limit(3), out, "append")
    assert readers.features(spark, f"{out}/*.geojson").count() == 23
