"""Every query with SQL against DuckDB on the smallest tables; queries without SQL run and keep their schema."""

import duckdb
import pytest

from panelforge.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def close(v):
    return float(f"{v:.7g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(close(r[c]) for c in want.columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(close, r)) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_twice_alike(spark, name):
    rows = [sorted(map(str, registry.QUERIES[name](spark, FOLDER).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]
