"""Every registered query with reference SQL gives the same rows in Spark and DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tessera.bindings import all_oracles, all_queries

QUERIES, ORACLE = all_queries(), all_oracles()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_reference_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = cur.fetchall()
    assert len(got) == len(want) and len(got) > 0
    assert table(df.columns, got) == table(columns, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_reference_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert os.path.exists("/root/testdata/sf0.001")
    assert entry.entry(spark).count() > 0
