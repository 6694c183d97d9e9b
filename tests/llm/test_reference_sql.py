"""Queries with reference SQL give its rows over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm.queries import ORACLE, QUERIES


def rounded(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_reference_sql(spark, data, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = QUERIES[name](spark, data)
    want = duck.execute(ORACLE[name])
    columns, rows = [d[0] for d in want.description], want.fetchall()
    assert rows and rounded(found.columns, map(tuple, found.collect())) == rounded(columns, rows)
