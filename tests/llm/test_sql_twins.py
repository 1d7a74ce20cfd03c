"""Queries of this subpackage against their SQL twins on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from cropwind.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "pages", "labels", "embeddings", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    out = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(out.columns)
    want = sorted((dict(zip(columns, r)) for r in cursor.fetchall()), key=lambda r: repr(sorted(r.items())))
    got = sorted((r.asDict() for r in out.collect()), key=lambda r: repr(sorted(r.items())))
    assert got == want and got
