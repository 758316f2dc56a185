"""Corpus queries with SQL agree with DuckDB over the same tables."""

import duckdb
import pytest

from pitloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out, want = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    columns = sorted(out.columns)
    assert sorted(want.columns) == columns
    got = sorted(map(tuple, out.select(*columns).collect()), key=str)
    assert got == sorted(want.project(", ".join(columns)).fetchall(), key=str)
