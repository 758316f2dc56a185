"""Every registered query with SQL agrees with DuckDB over the same tables."""

import math

import duckdb
import pytest

from pitloom.plans import books, cleaning, composites, features, indicators, ingest, relational, regressions, research, signals, streams, windows  # noqa: F401
from pitloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.4f}" if abs(v) > 1e-9 else "0.0000"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = out.select(*columns).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in rows)
