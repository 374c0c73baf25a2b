"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = __import__("hitweave.plans.catalog", fromlist=["SQL"])


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(OWN.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = OWN.QUERIES[name](spark, SF)
    want = con.execute(OWN.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows_of(got.columns, got.collect()), rows_of(columns, want.fetchall())
    assert len(a) == len(b) and len(a) > 0
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or (isinstance(p, float) and abs(p - q) < 2e-6) for p, q in zip(x, y, strict=True))]
    assert not different, different[:3]


@pytest.mark.parametrize("name", sorted(set(OWN.QUERIES) - set(OWN.SQL)))
def test_other_queries_give_rows(spark, name):
    assert len(OWN.QUERIES[name](spark, SF).collect()) > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
