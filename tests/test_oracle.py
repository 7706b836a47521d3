"""Each query of the catalogue gives the rows of its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from concord.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF)
    theirs = duck.sql(catalog.ORACLE[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    got, want = rows(ours.columns, [tuple(r) for r in ours.collect()]), rows(theirs.columns, theirs.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
