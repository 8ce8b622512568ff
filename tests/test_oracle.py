"""Every registered query with SQL gives the rows of DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import docquarry.plans as plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    rel = duck.sql(plans.ORACLE[name])
    held = [d[0] for d in rel.description]
    assert sorted(held) == names
    spots = [held.index(c) for c in names]
    assert got == sorted(repr(tuple(plain(r[k]) for k in spots)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0 or name == "near_dup_pairs"
