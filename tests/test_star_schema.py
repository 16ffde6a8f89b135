"""Every query of the language over the star schema against its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from facetgraph.plans import star_schema

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.4f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(star_schema.QUERIES))
def test_equals_sql(spark, con, name):
    df = star_schema.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    q = con.execute(star_schema.SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in q.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(star_schema.SQL) == set(star_schema.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
