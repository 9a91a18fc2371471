"""Every query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

from chronoloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"  # which tells -0.0 from 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted([tuple(plain(v) for v in r) for r in df.select(*order).collect()], key=repr)
    want = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()], key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_computes_every_column(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).collect()  # not count(), which prunes what it doesn't need
    assert rows and all(any(r[c] is not None for r in rows) for c in rows[0].__fields__)
