"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from chronoloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    got = sorted((plain(r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((plain(r) for r in cur.fetchall()), key=repr)
