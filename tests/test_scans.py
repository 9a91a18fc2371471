"""Scans of source formats, on tables made for them."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from chronoloom.plans import catalog


def made(path, embeddings):
    kinds = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    pq.write_table(pa.table({"vec_id": list(range(len(embeddings))), "embedding": embeddings, "label": [i % 2 for i in range(len(embeddings))]}, schema=kinds), f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    return con


def test_names_are_taken_from_paths_once_a_piece(spark, tmp_path):
    con = made(tmp_path, [(np.arange(64) / 64 + i).tolist() for i in range(6)])
    df = catalog.QUERIES["scan_npy"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("substring_index")  # the name is worked out below the points
    want = con.execute(catalog.ORACLES["scan_npy"]).fetchall()
    assert sorted(map(tuple, df.select("file", "channel", "step", "value").collect())) == sorted(want)


def test_tsf_rounds_products_of_floats_as_sql_does(spark, tmp_path):
    """0.3195 times 1000 is 319.5 as a float, and a little less as a double."""
    con = made(tmp_path, [[0.3195, -0.5, 0.25, 0.0005]])
    want = con.execute(catalog.ORACLES["scan_tsf"]).fetchall()
    assert want[0][2] == [320, None, 250, 1]
    assert [tuple(r) for r in catalog.QUERIES["scan_tsf"](spark, str(tmp_path)).select("file", "series_id", "vals", "frequency").collect()] == want
