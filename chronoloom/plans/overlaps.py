"""The overlap audit, on series with planted copies: all series come back scaled and cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlap
from .base import arrays, query, table

_WINDOWS = """
x AS (SELECT vec_id AS series, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
r AS (SELECT series, list_transform(range(2, 65), lambda i: round_even(v[CAST(i AS INT)] / v[CAST(i - 1 AS INT)] * 1000, 0) / 1000) AS r FROM x),
w AS (SELECT series, pos, r[CAST(pos + 1 AS INT):CAST(pos + 8 AS INT)] AS w FROM r CROSS JOIN (SELECT unnest(range(56)) AS pos)),
windows AS (SELECT series, pos, list_transform(w, lambda q: CAST(trunc(q * 1000) AS BIGINT)) AS key FROM w WHERE len(list_filter(w, lambda q: q = 1.0 OR abs(q) >= 1000000)) = 0 AND len(list_distinct(w)) >= 7)"""


def _windows(spark, sf_dir):
    return overlap.array_fingerprints(arrays(spark, sf_dir).select("series", "values"))


def _copies(spark, sf_dir):
    """copy, pos, key of the planted copies: 4 times the steps 10 to 49 of every series (a power of two keeps ratios exact)."""
    a = arrays(spark, sf_dir).select(F.col("series").alias("copy"), F.transform(F.slice("values", 11, 40), lambda v: v * 4).alias("values"))
    return overlap.array_fingerprints(a)


_COPIES = "copies AS (SELECT series AS copy, pos - 10 AS pos, key FROM windows WHERE pos >= 10 AND pos <= 41)"


@query(f"WITH {_WINDOWS} SELECT series, pos, key FROM windows")
def ratio_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query(f"WITH {_WINDOWS} SELECT series, pos, key FROM windows")
def ratio_windows_points(spark, sf_dir):
    points = arrays(spark, sf_dir).select("series", F.posexplode("values").alias("step", "value"))
    return overlap.fingerprints(points, ["series"])


@query(f"WITH {_WINDOWS} SELECT series, count(DISTINCT key) AS keys FROM windows GROUP BY series")
def overlap_index(spark, sf_dir):
    return overlap.index(_windows(spark, sf_dir), ["series"]).groupBy("series").agg(F.count("*").alias("keys"))


@query(f"WITH {_WINDOWS}, {_COPIES} SELECT w.series, c.copy, count(DISTINCT w.key) AS shared FROM windows w JOIN copies c ON c.key = w.key GROUP BY 1, 2 HAVING count(DISTINCT w.key) >= 3")
def overlap_scan(spark, sf_dir):
    return overlap.scan(_windows(spark, sf_dir), _copies(spark, sf_dir), ["series"], ["copy"])


@query(f"WITH {_WINDOWS}, {_COPIES}, v AS (SELECT w.series, c.copy, c.pos - w.pos AS \"offset\", count(*) AS aligned FROM windows w JOIN copies c ON c.key = w.key GROUP BY 1, 2, 3) SELECT series, copy, \"offset\", aligned FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY aligned DESC, copy, \"offset\") AS n FROM v) WHERE n = 1 AND aligned >= 20")
def overlap_verify(spark, sf_dir):
    return overlap.verify(_windows(spark, sf_dir), _copies(spark, sf_dir), ["series"], ["copy"])


@query(f"WITH {_WINDOWS}, {_COPIES}, h AS (SELECT w.series, c.copy FROM windows w JOIN copies c ON c.key = w.key GROUP BY 1, 2 HAVING count(DISTINCT w.key) >= 3) SELECT label AS subset, copy % 3 AS grp, count(*) AS series FROM h JOIN embeddings ON vec_id = series GROUP BY 1, 2")
def overlap_flags(spark, sf_dir):
    hits = overlap.scan(_windows(spark, sf_dir), _copies(spark, sf_dir), ["series"], ["copy"])
    named = hits.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series"), F.col("label").alias("subset")), "series").withColumn("grp", F.col("copy") % 3)
    return overlap.flagged(named, "subset", ["grp"])


@query("SELECT vec_id AS id FROM embeddings")
def affine_distinct(spark, sf_dir):
    a = arrays(spark, sf_dir)
    twice = a.select(F.col("series").alias("id"), "values").union(a.select(F.col("series") + 1_000_000, F.transform("values", lambda v: v * 8 + 0)))
    points = twice.select("id", F.posexplode("values").alias("step", "value"))
    return overlap.first_of_equals(overlap.affine_key(points, ["id"]), "id")


@query(f"WITH {_WINDOWS}, {_COPIES}, f AS (SELECT vec_id AS series FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 25) SELECT w.series, c.copy, count(DISTINCT w.key) AS shared FROM windows w JOIN f USING (series) JOIN copies c ON c.key = w.key WHERE w.pos <= 39 GROUP BY 1, 2 HAVING count(DISTINCT w.key) >= 3")
def overlap_first_pass(spark, sf_dir):
    """The first pass with limits: 25 series a subset, 48 values a series, against the whole reference."""
    seen = overlap.first_pass(arrays(spark, sf_dir), "subset", "series", 25, 48)
    return overlap.scan(overlap.array_fingerprints(seen.select("series", "values")), _copies(spark, sf_dir), ["series"], ["copy"])
