"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, spill


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") / 1024).cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long, in any direction) -> node long, component long (its smallest node), for each node that has an edge to another.

    Each round is two aggregations with partial sums per node and two joins; its result is written to the shared folder. Rounds go on until nothing changes
    (about the logarithm of the longest path). Loops, repeated edges and nulls are harmless; no edges give no rows.
    """
    now = spill(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = _sign(now)
    while sign[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = spill(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        after = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v")).distinct()
        after = spill(after, "edges")
        forget(large, now)
        now, old, sign = after, sign, _sign(after)
        if sign == old:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
