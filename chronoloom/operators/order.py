"""Orders over whole tables without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges in which keys are ordered.
RANGES = 64


def running(df: DataFrame, key: Column, sums: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """df with running sums by key (numbers; rows of equal keys are added together). Keys are dealt to ranges at approximate quantiles, the ranges' sums are added up,
    and each range is ordered by itself."""
    d = df.withColumn("_key", key.cast("double"))
    cuts = sorted(set(d.approxQuantile("_key", [i / ranges for i in range(1, ranges)], 0.005))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("_key"))) if cuts else F.lit(0)
    d = d.select("*", *(x.alias(f"_own_{n}") for n, x in sums.items())).withColumn("_range", part)
    per = d.groupBy(F.col("_range").alias("_r")).agg(*(F.sum(f"_own_{n}").alias(f"_all_{n}") for n in sums))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    per = F.broadcast(per.select("_r", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums)))
    upto = Window.partitionBy("_range").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    out = d.join(per, F.col("_range") == F.col("_r"))
    return out.select(*df.columns, *((F.sum(f"_own_{n}").over(upto) + F.col(f"_before_{n}")).alias(n) for n in sums))


def renumbered(df: DataFrame, keys: list[str], id_: str, bits: int = 20) -> DataFrame:
    """df with ids numbered anew from 0 per key, in the old order: counts of ranges of 2 ** bits ids say where each range begins, and each is ordered by itself."""
    d = df.withColumn("_range", F.shiftright(F.col(id_).cast("long"), bits))
    per = d.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(f"_{k}" for k in keys)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(id_))
    out = d.withColumn("_nth", nth).join(per, same)
    return out.select(*((F.col("_before") + F.col("_nth") - 1).cast("long").alias(c) if c == id_ else F.col(c) for c in df.columns))
