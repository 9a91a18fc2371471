"""Exact quantiles of groups of any size.

percentile() keeps a group's values in one task. Here a mergeable sketch with a stated error brackets the wanted ranks, rows outside the bracket are only counted, and the bracket is
narrowed until what lies in it is few; those are counted by value and added up. Every pass is an aggregation with partial sums, so one key may hold all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scalars import finite

#: Rows of a bracket that are counted by value, points at which a sketch is read, and its accuracy: ranks are off by at most a 1 / ACCURACY of the rows.
FEW, POINTS, ACCURACY = 200_000, 256, 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, ps: tuple[float, ...], keep: Callable[[DataFrame], DataFrame], lower: bool = False) -> DataFrame:
    """keys, p, q: for each key and each of ps the exact quantile of the finite values, with linear interpolation, or (lower) the smallest value that has at least p of the values up
    to it: of p = 0.5 the lower median. A key without values isn't there. keep(df) writes a small table (brackets, a row a key and rank) and reads it back, so that no plan grows from pass to pass. df is
    read once for the counts, twice for each narrowing (about one per factor 100 by which a key has more than FEW rows), and once at the end."""
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(c).alias(a) for c, a in zip(keys, k)), finite(value).alias("_v")).where("_v IS NOT NULL")
    whole = F.lit(1).alias("_all")
    k, rows = (k, rows) if k else (["_all"], rows.select(whole, "_v"))
    n = F.col("_n")
    wanted = []
    for p in ps:
        low, at = (F.greatest(F.ceil(n * p) - 1, F.lit(0)), F.lit(0.0)) if lower else (F.floor((n - 1) * p), (n - 1) * p - F.floor((n - 1) * p))
        high = F.least(low + F.when(at > 0, 1).otherwise(0), n - 1)
        wanted.append(F.struct(F.lit(float(p)).alias("p"), low.cast("long").alias("low"), high.cast("long").alias("high"), at.alias("at")))
    asked = keep(rows.groupBy(*k).agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).withColumn("w", F.explode(F.array(*wanted))).select(*k, "_n", "lo", "hi", "w.*"))
    state = asked.withColumn("r", F.explode(F.array_distinct(F.array("low", "high")))).select(*k, "r", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("_n").alias("inside")).distinct()
    state = keep(state)

    def met(state: DataFrame) -> DataFrame:
        """rows with the brackets of their key that they aren't above."""
        s = state.withColumnsRenamed({c: f"s{c}" for c in k})
        same = F.lit(True)
        for c in k:
            same &= F.col(c).eqNullSafe(F.col(f"s{c}"))
        return rows.join(s, same & (F.col("_v") <= F.col("hi"))).drop(*(f"s{c}" for c in k))

    while (state.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("inside")))).first()[0] or 0) > FEW:
        narrow = F.when(F.col("_v") >= F.col("lo"), F.col("_v"))
        points = F.array(*(F.lit(i / POINTS) for i in range(POINTS + 1)))
        read = met(state.where(f"lo < hi AND inside > {FEW}")).groupBy(*k, "r", "lo", "hi", "below", "inside").agg(F.percentile_approx(narrow, points, F.lit(ACCURACY)).alias("at"))
        share = (F.col("r") - F.col("below")) / F.col("inside")
        first = F.greatest(F.floor((share - 2 / ACCURACY) * POINTS), F.lit(0)).cast("int")
        last = F.least(F.ceil((share + (2 / ACCURACY)) * POINTS) + 1, F.lit(POINTS)).cast("int")
        # Written: a plan whose size isn't known would have the rows broadcast, or sorted by their keys, of which there may be one.
        tight = keep(read.select(*k, "r", F.when(first > 0, F.get("at", first)).otherwise(F.col("lo")).alias("lo"), F.when(last < POINTS, F.get("at", last)).otherwise(F.col("hi")).alias("hi")))
        counted = met(tight).groupBy(*k, "r", "lo", "hi").agg(F.count_if(F.col("_v") < F.col("lo")).alias("below"), F.count_if(F.col("_v") >= F.col("lo")).alias("inside"))
        before = state
        state = keep(counted.unionByName(state.where(f"lo >= hi OR inside <= {FEW}")))
        if state.agg(F.sum("inside")).first()[0] >= before.agg(F.sum("inside")).first()[0]:
            break  # values that repeat so often that no bracket parts them: few are different

    cells = met(state).groupBy(*k, "r", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("v")).agg(F.count("*").alias("n"))  # null: what lies below
    upto = F.sum("n").over(Window.partitionBy(*k, "r").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = cells.withColumn("upto", upto).where("v IS NOT NULL AND upto > r").groupBy(*k, "r").agg(F.min("v").alias("v"))
    found = found.groupBy(*(F.col(c).alias(f"f{c}") for c in k)).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"))  # two ranks a p at most
    same = F.lit(True)
    for c in k:
        same &= F.col(c).eqNullSafe(F.col(f"f{c}"))
    a, b = F.element_at("m", F.col("low")), F.element_at("m", F.col("high"))
    out = asked.join(found, same)
    return out.select(*(F.col(a_).alias(c) for c, a_ in zip(keys, k)), "p", (a + F.when(F.col("at") > 0, (b - a) * F.col("at")).otherwise(0.0)).alias("q"))
