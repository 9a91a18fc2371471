"""Cleaning: observed spans, filters, masks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, finite, let

LEAST_OBSERVED = 16


def canonical(points: DataFrame, value: str = "value") -> DataFrame:
    """NaN and infinite values become NULL."""
    return points.withColumn(value, finite(value))


def to_points(series: DataFrame, values: str = "values", keys: list[str] | None = None) -> DataFrame:
    """One row per series -> keys, step (from 0), value (finite double or NULL)."""
    keys = keys or [c for c in series.columns if c != values]
    out = series.select(*keys, F.posexplode(values).alias("step", "value"))
    return canonical(out.withColumn("step", F.col("step").cast("long")))


def to_series(points: DataFrame, keys: list[str], step: str = "step", value: str = "value") -> DataFrame:
    """Points of whole grids -> keys, values (in order of step)."""
    return points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, value))), lambda p: p[value]).alias("values"))


def observed_span(points: DataFrame, keys: list[str], step: str = "step", value: str = "value") -> DataFrame:
    """Steps between the first and the last observed one; gaps inside stay."""
    w = Window.partitionBy(*keys)
    seen = F.when(F.col(value).isNotNull(), F.col(step))
    return points.withColumn("_lo", F.min(seen).over(w)).withColumn("_hi", F.max(seen).over(w)).where((F.col(step) >= F.col("_lo")) & (F.col(step) <= F.col("_hi"))).drop("_lo", "_hi")


def trim_array(values: str | Column) -> Column:
    """The same over an array; empty if nothing is observed."""

    def cut(v: Column, seen: Column) -> Column:
        return F.when(F.size(seen) == 0, F.slice(v, 1, 0)).otherwise(F.slice(v, F.array_min(seen), F.array_max(seen) - F.array_min(seen) + 1))

    def places(v: Column) -> Column:
        return F.filter(F.transform(v, lambda x, i: F.when(x.isNotNull(), i + 1)), lambda i: i.isNotNull())

    return let(col(values), lambda v: let(places(v), lambda seen: cut(v, seen)))


def keep_series(points: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Points of the series for which an aggregate condition holds."""
    good = points.groupBy(*keys).agg(condition.alias("_ok")).where("_ok").select(*keys)
    return points.join(good, keys, "left_semi")


def min_observed(points: DataFrame, keys: list[str], least: int = LEAST_OBSERVED, value: str = "value") -> DataFrame:
    return keep_series(points, keys, F.count(value) >= least)


def not_constant(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return keep_series(points, keys, F.max(value) > F.min(value))


def many_values(points: DataFrame, keys: list[str], above: int = 16, value: str = "value") -> DataFrame:
    return keep_series(points, keys, F.count_distinct(value) > above)


def complete(points: DataFrame, keys: list[str], share: float = 0.5, value: str = "value") -> DataFrame:
    return keep_series(points, keys, F.avg(F.col(value).isNotNull().cast("int")) > share)


def numeric(text: str | Column) -> Column:
    """Text as a double; NULL where it can't be read or isn't finite."""
    return finite(col(text).try_cast("double"))


def without(value: str | Column, *sentinels: float) -> Column:
    return F.when(~col(value).isin(*sentinels), col(value))


def flagged(value: str | Column, flag: str | Column, good: int = 0) -> Column:
    """The value where its quality flag is good."""
    return F.when(col(flag) == good, col(value))


def hash_bucket(text: str | Column, buckets: int, digits: int = 2) -> Column:
    """True for one in buckets, by the first hexadecimal digits of a stable hash."""
    return F.conv(F.substring(col(text), 1, digits), 16, 10).cast("int") % buckets == 0


def seeded_sample(df: DataFrame, per: list[str], id_: str, n: int, seed: int = 0) -> DataFrame:
    """n rows per group without replacement, in an order that depends on seed and id only; first the partial top n of each part, then that of all."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")))
    w = Window.partitionBy(*per).orderBy(order, id_)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def even_sample(df: DataFrame, per: list[str], order: str, n: int) -> DataFrame:
    """n rows per group at even places from the first to the last (all, if there are no more)."""
    w = Window.partitionBy(*per)
    numbered = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(max(n - 1, 1))).cast("int"))
    return numbered.where((F.col("_n") <= n) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def fixed_draw(df: DataFrame, per: list[str], id_: str, share: float, length: str | None = None) -> DataFrame:
    """Rows whose hash is below share; if it keeps none of a group, the group's first id stands."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", *per, F.col(id_).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    w = Window.partitionBy(*per)
    df = df.withColumn("_keep", u < share).withColumn("_any", F.max("_keep").over(w)).withColumn("_first", F.min(id_).over(w))
    return df.where(F.col("_keep") | (~F.col("_any") & (F.col(id_) == F.col("_first")))).drop("_keep", "_any", "_first")


def flip(values: str | Column, sign: str | Column) -> Column:
    s = col(sign)
    return F.transform(col(values), lambda v: s * v)


def left_pad(values: str | Column, length: int) -> Column:
    """The last length values, with NULLs before if there are fewer."""
    v = col(values)
    n = F.least(F.size(v), F.lit(length))
    return F.concat(F.array_repeat(F.lit(None).cast("double"), F.lit(length) - n), F.slice(v, F.size(v) - n + 1, n))


def not_below_zero(quantiles: str | Column, context: str | Column) -> Column:
    """Quantiles floored at 0 where the context has no value below 0."""
    return F.when(F.coalesce(F.array_min(F.filter(col(context), lambda v: v.isNotNull())) < 0, F.lit(False)), col(quantiles)).otherwise(F.transform(col(quantiles), lambda v: F.greatest(v, F.lit(0.0))))


def placeholders(points: DataFrame, keys: list[str], step: str = "step", value: str = "value") -> DataFrame:
    """Series of which more than half equals the first value: those values are missing; gaps are then filled in a line, flat beyond the ends. Series that would lose
    all their values are left alone."""
    w = Window.partitionBy(*keys)
    by = w.orderBy(step)
    first = F.first(value).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    p = points.withColumn("_same", F.coalesce(F.col(value) == first, F.lit(False)).cast("int"))
    share = F.avg("_same").over(w)
    p = p.withColumn("_mask", (share > 0.5) & (share < 1)).withColumn("_v", F.when(F.col("_mask") & (F.col("_same") == 1), None).otherwise(F.col(value)))
    here = F.when(F.col("_v").isNotNull(), F.col(step))
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    p = p.withColumn("_s0", F.last(here, True).over(before)).withColumn("_v0", F.last("_v", True).over(before)).withColumn("_s1", F.first(here, True).over(after)).withColumn("_v1", F.first("_v", True).over(after))
    line = F.when(F.col("_s0") == F.col("_s1"), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(step) - F.col("_s0")) / (F.col("_s1") - F.col("_s0")))
    filled = F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(F.coalesce(line, "_v0", "_v1"))
    return p.withColumn(value, F.when(F.col("_mask"), filled).otherwise(F.col(value))).drop("_same", "_mask", "_v", "_s0", "_v0", "_s1", "_v1")
