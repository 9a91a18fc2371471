"""Re-gridding and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, let


#: Steps of a calendar that are filled at a time.
SLICE = 1024


def filled(spans: DataFrame, points: DataFrame, keys: list[str], step: str = "step", value: str = "value", every: int = 1) -> DataFrame:
    """keys, step (long), value: every steps from _lo to _hi of spans (keys, _lo, _hi), the points' values, NULL where there is none; points off this calendar are lost, repeated ones each
    have a row.

    Points are gathered by slices of the calendar, and a slice is filled where it lies: what is shuffled is points and a row a slice, never the calendar, and a long series is as many
    groups as it has slices."""
    wide, n, kind = SLICE * every, F.lit(every).cast("long"), points.schema[value].dataType
    start = lambda c: c - F.pmod(c, F.lit(wide).cast("long"))
    at, lo, hi = F.col("_at"), F.col("_lo").cast("long"), F.col("_hi").cast("long")
    point = F.struct(F.col(step).cast("long").alias("s"), F.col(value).alias("v"))
    seen = points.where(F.col(step).isNotNull()).groupBy(*keys, start(F.col(step).cast("long")).alias("_at")).agg(F.array_sort(F.collect_list(point)).alias("_seen"))
    slices = spans.select(*keys, lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(start(lo), start(hi), F.lit(wide).cast("long"))).alias("_at"))
    slices = slices.withColumn("_first", F.when(at <= lo, lo).otherwise(at + F.pmod(lo - at, n))).withColumn("_last", F.least(hi, at + wide - 1)).where("_first <= _last")
    first, last = F.col("_first"), F.col("_last")
    on = F.filter("_seen", lambda x: (x["s"] >= first) & (x["s"] <= last) & (F.pmod(x["s"] - first, n) == 0))
    opened = lambda x: F.when(F.coalesce(F.get(x, F.lit(0))["s"] == first, F.lit(False)), x).otherwise(F.concat(F.array(F.struct(first.alias("s"), F.lit(None).cast(kind).alias("v"))), F.coalesce(x, F.array().cast(x_type))))
    x_type = seen.schema["_seen"].dataType
    # A run is a point and what is empty after it.
    run = lambda x: F.transform(x, lambda p, i: F.struct(p["s"].alias("s"), p["v"].alias("v"), F.greatest(p["s"], F.coalesce(F.get(x, i + 1)["s"] - n, last)).alias("to")))
    runs = slices.join(seen, [*keys, "_at"], "left").select(*keys, F.explode_outer(let(let(on, opened), run)).alias("_run"))
    out = runs.select(*keys, F.col("_run.s").alias("_s"), F.col("_run.v").alias("_v"), F.explode_outer(F.sequence("_run.s", "_run.to", n)).alias(step))
    return out.select(*keys, step, F.when(F.col(step) == F.col("_s"), F.col("_v")).alias(value))


def scatter(points: DataFrame, keys: list[str], step: str = "step", value: str = "value", arrival: str | None = None, zero_based: bool = False) -> DataFrame:
    """Ordinals -> a dense grid from the smallest (or 0) to the largest; gaps are NULL, of equal ordinals the last by arrival stands."""
    kept = F.max_by(value, arrival) if arrival else F.max(value)
    once = points.where(F.col(step).isNotNull()).groupBy(*keys, step).agg(kept.alias(value))
    spans = once.groupBy(*keys).agg((F.lit(0).cast("long") if zero_based else F.min(step)).alias("_lo"), F.max(step).alias("_hi"))
    return filled(spans, once, keys, step, value)


def reindex(points: DataFrame, keys: list[str], every: int, step: str = "step", value: str = "value", arrival: str | None = None) -> DataFrame:
    """A calendar of every steps from the first one; of equal steps the first by arrival stands, steps off the calendar are lost."""
    kept = F.min_by(value, arrival) if arrival else F.min(value)
    once = points.groupBy(*keys, step).agg(kept.alias(value))
    spans = once.groupBy(*keys).agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))
    return filled(spans, once, keys, step, value, every)


def tumbling(points: DataFrame, keys: list[str], width: int, agg: Column, step: str = "step", trim_edges: bool = False) -> DataFrame:
    """keys, bin, value: an aggregate per bin of width steps, NULL in empty bins between the first and the last; without these two if trim_edges."""
    binned = points.where(F.col(step).isNotNull()).groupBy(*keys, F.floor(F.col(step) / width).cast("long").alias("bin")).agg(agg.alias("value"))
    edge = 1 if trim_edges else 0
    spans = binned.groupBy(*keys).agg((F.min("bin") + edge).alias("_lo"), (F.max("bin") - edge).alias("_hi"))
    return filled(spans.where("_lo <= _hi"), binned, keys, "bin")


def tumbling_mean(points: DataFrame, keys: list[str], width: int, step: str = "step", value: str = "value") -> DataFrame:
    return tumbling(points, keys, width, F.avg(value), step)


def tumbling_sum(points: DataFrame, keys: list[str], width: int, min_count: int, trim_edges: bool = True, step: str = "step", value: str = "value") -> DataFrame:
    """Sums of bins with at least min_count observed steps; without the first and the last bin if trim_edges."""
    return tumbling(points, keys, width, F.when(F.count(value) >= min_count, F.sum(value)), step, trim_edges)


def bin_counts(events: DataFrame, keys: list[str], least: int, step: str = "step") -> DataFrame:
    """keys, step, n: events per step from 0 on, zeros filled, for groups of at least least events."""
    counted = events.groupBy(*keys, step).agg(F.count("*").alias("n"))
    big = counted.groupBy(*keys).agg(F.sum("n").alias("_all"), F.lit(0).cast("long").alias("_lo"), F.max(step).alias("_hi")).where(F.col("_all") >= least)
    return filled(big, counted, keys, step, "n").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def fixed_blocks(points: DataFrame, keys: list[str], k: int, agg: Column, step: str = "step") -> DataFrame:
    """keys, block, value: blocks of k steps from step 0; a shorter tail is dropped."""
    return points.groupBy(*keys, F.floor(F.col(step) / k).cast("long").alias("block")).agg(agg.alias("value"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")


def block_rms(points: DataFrame, keys: list[str], k: int, step: str = "step", value: str = "value") -> DataFrame:
    return fixed_blocks(points, keys, k, F.sqrt(F.avg(F.col(value) * F.col(value))), step)


def amplitude_profile(points: DataFrame, keys: list[str], width: int, step: str = "step", value: str = "value") -> DataFrame:
    """Deviation (population) inside each block of width steps from step 0."""
    return fixed_blocks(points, keys, width, F.stddev_pop(value), step)


def decimate(points: DataFrame, keys: list[str], k: int, strict: bool = False, step: str = "step", value: str = "value") -> DataFrame:
    """keys, step (of blocks), value: means of blocks of k that end at the last step; a partial block at the start is dropped. A block's mean is over its observed
    steps, or if strict NULL unless all are observed. Steps run from 0 without gaps."""
    n = F.count("*").over(Window.partitionBy(*keys))
    block = F.floor((F.col(step) - (n - F.floor(n / k) * k)) / k)
    mean = F.when(F.count(value) == k, F.avg(value)) if strict else F.avg(value)
    return points.withColumn("_b", block).where("_b >= 0").groupBy(*keys, F.col("_b").cast("long").alias(step)).agg(mean.alias(value))


def decimate_array(values: str | Column, k: int | Column) -> Column:
    """decimate() over an array, without a shuffle."""
    k = F.lit(k) if isinstance(k, int) else k

    def mean(seen: Column) -> Column:
        return F.try_divide(F.aggregate(seen, F.lit(0.0), lambda s, x: s + x), F.size(seen).cast("double"))

    def blocks(v: Column, n: Column) -> Column:
        block = lambda i: let(F.filter(F.slice(v, F.size(v) - (n - i) * k + 1, k), lambda x: x.isNotNull()), mean)
        return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), block))

    return let(col(values), lambda v: let(F.floor(F.size(v) / k).cast("int"), lambda n: blocks(v, n)))


def mask_blocks(points: DataFrame, keys: list[str], k: int, step: str = "step", real: str = "real") -> DataFrame:
    """A coarse step is real only if all its k native steps are."""
    n = F.count("*").over(Window.partitionBy(*keys))
    block = F.floor((F.col(step) - (n - F.floor(n / k) * k)) / k)
    return points.withColumn("_b", block).where("_b >= 0").groupBy(*keys, F.col("_b").cast("long").alias(step)).agg(F.every(real).alias(real))


def hold(values: str | Column, k: int | Column, h: int | Column) -> Column:
    """Each coarse value for k native steps, h in all."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.slice(F.flatten(F.transform(col(values), lambda v: F.array_repeat(v, k))), 1, h)


def decimated_window(context: str | Column, target: str | Column, k: int, least_context: int) -> Column:
    """STRUCT<context, target> read at k times the step: the target is the last size(target) * k native steps in blocks, the context the rest, both right-aligned;
    as given if the context would be shorter than least_context."""
    c, t = col(context), col(target)
    full, p = F.concat(c, t), F.size(t)
    cut = F.size(full) - p * k
    coarse = F.struct(decimate_array(F.slice(full, 1, F.greatest(cut, F.lit(0))), k).alias("context"), decimate_array(F.slice(full, F.greatest(cut, F.lit(0)) + 1, p * k), k).alias("target"))
    return F.when(F.floor(cut / k) >= least_context, coarse).otherwise(F.struct(c.alias("context"), t.alias("target")))


def resplit(context: str | Column, target: str | Column, real: str | Column, h: int) -> Column:
    """STRUCT<context, target> with the last h steps as target; as given if a step that isn't real would enter the context."""
    c, t, m = col(context), col(target), col(real)
    full = F.concat(c, t)
    moved = F.struct(F.slice(full, 1, F.size(full) - h).alias("context"), F.slice(full, F.size(full) - h + 1, h).alias("target"))
    fits = (F.size(full) >= h) & F.forall(F.slice(m, 1, F.greatest(F.size(t) - h, F.lit(0))), lambda x: x)
    return F.when(fits, moved).otherwise(F.struct(c.alias("context"), t.alias("target")))


def ordinal(date: str | Column, unit: str) -> Column:
    """Running number of a date's period: A year, M month, Q quarter, W week, D day (1 is the first day of year 1)."""
    d = col(date)
    day = F.datediff(d, F.lit("0001-01-01").cast("date")) + 1
    # Days before the Gregorian reform aren't met: dates are proleptic.
    return {"A": F.year(d), "M": F.year(d) * 12 + F.month(d), "Q": F.year(d) * 4 + F.quarter(d), "W": F.floor(day / 7).cast("int"), "D": day}[unit]


def infer_step(points: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    """keys, minutes: the median difference of consecutive times, in whole minutes."""
    w = Window.partitionBy(*keys).orderBy(seconds)
    gaps = points.withColumn("_d", F.col(seconds) - F.lag(seconds).over(w)).where("_d IS NOT NULL")
    return gaps.groupBy(*keys).agg(F.rint(F.median("_d") / 60).cast("long").alias("minutes"))
