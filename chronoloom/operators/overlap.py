"""The overlap audit: rounded growth ratios as keys, alignment votes, affine duplicates.

Keys are the integer windows themselves, so there are no hash collisions and joins are plain equi-joins. Windows over one very long series would be one task;
fingerprints() therefore works on slices of a series with a halo, dealt by (series, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, finite, half_even

#: Ratios in a window, distinct ones it must have, and size from which on a ratio is none (fixed values).
WINDOW, DISTINCT, LARGEST = 8, 7, 1e6
#: Steps of a slice.
SLICE = 1 << 16


def _with_windows(df: DataFrame, values: str) -> DataFrame:
    """df with _x: the windows of ratios of an array of finite values that make a key, as STRUCT<pos, key>; pos is the window's place in the array. Each step is a
    column of its own: inside one expression the lambdas would work it out again for every element (so would the
    filter that the optimiser derives from an inner explode and pushes below the columns; hence the outer ones)."""
    none = F.array().cast("array<double>")
    ratio = F.transform(F.sequence(F.lit(1), F.size(values) - 1), lambda i: half_even(F.try_divide(F.get(values, i), F.get(values, i - 1)), 3))
    d = df.withColumn("_r", F.when(F.size(values) > WINDOW, ratio).otherwise(none))
    starts = F.when(F.size("_r") >= WINDOW, F.sequence(F.lit(1), F.size("_r") - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_w", F.transform(starts, lambda i: F.struct((i - 1).cast("long").alias("pos"), F.slice("_r", i, WINDOW).alias("w"))))
    good = F.filter("_w", lambda x: F.forall(x["w"], lambda v: v.isNotNull() & (v != 1.0) & (F.abs(v) < LARGEST)) & (F.size(F.array_distinct(x["w"])) >= DISTINCT))
    return d.withColumn("_x", F.transform(good, lambda x: F.struct(x["pos"].alias("pos"), F.transform(x["w"], lambda v: (v * 1000).cast("long")).alias("key"))))


def fingerprints(points: DataFrame, keys: list[str], step: str = "step", value: str = "value") -> DataFrame:
    """keys, pos, key: each window of WINDOW growth ratios (rounded to 3 digits) of the observed values that has no ratio 1, none that is undefined or huge, and at
    least DISTINCT different ones. pos counts observed values."""
    seen = points.withColumn(value, finite(value)).where(F.col(value).isNotNull())
    seen = seen.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(step)).cast("long") - 1)
    own = F.floor(F.col("_i") / SLICE).cast("long")
    halo = F.when((F.col("_i") % SLICE < WINDOW) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    sliced = seen.withColumn("_s", F.explode(halo)).groupBy(*keys, "_s").agg(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("v")))).alias("p"))
    windows = _with_windows(sliced.select(*keys, "_s", F.col("p.v").alias("_v")), "_v").select(*keys, "_s", F.explode_outer("_x").alias("x")).where("x IS NOT NULL")
    # A slice holds its own values and the first WINDOW of the next, so it has the windows that begin in it and no others.
    return windows.select(*keys, (F.col("_s") * SLICE + F.col("x.pos")).alias("pos"), F.col("x.key").alias("key"))


def array_fingerprints(series: DataFrame, values: str = "values") -> DataFrame:
    """The same for one row per series, without a shuffle: series' other columns, pos, key."""
    rest = [c for c in series.columns if c != values]
    seen = F.filter(F.transform(values, lambda v: finite(v)), lambda v: v.isNotNull())
    return _with_windows(series.select(*rest, seen.alias("_v")), "_v").select(*rest, F.explode_outer("_x").alias("x")).where("x IS NOT NULL").select(*rest, "x.pos", "x.key")


def index(windows: DataFrame, by: list[str]) -> DataFrame:
    """The distinct keys of each reference."""
    return windows.select(*by, "key").distinct()


def scan(windows: DataFrame, reference: DataFrame, keys: list[str], by: list[str], least: int = 3) -> DataFrame:
    """First pass: keys, by, shared, for series that share at least least distinct keys with a reference."""
    a = windows.select(*keys, "key").distinct()
    return a.join(index(reference, by), "key").groupBy(*keys, *by).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def first_pass(series: DataFrame, subset: str, id_: str, most_series: int | None = None, most_values: int | None = None, values: str = "values") -> DataFrame:
    """series that a first pass looks at: of each subset those with the most_series smallest ids, of each the first most_values values; None is no limit. Limits spare a first look
    time and lose what lies beyond them, so scan() has none of its own. The smallest ids are kept by a window that Spark limits before the shuffle."""
    out = series
    if most_series is not None:
        nth = F.row_number().over(Window.partitionBy(subset).orderBy(id_))
        out = out.withColumn("_nth", nth).where(F.col("_nth") <= most_series).drop("_nth")
    return out.withColumn(values, F.slice(values, 1, most_values)) if most_values is not None else out


def flagged(hits: DataFrame, subset: str, by: list[str]) -> DataFrame:
    """subset, by, series: how many series of a subset the first pass found."""
    return hits.groupBy(subset, *by).agg(F.count("*").alias("series"))


def verify(windows: DataFrame, reference: DataFrame, keys: list[str], by: list[str], least_hits: int = 3, least_aligned: int = 20) -> DataFrame:
    """keys, by, offset, aligned: the series with at least least_hits windows in the reference whose best vote on (by, offset = reference pos - pos) has at least
    least_aligned windows. Of equal votes the smallest by and offset stands. Pairs are summed by vote before anything is ranked."""
    pairs = windows.select(*keys, "pos", "key").join(reference.select(*by, F.col("pos").alias("_ref"), "key"), "key")
    hits = pairs.groupBy(*keys).agg(F.count_distinct("pos").alias("_hits")).where(F.col("_hits") >= least_hits)
    votes = pairs.groupBy(*keys, *by, (F.col("_ref") - F.col("pos")).alias("offset")).agg(F.count("*").alias("aligned"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("aligned")).alias("n"), *by, "offset")).alias("b")).where(-F.col("b.n") >= least_aligned)
    return best.join(hits.select(*keys), keys, "left_semi").select(*keys, *(F.col(f"b.{c}").alias(c) for c in (*by, "offset")), (-F.col("b.n")).alias("aligned"))


def affine_key(points: DataFrame, keys: list[str], step: str = "step", value: str = "value") -> DataFrame:
    """keys, key: a digest of the z-scores (population), rounded to 3 digits; series that differ by level and scale alone share it. NULL for a constant series."""
    w = Window.partitionBy(*keys)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    scored = points.withColumn("_z", F.coalesce(F.rint(z * 1000).cast("long"), F.lit(99000)))
    lists = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col("_z").alias("z")))).alias("p"), F.count_distinct(value).alias("_n"))
    return lists.select(*keys, F.when(F.col("_n") > 1, F.sha2(F.array_join(F.transform("p", lambda x: x["z"].cast("string")), ","), 256)).alias("key"))


def first_of_equals(keyed: DataFrame, id_: str, key: str = "key") -> DataFrame:
    """The smallest id per key; NULL keys are all different."""
    once = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias(id_)).select(id_)
    return once.union(keyed.where(F.col(key).isNull()).select(id_))


def enough_matches(found: str | Column, expected: str | Column, least: float = 0.95) -> Column:
    return (col(expected) == 0) | (col(found) >= least * col(expected))


def match_gate(found: int, expected: int, least: float = 0.95) -> None:
    """An error if too few of the variates that should be stored were found: the cut rule is then wrong."""
    if expected and found < least * expected:
        raise ValueError(f"only {found} of {expected} variates match the stored series")
