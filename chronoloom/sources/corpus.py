"""The corpus: a Parquet table of series by subset, and its manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frequency import DEV_MULTI, DEV_SUBSETS, family, is_synthetic, rate_class
from ..functions.scalars import finite
from ..operators.clean import LEAST_OBSERVED, trim_array
from ..operators.order import renumbered

#: Observations of a subset after which no further batch is converted; subsets of which only the first shards are read, and how many (fixed values).
CAP = 400_000_000


def manifest_of(series: DataFrame, freqs: DataFrame | None = None) -> DataFrame:
    """subset, n_series, n_obs, median_length (truncated), and freq if freqs (subset, freq) are given."""
    out = series.groupBy("subset").agg(F.count("*").alias("n_series"), F.sum(F.size("values")).cast("long").alias("n_obs"), F.median(F.size("values")).cast("int").alias("median_length"))
    return out.join(freqs, "subset", "left") if freqs is not None else out


def keepable(series: DataFrame, drop_infinite: bool = False, drop_constant: bool = True, least: int = LEAST_OBSERVED, values: str = "values") -> DataFrame:
    """series trimmed to their observed spans, with enough observed values and, unless told otherwise, some spread. Infinite values become NULL, or with
    drop_infinite rule out their series."""
    s = series
    if drop_infinite:
        s = s.where(~F.exists(values, lambda v: F.coalesce(F.abs(v) == float("inf"), F.lit(False))))
    s = s.withColumn(values, trim_array(F.transform(values, lambda v: finite(v).cast("float"))))
    seen = F.filter(values, lambda v: v.isNotNull())
    s = s.where(F.size(seen) >= least)
    return s.where(F.array_max(seen) > F.array_min(seen)) if drop_constant else s


def within_cap(batches: DataFrame, cap: int = CAP, order: str = "batch", size: str = "n_obs") -> DataFrame:
    """Batches of a subset up to and with the one in which the running size reaches the cap."""
    w = Window.partitionBy("subset").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("_before") < cap).drop("_before")


def write(series: DataFrame, path: str) -> None:
    """The corpus table by subset; subsets in series replace their old files, others stay."""
    series.repartition("subset", F.floor(F.col("series_id") / 4096)).sortWithinPartitions("subset", "series_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subset").parquet(path)


def read(spark: SparkSession, path: str, subsets: list[str] | None = None) -> DataFrame:
    """subset, series_id, values; a list of subsets prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("subset").isin(*subsets)) if subsets is not None else df


def missing_subsets(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """What a rerun still has to do."""
    return wanted.join(manifest.select("subset"), "subset", "left_anti")


def train_subsets(manifest: DataFrame, multivariate: bool = False) -> DataFrame:
    """Subsets with observations that aren't held out."""
    held = (*DEV_SUBSETS, *(DEV_MULTI if multivariate else ()))
    return manifest.where((F.col("n_obs") > 0) & ~F.col("subset").isin(*held)).select("subset")


def merge(manifests: list[DataFrame]) -> DataFrame:
    """Union of manifests; a subset that two roots hold is an error."""
    out = manifests[0]
    for m in manifests[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    if twice := out.groupBy("subset").count().where("count > 1").head():
        raise ValueError(f"{twice['subset']} is in more than one root")
    return out


def drop_series(series: DataFrame, listed: DataFrame) -> DataFrame:
    """series without the listed (subset, series_id); ids are numbered anew per subset, in the old order, range by range."""
    kept = series.join(listed.select("subset", "series_id").distinct(), ["subset", "series_id"], "left_anti")
    return renumbered(kept, ["subset"], "series_id")


def rate_report(manifest: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rate, and of real and synthetic subsets the observations, families and series, with the share of draws of the rate."""
    synthetic = is_synthetic("subset")
    m = manifest.withColumn("rate", rate_class("freq")).withColumn("_f", family("subset")).withColumn("_s", synthetic)

    def of(flag: bool, agg, c: str) -> Column:
        return agg(F.when(F.col("_s") == flag, F.col(c)))

    out = m.groupBy("rate").agg(*(of(flag, agg, c).alias(f"{name}_{what}") for flag, name in ((False, "real"), (True, "synth")) for what, agg, c in (("obs", F.sum, "n_obs"), ("families", F.count_distinct, "_f"), ("series", F.sum, "n_series"))))
    w = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in weights.items() for x in p)), F.col("rate")), F.lit(0.0))
    return out.withColumn("share", w / F.sum(w).over(Window.partitionBy()))


def wanted_shard(path: Column, sliced: tuple[str, ...] = (), capped: tuple[str, ...] = (), cap: int = 12) -> Column:
    """Files to convert, by name <subset>/...-<shard>-of-...arrow: Arrow files; of sliced subsets the first shard, of capped ones the first cap."""
    subset, n = F.element_at(F.split(path, "/"), -2), F.regexp_extract(path, r"-(\d+)-of-\d+\.arrow$", 1).try_cast("int")
    out = path.endswith(".arrow")
    if sliced:
        out &= ~subset.isin(*sliced) | (F.coalesce(n, F.lit(0)) == 0)
    if capped:
        out &= ~subset.isin(*capped) | (F.coalesce(n, F.lit(0)) < cap)
    return out
