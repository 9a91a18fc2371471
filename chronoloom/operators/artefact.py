"""Models as versioned tables of arrays: written whole or not at all, and checked when they are read.

    <path>/version=3/arrays     name, shape, values, digest: a row an array
    <path>/version=3/manifest   format, arrays, digest: a single row, written last; a version without it doesn't exist
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
_ARRAYS, _MANIFEST = "name string, shape array<int>, values array<double>, digest string", "format int, arrays long, digest string"


def _digest() -> Column:
    """Of an array's name, shape and exact values (-0.0 isn't 0.0, NaNs are alike)."""
    return F.sha2(F.to_json(F.struct("name", "shape", F.transform("values", lambda v: v.cast("string")).alias("values"))), 256)


def _summary(arrays: DataFrame) -> DataFrame:
    """One row: number of arrays, and a digest that doesn't depend on their order."""
    parts = [F.sum(F.conv(F.substring("digest", i * 8 + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return arrays.agg(F.count("*").alias("arrays"), F.concat_ws("-", *parts).alias("digest"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(at(f"{path}/{n}/manifest/_SUCCESS")))


def save_arrays(arrays: DataFrame, path: str) -> int:
    """Writes arrays (name, shape, values) as the next version below path and returns its number. Readers see it once its manifest is there; what a failed writer left is
    written over. Names must differ and values fill their shapes, else it is an error and nothing is committed."""
    spark = arrays.sparkSession
    version = max(_versions(spark, path), default=0) + 1
    typed = arrays.select(F.col("name").cast("string").alias("name"), F.col("shape").cast("array<int>").alias("shape"), F.col("values").cast("array<double>").alias("values"))
    typed.withColumn("digest", _digest()).write.mode("overwrite").parquet(f"{path}/version={version}/arrays")
    written = spark.read.schema(_ARRAYS).parquet(f"{path}/version={version}/arrays")
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)
    bad, names, rows = written.agg(F.count_if(F.coalesce(size != F.size("values"), F.lit(True)) | F.col("name").isNull()), F.count_distinct("name"), F.count("*")).first()
    if bad or names != rows:
        raise ValueError(f"{bad} arrays don't fill their shapes, {rows - names} names are there twice")
    _summary(written).select(F.lit(FORMAT).alias("format"), "arrays", "digest").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}/manifest")
    return version


def load_arrays(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """name, shape, values of a version (by default the last one), once all digests agree; a missing, further or changed array is an error."""
    there = _versions(spark, path)
    version = version if version is not None else max(there, default=None)
    if version not in there:
        raise ValueError(f"{path} has no version {version if version is not None else ''}".rstrip())
    arrays = spark.read.schema(_ARRAYS).parquet(f"{path}/version={version}/arrays")
    said = spark.read.schema(_MANIFEST).parquet(f"{path}/version={version}/manifest").first()
    if said["format"] != FORMAT:
        raise ValueError(f"format {said['format']} instead of {FORMAT}")
    changed = [r["name"] for r in arrays.where(F.col("digest") != _digest()).select("name").limit(10).collect()]
    if changed:
        raise ValueError(f"arrays {changed} have changed")
    now = _summary(arrays).first()
    if (now["arrays"], now["digest"]) != (said["arrays"], said["digest"]):
        raise ValueError(f"{now['arrays']} arrays instead of the {said['arrays']} that were written, or others")
    return arrays.select("name", "shape", "values")


def save_model(spark: SparkSession, path: str, parameters: dict[str, np.ndarray]) -> int:
    rows = [(k, list(map(int, np.shape(v))), np.ravel(v).astype(float).tolist()) for k, v in parameters.items()]
    return save_arrays(spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1), path)


def load_model(spark: SparkSession, path: str, expected: dict[str, tuple[int, ...]] | set[str] | None = None, version: int | None = None) -> dict[str, np.ndarray]:
    """The arrays of a model, which is small by nature: they come to the driver. Names that are missing or unexpected, or other shapes than expected, are an error."""
    got = {r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in load_arrays(spark, path, version).collect()}
    if expected is not None and set(got) != set(expected):
        raise ValueError(f"missing {sorted(set(expected) - set(got))}, unexpected {sorted(set(got) - set(expected))}")
    if isinstance(expected, dict) and (other := {k: got[k].shape for k, s in expected.items() if got[k].shape != tuple(s)}):
        raise ValueError(f"other shapes than expected: {other}")
    return got
