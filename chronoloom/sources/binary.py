"""Binary formats as series: what the readers of byte ranges (see ranges) give, put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges


def arrow_series(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, batch, row, freq, nested, variate, values of Arrow streams with a target list column; a target of lists (nested) gives a row per variate. freq is the first
    batch's."""
    return ranges.arrow_rows(spark, path, **options)


def arrow_items(rows: DataFrame) -> DataFrame:
    """rows of arrow_series() that belong to multivariate items: of each folder those before the first target without variates, in order of path, batch and row. A folder
    that begins with one has no items."""
    folder, at = F.regexp_replace("path", "/[^/]*$", ""), F.struct("path", "batch", "row")
    flat = rows.where(~F.col("nested")).groupBy(folder.alias("_f")).agg(F.min(at).alias("_end"))
    return rows.where("nested").join(flat, folder == F.col("_f"), "left").where(F.col("_end").isNull() | (at < F.col("_end"))).select(*rows.columns)


def npy_grids(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, channel, values of .npy files with an array of channels by steps (or one channel)."""
    return ranges.whole(ranges.npy_pieces(spark, path, **options), ["path", "channel"])


def csr_series(spark: SparkSession, path: str, **options) -> DataFrame:
    """subset, series_id, values of files named <subset>.values.npy and <subset>.offsets.npy."""
    return ranges.whole(ranges.csr_pieces(spark, path, **options), ["subset", "series_id"])


def archived_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, member, line_no, line of the text files in zip, tar, gz, xz and bz2 archives: what from_csv or the text readers go on with."""
    return ranges.archived_lines(spark, path, **options)
