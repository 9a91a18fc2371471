"""Windowed means, running frames and state-space filters over streams of (keys..., ts, step, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from .stateful import rocksdb


def _marked(stream: DataFrame, ts: str, late: str | None) -> DataFrame:
    return stream.withWatermark(ts, late) if late else stream


def windowed_mean(stream: DataFrame, keys: list[str], width: str, slide: str | None = None, late: str | None = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """keys, start, value, n per event-time window; rows later than the watermark are dropped (none without one, but then state is kept for ever)."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = _marked(stream, ts, late).groupBy(*keys, w.alias("w")).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "value", "n")


def sessions(stream: DataFrame, keys: list[str], gap: str, late: str | None = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """keys, start, end, n, value (sum) per session that a gap ends."""
    out = _marked(stream, ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("value"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


#: Rows of a key that are given on at once.
_FRAME = 10_000


def _in_order(frames: Iterator[pd.DataFrame], step: str, value: str) -> Iterator[pd.DataFrame]:
    """step and value of a key's rows of a micro-batch, ordered by step. Spark cuts a key's rows into frames wherever one is full, in the order in which a shuffle brought them, so all of
    a batch are put in order together; a task holds these two columns of one key, which the stream's maxFilesPerTrigger bounds. Batches are expected in order (see stateful for streams that aren't)."""
    rows = pd.concat([pdf[[step, value]] for pdf in frames], ignore_index=True).sort_values(step, kind="stable", ignore_index=True)
    for lo in range(0, len(rows), _FRAME):
        yield rows.iloc[lo : lo + _FRAME]


def running_frame(stream: DataFrame, key: str, step: str = "step", value: str = "value") -> DataFrame:
    """key, step, center, scale, z: each value in the frame of all values of its key up to and with it (Welford's sums as state). Rows of a micro-batch go by step."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in _in_order(frames, step, value):
            rows = []
            for s, v in pdf[[step, value]].itertuples(index=False):
                seen = v is not None and np.isfinite(v)
                if seen:
                    n += 1
                    d = v - mean
                    mean += d / n
                    m2 += d * (v - mean)
                scale = float(np.sqrt(m2 / max(n, 1))) + 1e-5 + 1e-6 * abs(mean)
                rows.append((k[0], s, mean, scale, float(np.arcsinh((v - mean) / scale)) if seen else 0.0))
            yield pd.DataFrame(rows, columns=[key, step, "center", "scale", "z"])
        state.update((n, mean, m2))

    kind = dict(stream.dtypes)
    schema = f"{key} {kind[key]}, {step} {kind[step]}, center double, scale double, z double"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)


def state_space(stream: DataFrame, key: str, a: list[complex], b: list[complex], c: list[complex], dt: float = 1.0, skip: float = 0.0, step: str = "step", value: str = "value") -> DataFrame:
    """key, step, y: a diagonal state-space filter, its complex state carried from frame to frame and from batch to batch; a missing value counts as 0."""
    from ..operators.recurrence import s4d_steps

    poles = [np.array(x, complex) for x in (a, b, c)]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = np.array(state.get[0]) + 1j * np.array(state.get[1]) if state.exists else None
        for pdf in _in_order(frames, step, value):
            y, x = s4d_steps(np.nan_to_num(pdf[value].to_numpy(float)), *poles, dt, skip, x)
            yield pd.DataFrame({key: k[0], step: pdf[step].to_numpy(), "y": y})
        if x is not None:
            state.update((x.real.tolist(), x.imag.tolist()))

    kind = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {step} {kind[step]}, y double", "re array<double>, im array<double>", "append", GroupStateTimeout.NoTimeout)


def replay(df: DataFrame, path: str, batches: int, order: str) -> DataFrame:
    """A stream that reads df back in files, the rows in order of a column: for tests and backfills. One file is one trigger's input. The table is sorted once, into as many
    ranges, which are then put into the stream's folder one after the other."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}-staged"
    df.repartitionByRange(batches, order).sortWithinPartitions(order).write.mode("overwrite").parquet(staged)
    for i, file in enumerate(sorted(spark.read.parquet(staged).inputFiles(), key=lambda f: f.rpartition("/")[2])):
        spark.read.schema(df.schema).parquet(file).coalesce(1).write.mode("append" if i else "overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """What a stream over files that are all there gives: it is run to its end, its state under path, and each batch's result kept there (of mode complete the last)."""
    spark, schema = stream.sparkSession, stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else number}")

    with rocksdb(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out").select(*stream.columns)


def append_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Writes each micro-batch, one row a key, under its own number, so that a repeated batch replaces itself: exactly once for whoever reads the folders. A key of two
    batches is there twice; upsert() merges them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64):
    """Merges each micro-batch into the table under path by key: of rows of one key that with the largest order stays (of equal ones the one with the largest values).

    The table is cut into buckets by a hash of the key; a batch rewrites only those that its keys fall into, from what they held and the batch, by way of a table
    beside it. Merging a batch again changes nothing, so a repeated batch is harmless. upserted() reads the table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # buckets at most
        if not touched:
            return
        held = _existing(spark, path, new)
        both = new.unionByName(held.where(F.col("bucket").isin(touched)).select(*new.columns)) if held is not None else new
        rest = F.struct(order, *(c for c in batch.columns if c not in (*keys, order)))
        merged = both.groupBy("bucket", *keys).agg(F.max(rest).alias("_r")).select("bucket", *keys, "_r.*").select(*new.columns)
        beside = f"{path}-merging"
        merged.write.mode("overwrite").parquet(beside)
        spark.read.schema(merged.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    return spark.read.schema(like.schema).parquet(path) if there else None


def upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that upsert() keeps under path."""
    return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path).select(*schema.names)
