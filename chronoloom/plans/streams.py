"""Streaming twins over the events table, read as a stream of files and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..streaming import operators as st
from ..streaming import stateful
from .base import place, query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream; the path stands for a file or a folder of them."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS start, round(avg(value) * 1000000) / 1000000 AS value, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = st.windowed_mean(_events(spark, sf_dir), ["event_type"], "6 hours", late=None)
    return st.drained(out, place(spark, "stream"), "complete").withColumn("value", rounded("value"))


@query("SELECT event_type, s.start + INTERVAL (15 * k) MINUTE AS start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01') - INTERVAL 45 MINUTE AS start FROM events) s CROSS JOIN (SELECT unnest(range(4)) AS k) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    out = st.windowed_mean(_events(spark, sf_dir), ["event_type"], "1 hour", "15 minutes", late=None)
    return st.drained(out, place(spark, "stream"), "complete").select("event_type", "start", "n")


@query("""
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value) * 1000000) / 1000000 AS value FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    out = st.sessions(_events(spark, sf_dir), ["user_id"], "2 hours", late=None)
    return st.drained(out, place(spark, "stream"), "complete").withColumn("value", rounded("value"))


@query("SELECT user_id, event_id, round((avg(value) OVER w + 0.000000123) * 1000000) / 1000000 AS center, round((stddev_pop(value) OVER w + 0.00001 + 0.000001 * abs(avg(value) OVER w)) * 1000000) / 1000000 AS scale FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def stream_running(spark, sf_dir):
    out = st.running_frame(_events(spark, sf_dir), "user_id", "event_id")
    # Means of hundredths lie on halves of the last digit; a little more on both sides keeps rounding from hanging on the last bit.
    return st.drained(out, place(spark, "stream"), "append").select("user_id", "event_id", rounded(F.col("center") + 1.23e-7).alias("center"), rounded("scale").alias("scale"))


@query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
k AS (SELECT j, sum(c * pow(exp(0.3 * a), j) * (exp(0.3 * a) - 1) / a * b) AS k FROM (SELECT unnest([-0.5, -0.1]::DOUBLE[]) AS a, unnest([1.0, 0.5]::DOUBLE[]) AS b, unnest([0.7, -0.2]::DOUBLE[]) AS c) CROSS JOIN (SELECT unnest(range((SELECT max(n) FROM e))) AS j) GROUP BY 1)
SELECT x.user_id, x.event_id, round(sum(k.k * coalesce(z.value, 0)) * 10000) / 10000 AS y FROM e x JOIN e z ON z.user_id = x.user_id AND z.n <= x.n JOIN k ON k.j = x.n - z.n GROUP BY 1, 2""")
def stream_state_space(spark, sf_dir):
    out = st.state_space(_events(spark, sf_dir), "user_id", [-0.5, -0.1], [1, 0.5], [0.7, -0.2], 0.3, step="event_id")
    return st.drained(out, place(spark, "stream"), "append").select("user_id", "event_id", rounded("y", 4).alias("y"))


def _disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of four files whose rows are up to six hours out of order, and a last row that closes it."""
    e = stateful.closed(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "ts", "3 DAYS")
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(6 * 3600))
    shuffled = e.withColumn("comes", F.unix_timestamp("ts") + F.when(F.col("event_id").isNull(), F.lit(10**9)).otherwise(jitter))
    return st.replay(shuffled, place(spark, "disordered"), 4, "comes").drop("comes")


_WAITS = {"step": "event_id", "late": "12 hours", "slot": 86400}


@query("SELECT user_id, event_id, round((avg(value) OVER w + 0.000000123) * 1000000) / 1000000 AS center, round((stddev_pop(value) OVER w + 0.00001 + 0.000001 * abs(avg(value) OVER w)) * 1000000) / 1000000 AS scale FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def stream_running_late(spark, sf_dir):
    """Running frames of rows that come out of order: they wait in state, and timers release them."""
    out = stateful.running_frame(_disordered(spark, sf_dir), "user_id", **_WAITS)
    return st.drained(out, place(spark, "stream"), "append").where("user_id IS NOT NULL").select("user_id", "event_id", rounded(F.col("center") + 1.23e-7).alias("center"), rounded("scale").alias("scale"))


_FILTERED = """
WITH e AS (SELECT user_id, event_id, value, {part} AS part, row_number() OVER (PARTITION BY user_id, {part} ORDER BY ts, event_id) AS n FROM {events}),
k AS (SELECT j, sum(c * pow(exp(0.3 * a), j) * (exp(0.3 * a) - 1) / a * b) AS k FROM (SELECT unnest([-0.5, -0.1]::DOUBLE[]) AS a, unnest([1.0, 0.5]::DOUBLE[]) AS b, unnest([0.7, -0.2]::DOUBLE[]) AS c) CROSS JOIN (SELECT unnest(range((SELECT max(n) FROM e))) AS j) GROUP BY 1)
SELECT x.user_id, x.event_id, round(sum(k.k * coalesce(z.value, 0)) * 10000) / 10000 AS y FROM e x JOIN e z ON z.user_id = x.user_id AND z.part = x.part AND z.n <= x.n JOIN k ON k.j = x.n - z.n GROUP BY 1, 2"""


@query(_FILTERED.format(part="0", events="events"))
def stream_state_space_late(spark, sf_dir):
    """The state-space filter over rows that come out of order."""
    out = stateful.state_space(_disordered(spark, sf_dir), "user_id", [-0.5, -0.1], [1, 0.5], [0.7, -0.2], 0.3, **_WAITS)
    return st.drained(out, place(spark, "stream"), "append").where("user_id IS NOT NULL").select("user_id", "event_id", rounded("y", 4).alias("y"))


@query(_FILTERED.format(part="part", events="(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events))"))
def stream_state_space_idle(spark, sf_dir):
    """The same, starting from rest after twelve hours without a row; a key's state goes by a timer."""
    out = stateful.state_space(_disordered(spark, sf_dir), "user_id", [-0.5, -0.1], [1, 0.5], [0.7, -0.2], 0.3, idle=12 * 3600, **_WAITS)
    return st.drained(out, place(spark, "stream"), "append").where("user_id IS NOT NULL").select("user_id", "event_id", rounded("y", 4).alias("y"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    """The last event of each user, kept by merging micro-batches by key."""
    path = place(spark, "upsert")
    stream = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    st.upsert(stream, f"{path}/table", f"{path}/state", ["user_id"], "event_id", 8).trigger(availableNow=True).start().awaitTermination()
    return st.upserted(spark, f"{path}/table", stream.schema)
