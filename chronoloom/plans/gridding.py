"""Re-gridding and resampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frequency import rate_factor
from ..functions.scalars import rounded
from ..operators import grid
from .base import arrays, days, gappy, gappy_arrays, hour_arrays, hourly, observed_hours, query, table, vec


@query("""
WITH o AS (SELECT l_suppkey AS series, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 30 AS step, max_by(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS value FROM lineitem GROUP BY 1, 2),
g AS (SELECT series, unnest(range(CAST(lo AS BIGINT), CAST(hi + 1 AS BIGINT))) AS step FROM (SELECT series, min(step) AS lo, max(step) AS hi FROM o GROUP BY series))
SELECT g.series, g.step, o.value FROM g LEFT JOIN o ON o.series = g.series AND o.step = g.step""")
def grid_scatter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    step = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")) / 30).cast("long")
    return grid.scatter(li.select(F.col("l_suppkey").alias("series"), step.alias("step"), F.col("l_quantity").alias("value"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).alias("at")), ["series"], arrival="at")


@query("SELECT s.series, g.step, d.value FROM (SELECT series, max(step) AS hi FROM $days GROUP BY series) s, LATERAL (SELECT unnest(range(CAST(s.hi + 1 AS BIGINT))) AS step) g LEFT JOIN days d ON d.series = s.series AND d.step = g.step")
def grid_zero_based(spark, sf_dir):
    return grid.scatter(days(spark, sf_dir), ["series"], zero_based=True)


@query("""
WITH f AS (SELECT user_id AS series, date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) AS step, min_by(value, event_id) AS value FROM events GROUP BY 1, 2),
g AS (SELECT series, unnest(range(CAST(lo AS BIGINT), CAST(hi + 1 AS BIGINT), 60)) AS step FROM (SELECT series, min(step) AS lo, max(step) AS hi FROM f GROUP BY series))
SELECT g.series, g.step, f.value FROM g LEFT JOIN f ON f.series = g.series AND f.step = g.step""")
def grid_reindex(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").alias("step"), "value", "event_id")
    return grid.reindex(e, ["series"], 60, arrival="event_id")


@query("""
WITH b AS (SELECT series, step // 6 AS bin, avg(value) AS value FROM $observed_hours GROUP BY 1, 2),
g AS (SELECT series, unnest(range(CAST(lo AS BIGINT), CAST(hi + 1 AS BIGINT))) AS bin FROM (SELECT series, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY series))
SELECT g.series, g.bin, round(b.value * 1000000) / 1000000 AS value FROM g LEFT JOIN b ON b.series = g.series AND b.bin = g.bin""")
def tumbling_mean(spark, sf_dir):
    return grid.tumbling_mean(observed_hours(spark, sf_dir), ["series"], 6).select("series", "bin", rounded("value").alias("value"))


@query("""
WITH b AS (SELECT series, step // 7 AS bin, CASE WHEN count(value) >= 7 THEN sum(value) END AS value FROM $days GROUP BY 1, 2),
s AS (SELECT series, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY series),
g AS (SELECT series, unnest(range(CAST(lo + 1 AS BIGINT), CAST(hi AS BIGINT))) AS bin FROM s)
SELECT g.series, g.bin, b.value FROM g LEFT JOIN b ON b.series = g.series AND b.bin = g.bin""")
def tumbling_sum_mincount(spark, sf_dir):
    return grid.tumbling_sum(days(spark, sf_dir), ["series"], 7, 7)


@query("""
WITH e AS (SELECT user_id AS series, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step FROM events),
c AS (SELECT series, step, count(*) AS n FROM e GROUP BY 1, 2), b AS (SELECT series, max(step) AS hi FROM c GROUP BY series HAVING sum(n) >= 60),
g AS (SELECT series, unnest(range(CAST(hi + 1 AS BIGINT))) AS step FROM b)
SELECT g.series, g.step, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON c.series = g.series AND c.step = g.step""")
def bin_count(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("step"))
    return grid.bin_counts(e, ["series"], 60)


@query("SELECT series, step // 10 AS block, round(sqrt(avg(value * value)) * 1000000) / 1000000 AS value FROM $vec GROUP BY 1, 2 HAVING count(*) = 10")
def block_rms(spark, sf_dir):
    return grid.block_rms(vec(spark, sf_dir), ["series"], 10).select("series", "block", rounded("value").alias("value"))


@query("SELECT series, (step - 1) // 7 AS step, round(avg(value) * 1000000) / 1000000 AS value FROM $gappy WHERE step >= 1 GROUP BY 1, 2")
def decimate_right(spark, sf_dir):
    return grid.decimate(gappy(spark, sf_dir), ["series"], 7).select("series", "step", rounded("value").alias("value"))


@query("SELECT series, (step - 4) // 5 AS step, CASE WHEN count(value) = 5 THEN round(avg(value) * 1000000) / 1000000 END AS value FROM $gappy WHERE step >= 4 GROUP BY 1, 2")
def decimate_strict(spark, sf_dir):
    return grid.decimate(gappy(spark, sf_dir), ["series"], 5, strict=True).select("series", "step", rounded("value").alias("value"))


@query("SELECT series, list(value ORDER BY step) AS vals FROM (SELECT series, (step - 1) // 7 AS step, round(avg(value) * 1000000) / 1000000 AS value FROM $gappy WHERE step >= 1 GROUP BY 1, 2) GROUP BY series")
def decimate_arrays(spark, sf_dir):
    return gappy_arrays(spark, sf_dir).select("series", F.transform(grid.decimate_array("values", 7), lambda v: rounded(v)).alias("vals"))


@query("SELECT series, (step - 4) // 5 AS step, bool_and(value IS NOT NULL) AS real FROM $gappy WHERE step >= 4 GROUP BY 1, 2")
def decimate_mask(spark, sf_dir):
    return grid.mask_blocks(gappy(spark, sf_dir).withColumn("real", F.col("value").isNotNull()), ["series"], 5)


@query("SELECT series, list(value ORDER BY step, j) FILTER (WHERE step * 3 + j < 50) AS held FROM $vec CROSS JOIN (SELECT unnest(range(3)) AS j) GROUP BY series")
def hold_upsample(spark, sf_dir):
    return arrays(spark, sf_dir).select("series", grid.hold("values", 3, 50).alias("held"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE greatest(1, CAST(round_even(24.0 / (p_size / 10.0) / (p_partkey % 7), 0) AS INT)) END AS k FROM part")
def rate_rule(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rate_factor(F.col("p_size") / 10, (F.col("p_partkey") % 7).cast("double")).alias("k"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INT) AS a, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS m, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INT) AS q, CAST((date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719163) // 7 AS INT) AS w, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719163 AS INT) AS n FROM orders")
def period_ordinal(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", *(grid.ordinal("d", u).cast("int").alias(n) for u, n in (("A", "a"), ("M", "m"), ("Q", "q"), ("W", "w"), ("D", "n"))))


@query("SELECT series, CAST(round_even(median(d) / 60, 0) AS BIGINT) AS minutes FROM (SELECT user_id AS series, epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))) AS d FROM events) WHERE d IS NOT NULL GROUP BY series")
def step_infer(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', date_trunc('SECOND', ts))").alias("seconds"))
    return grid.infer_step(e, ["series"])


@query("SELECT series, step // 24 AS block, round(stddev_pop(value) * 1000000) / 1000000 AS value FROM $hourly GROUP BY 1, 2 HAVING count(*) = 24")
def amplitude_profile(spark, sf_dir):
    return grid.amplitude_profile(hourly(spark, sf_dir), ["series"], 24).select("series", "block", rounded("value").alias("value"))


@query("""
SELECT series, list(c ORDER BY b) FILTER (WHERE b < 162) AS context, list(c ORDER BY b) FILTER (WHERE b >= 162) AS target FROM (
  SELECT series, step // 4 AS b, round(avg(value) * 1000000) / 1000000 AS c FROM $hourly GROUP BY 1, 2) GROUP BY series""")
def decimated_window(spark, sf_dir):
    a = hour_arrays(spark, sf_dir).select("series", F.slice("values", 1, 702).alias("c"), F.slice("values", 703, 18).alias("t"))
    w = a.select("series", grid.decimated_window("c", "t", 4, 32).alias("w"))
    return w.select("series", *(F.transform(f"w.{x}", lambda v: rounded(v)).alias(x) for x in ("context", "target")))


@query("SELECT series, list(value ORDER BY step) FILTER (WHERE step < CASE WHEN series % 2 = 0 THEN 56 ELSE 48 END) AS context, list(value ORDER BY step) FILTER (WHERE step >= CASE WHEN series % 2 = 0 THEN 56 ELSE 48 END) AS target FROM $vec GROUP BY series")
def horizon_resplit(spark, sf_dir):
    a = arrays(spark, sf_dir).select("series", F.slice("values", 1, 48).alias("c"), F.slice("values", 49, 16).alias("t"))
    real = F.transform(F.col("t"), lambda v, i: (F.col("series") % 2 == 0) | (i > 3))
    return a.withColumn("real", real).select("series", grid.resplit("c", "t", "real", 8).alias("w")).select("series", "w.context", "w.target")
