"""Cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import clean
from ..sources import corpus
from .base import arrays, configs, days, gappy, gappy_arrays, hour_arrays, query, shifted, table, vec


@query("SELECT subset, count(*) AS n_series, CAST(count(*) * 64 AS BIGINT) AS n_obs, 64 AS median_length FROM (SELECT DISTINCT series, subset FROM $vec) GROUP BY subset")
def scan_manifest(spark, sf_dir):
    return corpus.manifest_of(arrays(spark, sf_dir))


@query("SELECT series, step, value FROM $vec WHERE subset IN (1, 3)")
def scan_subsets(spark, sf_dir):
    return vec(spark, sf_dir).where(F.col("subset").isin(1, 3)).select("series", "step", "value")


@query("SELECT CAST(subset AS VARCHAR) AS subset FROM $vec GROUP BY subset HAVING count(value) > 0 AND CAST(subset AS VARCHAR) NOT IN ('m5', 'fred_md')")
def scan_train_subsets(spark, sf_dir):
    m = corpus.manifest_of(arrays(spark, sf_dir)).withColumn("subset", F.col("subset").cast("string"))
    return corpus.train_subsets(m)


@query("SELECT series, step, CASE WHEN step % 9 = 0 OR step % 7 = 0 THEN NULL ELSE value END AS value FROM $vec")
def canon_nonfinite(spark, sf_dir):
    v = vec(spark, sf_dir)
    broken = F.when(F.col("step") % 9 == 0, F.lit(float("nan"))).when(F.col("step") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return clean.canonical(v.withColumn("value", broken)).select("series", "step", "value")


@query("SELECT series, step, value FROM $gappy g JOIN (SELECT series AS s, min(step) AS lo, max(step) AS hi FROM gappy WHERE value IS NOT NULL GROUP BY series) ON s = series AND step BETWEEN lo AND hi")
def span_trim(spark, sf_dir):
    return clean.observed_span(gappy(spark, sf_dir), ["series"]).select("series", "step", "value")


@query("SELECT series, CAST(max(step) - min(step) + 1 AS INT) AS n, count(*) AS observed FROM $gappy WHERE value IS NOT NULL GROUP BY series")
def span_trim_arrays(spark, sf_dir):
    v = gappy_arrays(spark, sf_dir).select("series", clean.trim_array("values").alias("v"))
    return v.select("series", F.size("v").alias("n"), F.size(F.filter("v", lambda x: x.isNotNull())).cast("long").alias("observed"))


@query("SELECT series, step, value FROM $gappy WHERE series IN (SELECT series FROM gappy GROUP BY series HAVING count(value) >= 54)")
def min_obs(spark, sf_dir):
    return clean.min_observed(gappy(spark, sf_dir), ["series"], 54).select("series", "step", "value")


@query("SELECT series, step, CASE WHEN series % 3 = 0 THEN 5.0 ELSE value END AS value FROM $vec WHERE series % 3 <> 0")
def constant_filter(spark, sf_dir):
    v = vec(spark, sf_dir).withColumn("value", F.when(F.col("series") % 3 == 0, 5.0).otherwise(F.col("value")))
    return clean.not_constant(v, ["series"]).select("series", "step", "value")


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) || '.5' END AS DOUBLE) AS value FROM events")
def numeric_coercion(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "events").select("event_id", clean.numeric(text).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size IN (9, 19, 49) THEN NULL ELSE p_size END AS value FROM part")
def sentinel_null(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", clean.without("p_size", 9, 19, 49).alias("value"))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN value END AS value FROM events")
def quality_mask(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", clean.flagged("value", F.col("user_id") % 4).alias("value"))


@query("SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) > 16")
def high_variety(spark, sf_dir):
    return clean.many_values(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], 16, "l_quantity").select("l_suppkey").distinct()


@query("SELECT series FROM $gappy GROUP BY series HAVING avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) > 0.85")
def completeness(spark, sf_dir):
    return clean.complete(gappy(spark, sf_dir), ["series"], 0.85).select("series").distinct()


@query("SELECT c_custkey FROM customer WHERE CAST('0x' || substr(md5(c_name), 1, 2) AS INT) % 18 = 0")
def hash_bucket_sample(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(clean.hash_bucket(F.md5("c_name"), 18)).select("c_custkey")


@query("SELECT subset, series FROM (SELECT subset, series, row_number() OVER (PARTITION BY subset ORDER BY md5('7:' || CAST(series AS VARCHAR)), series) AS nth FROM (SELECT DISTINCT subset, series FROM $vec)) WHERE nth <= 5")
def ranked_sample(spark, sf_dir):
    return clean.seeded_sample(arrays(spark, sf_dir).select("subset", "series"), ["subset"], "series", 5, 7)


@query("""
WITH n AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, c_custkey FROM n WHERE n <= 4 OR i IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1)""")
def even_sample(spark, sf_dir):
    return clean.even_sample(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 4)


@query("""
WITH h AS (SELECT s_nationkey, s_suppkey, CAST('0x' || substr(md5(CAST(s_nationkey AS VARCHAR) || ':' || CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 AS keep FROM supplier)
SELECT s_nationkey, s_suppkey FROM h WHERE keep OR (s_nationkey NOT IN (SELECT s_nationkey FROM h WHERE keep) AND s_suppkey IN (SELECT min(s_suppkey) FROM h GROUP BY s_nationkey))""")
def fixed_draw(spark, sf_dir):
    return clean.fixed_draw(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey", 0.3)


@query("SELECT series, list(CASE WHEN series % 2 = 0 THEN -1.0 ELSE 1.0 END * value ORDER BY step) AS flipped FROM $vec GROUP BY series")
def sign_flip(spark, sf_dir):
    return arrays(spark, sf_dir).select("series", clean.flip("values", F.when(F.col("series") % 2 == 0, -1.0).otherwise(1.0)).alias("flipped"))


@query("SELECT series, list_concat(list_transform(range(36), lambda i: NULL::DOUBLE), list(value ORDER BY step)) AS padded, list(value ORDER BY step) FILTER (WHERE step >= 40) AS cut FROM $vec GROUP BY series")
def left_pad(spark, sf_dir):
    return arrays(spark, sf_dir).select("series", clean.left_pad("values", 100).alias("padded"), clean.left_pad("values", 24).alias("cut"))


@query("SELECT series, CASE WHEN min(value) < -0.3 THEN list(value - 0.1 ORDER BY step) ELSE list(greatest(value - 0.1, 0.0) ORDER BY step) END AS clipped FROM $vec GROUP BY series")
def nonneg_clip(spark, sf_dir):
    a = arrays(spark, sf_dir)
    lower = F.transform("values", lambda v: v - 0.1)
    context = F.transform("values", lambda v: v + 0.3)
    return a.select("series", clean.not_below_zero(lower, context).alias("clipped"))


@query("""
WITH m AS (SELECT series, step, CASE WHEN step % 5 <> 0 THEN 7.0 ELSE step * 1.0 + series % 3 END AS value FROM $vec WHERE step > 0),
v AS (SELECT series, step, CASE WHEN value = 7.0 THEN NULL ELSE value END AS v FROM m)
SELECT series, step, round(CASE WHEN v IS NOT NULL THEN v WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (step - s0) / (s1 - s0) END * 1000000) / 1000000 AS value FROM (
  SELECT series, step, v, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1,
         last_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER b AS s0, first_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER a AS s1
  FROM v WINDOW b AS (PARTITION BY series ORDER BY step ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY series ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def placeholder_interp(spark, sf_dir):
    m = vec(spark, sf_dir).where("step > 0").withColumn("value", F.when(F.col("step") % 5 != 0, 7.0).otherwise(F.col("step") * 1.0 + F.col("series") % 3))
    return clean.placeholders(m, ["series"]).select("series", "step", rounded("value").alias("value"))


@query("SELECT series, list(value ORDER BY step) FILTER (WHERE step BETWEEN lo AND hi) AS vals FROM $gappy JOIN (SELECT series AS s, min(step) AS lo, max(step) AS hi FROM gappy WHERE value IS NOT NULL GROUP BY series HAVING count(*) >= 16) ON s = series GROUP BY series")
def corpus_writer(spark, sf_dir):
    kept = corpus.keepable(gappy_arrays(spark, sf_dir))
    return kept.select("series", F.transform("values", lambda v: v.cast("double")).alias("vals"))


@query("SELECT series FROM $vec GROUP BY series HAVING max(CASE WHEN series % 4 = 0 AND step = 5 THEN 1 ELSE 0 END) = 0")
def corpus_writer_strict(spark, sf_dir):
    a = arrays(spark, sf_dir).withColumn("values", F.transform("values", lambda v, i: F.when((F.col("series") % 4 == 0) & (i == 5), float("inf")).otherwise(v)))
    return corpus.keepable(a, drop_infinite=True).select("series")


@query("SELECT series, subset FROM (SELECT subset, series, sum(n) OVER (PARTITION BY subset ORDER BY series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT subset, series, count(*) AS n FROM $vec GROUP BY 1, 2)) WHERE coalesce(b, 0) < 500")
def observation_cap(spark, sf_dir):
    return corpus.within_cap(arrays(spark, sf_dir).select("series", "subset", F.size("values").alias("n_obs")), 500, "series").select("series", "subset")


@query("SELECT subset, row_number() OVER (PARTITION BY subset ORDER BY series) - 1 AS series_id, series AS old FROM (SELECT DISTINCT subset, series FROM $vec WHERE series % 6 <> 0)")
def merge_drop(spark, sf_dir):
    a = arrays(spark, sf_dir).select("subset", F.col("series").alias("series_id"), F.col("series").alias("old"))
    return corpus.drop_series(a, a.where("series_id % 6 = 0")).select("subset", "series_id", "old")


@query("""
SELECT rate, CAST(sum(n_obs) FILTER (WHERE NOT syn) AS BIGINT) AS real_obs, CAST(sum(n_obs) FILTER (WHERE syn) AS BIGINT) AS synth_obs, count(DISTINCT domain) FILTER (WHERE NOT syn) AS real_families,
       count(DISTINCT domain) FILTER (WHERE syn) AS synth_families, count(*) FILTER (WHERE NOT syn) AS real_series, count(*) FILTER (WHERE syn) AS synth_series
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN '15T' ELSE 'D' END AS rate, p_partkey % 5 = 0 AS syn, CAST(prediction_length AS BIGINT) AS n_obs FROM $configs) GROUP BY rate""")
def corpus_report(spark, sf_dir):
    k = F.col("p_partkey")
    m = configs(spark, sf_dir).select(F.concat(F.when(k % 5 == 0, "synth").otherwise("real"), F.lit("_"), F.translate("domain", "0123456789", ""), F.lit("_19"), F.lpad((k % 100).cast("string"), 2, "0")).alias("subset"), F.when(k % 3 == 0, "H").when(k % 3 == 1, "10T").otherwise("D").alias("freq"), F.col("prediction_length").cast("long").alias("n_obs"), F.lit(1).cast("long").alias("n_series"))
    return corpus.rate_report(m, {"H": 5.5, "15T": 4.5, "D": 3.9}).drop("share")


@query("SELECT subset, round(round(sqrt(count(value)) * 1000) ) / 1000 AS root, count(*) AS points FROM $shifted GROUP BY subset")
def level_points(spark, sf_dir):
    return shifted(spark, sf_dir).groupBy("subset").agg((F.round(F.sqrt(F.count("value")) * 1000) / 1000).alias("root"), F.count("*").alias("points"))


@query("SELECT series, CAST(count(*) AS INT) AS n, count(value) AS observed FROM $hourly GROUP BY series")
def series_roundtrip(spark, sf_dir):
    back = clean.to_series(clean.to_points(hour_arrays(spark, sf_dir)), ["series"])
    return back.select("series", F.size("values").alias("n"), F.size(F.filter("values", lambda v: v.isNotNull())).cast("long").alias("observed"))


@query("SELECT series, count(*) AS n FROM $days GROUP BY series")
def day_points(spark, sf_dir):
    return days(spark, sf_dir).groupBy("series").agg(F.count("*").alias("n"))
