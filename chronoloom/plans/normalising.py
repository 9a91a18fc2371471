"""Normalisation, context statistics and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import norm
from .base import arrays, gappy, query, shifted, vec

_R = "round({} * 1000000) / 1000000"
_FRAME = "SELECT series, coalesce(avg(value), 0) AS center, coalesce(stddev_pop(value), 0) + 0.00001 + 0.000001 * abs(coalesce(avg(value), 0)) AS scale FROM gappy GROUP BY series"


@query(f"SELECT series, {_R.format('center')} AS center, {_R.format('scale')} AS scale FROM (SELECT series, center, scale FROM ({_FRAME.replace('FROM gappy', 'FROM $gappy')}))")
def asinh_frame(spark, sf_dir):
    return norm.frame(gappy(spark, sf_dir), ["series"]).select("series", rounded("center").alias("center"), rounded("scale").alias("scale"))


@query(f"SELECT g.series, g.step, CASE WHEN value IS NULL THEN 0.0 ELSE {_R.format('asinh((value - center) / scale)')} END AS z FROM $gappy g JOIN ({_FRAME}) f ON f.series = g.series")
def asinh_norm(spark, sf_dir):
    g = gappy(spark, sf_dir)
    return norm.into(g, norm.frame(g, ["series"]), ["series"]).select("series", "step", rounded("z").alias("z"))


@query("""
WITH m AS (SELECT series, median(value) AS med, stddev_pop(value) AS sd FROM $gappy GROUP BY series),
d AS (SELECT g.series, median(abs(value - med)) AS mad FROM gappy g JOIN m ON m.series = g.series GROUP BY g.series)
SELECT m.series, round(med * 1000000) / 1000000 AS center, round((CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END + 0.00001 + 0.000001 * abs(med)) * 1000000) / 1000000 AS scale FROM m JOIN d ON d.series = m.series""")
def robust_frame(spark, sf_dir):
    return norm.frame(gappy(spark, sf_dir), ["series"], robust=True).select("series", rounded("center").alias("center"), rounded("scale").alias("scale"))


@query("""
SELECT series, token, round(mean * 1000000) / 1000000 AS center, round((sqrt(greatest(sq - (mean - shift) * (mean - shift), 0)) + 0.00001 + 0.000001 * abs(mean)) * 1000000) / 1000000 AS scale FROM (
  SELECT series, token, avg(shift) AS shift, sum(sum(value)) OVER w / greatest(sum(count(value)) OVER w, 1) AS mean, sum(sum((value - shift) * (value - shift))) OVER w / greatest(sum(count(value)) OVER w, 1) AS sq
  FROM (SELECT series, step // 8 AS token, value, avg(value) OVER (PARTITION BY series) AS shift FROM $shifted) GROUP BY series, token WINDOW w AS (PARTITION BY series ORDER BY token ROWS UNBOUNDED PRECEDING))""")
def causal_norm(spark, sf_dir):
    return norm.causal_frame(shifted(spark, sf_dir), ["series"], 8).select("series", "token", rounded("center").alias("center"), rounded("scale").alias("scale"))


_ROBUST = """
m AS (SELECT series, quantile_disc(value, 0.5) AS med, coalesce(stddev_samp(value), 0) AS sd, min(value) AS lo, max(value) AS hi FROM shifted GROUP BY series),
d AS (SELECT s.series, quantile_disc(abs(value - med), 0.5) * 1.4826 AS sigma FROM shifted s JOIN m ON m.series = s.series GROUP BY s.series),
r AS (SELECT m.series, med, lo, hi, greatest(CASE WHEN sigma > 0.01 * sd THEN sigma ELSE greatest(0.1 * sd, 0.001) END, 0.001) AS scale FROM m JOIN d ON d.series = m.series)"""


@query(f"WITH {_ROBUST.replace('FROM shifted GROUP', 'FROM $shifted GROUP')} SELECT series, {_R.format('med')} AS median, {_R.format('scale')} AS scale FROM r")
def robust_scale(spark, sf_dir):
    return norm.robust_scale(shifted(spark, sf_dir), ["series"]).select("series", rounded("median").alias("median"), rounded("scale").alias("scale"))


@query(f"WITH {_ROBUST.replace('FROM shifted GROUP', 'FROM $shifted GROUP')} SELECT s.series, step, {_R.format('asinh((value - med) / scale)')} AS z, {_R.format('least(greatest(sinh(3 * asinh((value - med) / scale)) * scale + med, lo - 10 * greatest(hi - lo, scale)), hi + 10 * greatest(hi - lo, scale))')} AS back FROM shifted s JOIN r ON r.series = s.series")
def robust_roundtrip(spark, sf_dir):
    s = shifted(spark, sf_dir)
    j = s.join(norm.robust_scale(s, ["series"]), "series").withColumn("z", norm.robust_into("value", "median", "scale"))
    return j.select("series", "step", rounded("z").alias("z"), rounded(norm.robust_out(3 * F.col("z"), "median", "scale", "lo", "hi")).alias("back"))


@query("SELECT series, step, round((sinh(least(greatest(value * 100, -15.0), 15.0)) * 2.5 + 1.0) / 1000 * 1000000) / 1000000 AS value FROM $vec")
def inverse_frame(spark, sf_dir):
    return vec(spark, sf_dir).select("series", "step", rounded(norm.out_of(F.col("value") * 100, F.lit(1.0), F.lit(2.5)) / 1000).alias("value"))


@query(f"SELECT series, step, {_R.format('(value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 0.00001)')} AS z FROM $vec WINDOW w AS (PARTITION BY series)")
def revin(spark, sf_dir):
    return norm.instance_norm(vec(spark, sf_dir), ["series"]).select("series", "step", rounded("z").alias("z"))


@query(f"SELECT series, step, {_R.format('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS z FROM $vec WINDOW w AS (PARTITION BY series)")
def z_score(spark, sf_dir):
    return norm.z_score(vec(spark, sf_dir), ["series"]).select("series", "step", rounded("z").alias("z"))


@query(f"""
SELECT g.series, {_R.format("count(*) FILTER (WHERE value = 0) / greatest(count(value), 1)::DOUBLE")} AS zeros, {_R.format("(1 - count(value) / count(*)::DOUBLE)")} AS missing, {_R.format("asinh(max(center) / max(scale))")} AS level,
       {_R.format("max(CASE WHEN step = 63 THEN coalesce(asinh((value - center) / scale), 0) END)")} AS last, {_R.format("ln(greatest(count(value), 1)) / ln(1024.0)")} AS observed
FROM $gappy g JOIN ({_FRAME}) f ON f.series = g.series GROUP BY g.series""")
def context_stats(spark, sf_dir):
    g = gappy(spark, sf_dir)
    out = norm.context_stats(g, norm.frame(g, ["series"]), ["series"], 1024)
    return out.select("series", *(rounded(c).alias(c) for c in ("zeros", "missing", "level", "last", "observed")))


@query("SELECT series, span, CASE WHEN span <= 8 * 2 THEN 2 WHEN span <= 8 * 7 THEN 7 ELSE 8 END AS patch FROM (SELECT series, 64 - min(CASE WHEN value IS NOT NULL THEN step END) AS span FROM $gappy GROUP BY series)")
def patch_choice(spark, sf_dir):
    return norm.choose_patch(gappy(spark, sf_dir), ["series"], [2, 7, 8], 8)


@query("SELECT series, list(p ORDER BY b) AS patches FROM (SELECT series, step // 8 AS b, list(value ORDER BY step) AS p FROM $vec GROUP BY 1, 2) GROUP BY series")
def patches(spark, sf_dir):
    return arrays(spark, sf_dir).select("series", norm.patches("values", 8).alias("patches"))


@query("""
WITH p AS (SELECT series, step, value FROM $vec UNION ALL SELECT series, 64 + j, value FROM vec CROSS JOIN (SELECT unnest(range(2)) AS j) WHERE step = 63)
SELECT series, list(l ORDER BY b) AS patches FROM (SELECT p.series, b, list(p.value ORDER BY p.step) AS l FROM p JOIN (SELECT unnest(range(10)) AS b) s ON p.step >= b * 6 AND p.step < b * 6 + 12 GROUP BY 1, 2) GROUP BY series""")
def strided_patches(spark, sf_dir):
    return arrays(spark, sf_dir).select("series", norm.patches("values", 12, 6).alias("patches"))


@query("""
WITH p AS (SELECT series, step // 8 AS b, step % 8 AS i, value FROM $vec)
SELECT series, step, round(avg(value) * 1000000) / 1000000 AS value FROM (SELECT series, b * 4 + i AS step, value FROM p) WHERE step < 30 GROUP BY 1, 2""")
def unpatch(spark, sf_dir):
    p = arrays(spark, sf_dir).select("series", norm.patches("values", 8).alias("patches"))
    return norm.unpatch(p, ["series"], 4, 30).select("series", "step", rounded("value").alias("value"))


@query("""
WITH c AS (SELECT series, token, mean AS center, sqrt(greatest(sq - (mean - shift) * (mean - shift), 0)) + 0.00001 + 0.000001 * abs(mean) AS scale FROM (
  SELECT series, token, avg(shift) AS shift, sum(sum(value)) OVER w / greatest(sum(count(value)) OVER w, 1) AS mean, sum(sum((value - shift) * (value - shift))) OVER w / greatest(sum(count(value)) OVER w, 1) AS sq
  FROM (SELECT series, step // 16 AS token, value, avg(value) OVER (PARTITION BY series) AS shift FROM $shifted) GROUP BY series, token WINDOW w AS (PARTITION BY series ORDER BY token ROWS UNBOUNDED PRECEDING)))
SELECT s.series, c.token, CAST(step % 16 AS INT) AS i, round(asinh((value - center) / scale) * 1000000) / 1000000 AS target, c.token >= 1 AS scored FROM shifted s JOIN c ON c.series = s.series AND c.token = step // 16 - 1""")
def next_patch(spark, sf_dir):
    return norm.next_patch_targets(shifted(spark, sf_dir), ["series"], 16, 1).withColumn("target", rounded("target"))
