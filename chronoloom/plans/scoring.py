"""Forecasts and their scores, on the last four cuts of the hourly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import forecast as fc
from ..operators import metrics as mt
from .base import arrays, cut_steps, cuts, fans, query, table

_KEYS = ["series", "origin"]
_R = "round({} * 1000000) / 1000000"
_PIN = "greatest(level * (y - q), (level - 1) * (y - q))"


def _scored(spark, sf_dir):
    return fans(spark, sf_dir).withColumn("loss", mt.pinball("y", "q", "level")).withColumnRenamed("i", "step")


def _targets(spark, sf_dir):
    return cut_steps(spark, sf_dir).withColumnRenamed("i", "step")


@query(f"SELECT series, {_R.format('sum(abs(y - naive)) / greatest(sum(abs(y)), 0.000000001)')} AS wql, count(y) AS observed, count(DISTINCT origin) AS cuts FROM $cut_steps WHERE naive IS NOT NULL GROUP BY series")
def naive_backtest(spark, sf_dir):
    """Hourly means, four cuts a series, the seasonal naive of a day, and its weighted quantile loss."""
    t = _targets(spark, sf_dir).where("naive IS NOT NULL")
    w = mt.naive_wql(t.select(*_KEYS, "step", F.col("naive").alias("q")), t, _KEYS, ["series"])
    n = t.groupBy("series").agg(F.count("y").alias("observed"), F.count_distinct("origin").alias("cuts"))
    return w.join(n, "series").select("series", rounded("wql_naive").alias("wql"), "observed", "cuts")


@query("SELECT series, origin, context, target FROM $cuts")
def eval_cuts(spark, sf_dir):
    return cuts(spark, sf_dir)


@query("SELECT series, origin, CAST(count(*) AS INT) AS h, count(y) AS observed FROM $cut_steps GROUP BY 1, 2")
def cut_cross(spark, sf_dir):
    return cuts(spark, sf_dir).select("series", "origin", F.size("target").alias("h"), F.size(F.filter("target", lambda v: v.isNotNull())).cast("long").alias("observed"))


@query("SELECT series, origin, list(naive ORDER BY i) AS naive FROM $cut_steps GROUP BY 1, 2")
def seasonal_naive(spark, sf_dir):
    return cuts(spark, sf_dir).select("series", "origin", fc.seasonal_naive("context", 48, 24).alias("naive"))


@query("SELECT c.series, c.origin, list(coalesce(h.value, 0.0) ORDER BY i) AS naive FROM (SELECT DISTINCT series, origin FROM $cut_steps) c CROSS JOIN (SELECT unnest(range(48)) AS i) JOIN hourly h ON h.series = c.series AND h.step = 720 - (c.origin + 1) * 48 - 16 + i % 16 GROUP BY 1, 2")
def clamped_naive(spark, sf_dir):
    return cuts(spark, sf_dir).select("series", "origin", fc.clamped_naive("context", 48, F.lit(1.5)).alias("naive"))


@query("SELECT c.series, c.origin, list(h.value ORDER BY i) AS naive FROM (SELECT DISTINCT series, origin FROM $cut_steps) c CROSS JOIN (SELECT unnest(range(48)) AS i) JOIN hourly h ON h.series = c.series AND h.step = 720 - (c.origin + 1) * 48 - 7 + i % 7 GROUP BY 1, 2")
def lag_copy(spark, sf_dir):
    return cuts(spark, sf_dir).select("series", "origin", fc.lag_copy("context", 48, 7).alias("naive"))


def _fans(spark, sf_dir, name):
    """series, block and fans of eight levels: the embeddings' steps eight by eight."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.slice("values", b * 8 + 1, F.lit(8)))
    return arrays(spark, sf_dir).select("series", F.posexplode(blocks).alias("block", name))


@query("SELECT series, CAST(block AS INT) AS block, list(round((a - b) / 2 * 1000000) / 1000000 ORDER BY i) AS q FROM (SELECT x.series, x.step // 8 AS block, x.step % 8 AS i, x.value AS a, y.value * 0.5 AS b FROM $vec x JOIN vec y ON y.series = x.series AND y.step = x.step // 8 * 8 + 7 - x.step % 8) GROUP BY series, block")
def flip_average(spark, sf_dir):
    mirrored = F.transform("q", lambda v: v * 0.5)
    return _fans(spark, sf_dir, "q").select("series", "block", F.transform(fc.flip_average("q", mirrored), lambda v: rounded(v)).alias("q"))


@query("""
WITH p AS (SELECT series, step // 8 AS block, step % 8 AS i, value, ln(1 + exp(value)) AS w FROM $vec), m AS (SELECT series, block, value AS med FROM p WHERE i = 4)
SELECT p.series, CAST(p.block AS INT) AS block, list(round((CASE WHEN p.i = 4 THEN med WHEN p.i < 4 THEN med - s ELSE med + s END) * 1000000) / 1000000 ORDER BY p.i) AS fan FROM (
  SELECT a.series, a.block, a.i, sum(b.w) AS s FROM p a JOIN p b ON b.series = a.series AND b.block = a.block AND ((a.i < 4 AND b.i BETWEEN a.i AND 3) OR (a.i > 4 AND b.i BETWEEN 5 AND a.i) OR (a.i = 4 AND b.i = 4)) GROUP BY 1, 2, 3) p JOIN m ON m.series = p.series AND m.block = p.block GROUP BY 1, 2""")
def monotone_fan(spark, sf_dir):
    return _fans(spark, sf_dir, "raw").select("series", "block", F.transform(fc.monotone_fan("raw", 4, 8), lambda v: rounded(v)).alias("fan"))


@query("SELECT x.series, CAST(x.step // 8 AS INT) AS block, list(round((m.value + (0.5 + x.step % 8 * 0.125) * (x.value - m.value)) * 1000000) / 1000000 ORDER BY x.step) AS q FROM $vec x JOIN vec m ON m.series = x.series AND m.step = x.step // 8 * 8 + 4 GROUP BY 1, 2")
def fan_calibration(spark, sf_dir):
    return _fans(spark, sf_dir, "q").select("series", "block", F.transform(fc.calibrate("q", [0.5 + 0.125 * i for i in range(8)]), lambda v: rounded(v)).alias("q"))


@query("SELECT series, list(value ORDER BY step) FILTER (WHERE step IN (0, 4, 8)) AS q FROM $vec GROUP BY series")
def level_subset(spark, sf_dir):
    levels = [round(0.1 * i, 1) for i in range(1, 10)]
    return arrays(spark, sf_dir).select("series", fc.pick_levels("values", levels, [0.1, 0.5, 0.9]).alias("q"))


@query("SELECT series, min(step) AS pass FROM (SELECT series, step, value, min(value) OVER (PARTITION BY series) AS m FROM $vec) WHERE value = m GROUP BY 1")
def adaptive_depth(spark, sf_dir):
    from .base import vec

    losses = vec(spark, sf_dir).select("series", F.col("step").alias("pass"), F.col("value").alias("loss"))
    return fc.best_pass(losses, ["series"])


@query(f"SELECT series, origin, {_R.format(f'2 * avg({_PIN})')} AS loss FROM $fans GROUP BY 1, 2")
def pinball(spark, sf_dir):
    return mt.pinball_loss(_scored(spark, sf_dir), _KEYS).withColumn("loss", rounded("loss"))


@query(f"SELECT series, {_R.format(f'sum({_PIN}) / (count({_PIN}) / 9.0) / 9')} AS loss FROM $fans GROUP BY 1")
def training_pinball(spark, sf_dir):
    return mt.training_pinball(_scored(spark, sf_dir), ["series"]).withColumn("loss", rounded("loss"))


@query(f"SELECT series, {_R.format('2 * avg(l) / greatest(max(t), 0.000000001)')} AS wql FROM (SELECT series, level, sum({_PIN}) AS l, sum(abs(y)) AS t FROM $fans GROUP BY 1, 2) GROUP BY 1")
def wql(spark, sf_dir):
    return mt.wql(_scored(spark, sf_dir), ["series"]).withColumn("wql", rounded("wql"))


_SCORES = f"SELECT a.series, wql / greatest(wql_naive, 0.000000001) AS score FROM (SELECT series, 2 * avg(l) / greatest(max(t), 0.000000001) AS wql FROM (SELECT series, level, sum({_PIN}) AS l, sum(abs(y)) AS t FROM $fans GROUP BY 1, 2) GROUP BY 1) a JOIN (SELECT series, sum(abs(y - naive)) / greatest(sum(abs(y)), 0.000000001) AS wql_naive FROM cut_steps GROUP BY 1) b ON b.series = a.series"


def _scores(spark, sf_dir):
    t = _targets(spark, sf_dir)
    return mt.subset_scores(_scored(spark, sf_dir), t.select(*_KEYS, "step", F.col("naive").alias("q")), t, _KEYS, ["series"])


@query(f"SELECT series, {_R.format('score')} AS score FROM ({_SCORES})")
def subset_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("series", rounded("score").alias("score"))


@query(f"SELECT {_R.format('exp(avg(ln(greatest(score, 0.000001))))')} AS overall, count(*) AS subsets FROM ({_SCORES})")
def overall_score(spark, sf_dir):
    return mt.overall(_scores(spark, sf_dir)).withColumn("overall", rounded("overall"))


@query(f"SELECT series, origin, round(sum(greatest(y - naive, 0) * 0.5 + greatest(naive - y, 0) * 0.5) / greatest(count(y - naive), 1) * 1000000000) / 1000000000 AS loss FROM $cut_steps GROUP BY 1, 2")
def naive_loss(spark, sf_dir):
    c = cuts(spark, sf_dir).withColumn("naive", fc.seasonal_naive("context", 48, 24))
    return mt.naive_loss(c, _KEYS).withColumn("loss", rounded("loss", 9))


@query("SELECT p_partkey, round(p_size / (p_retailprice + 0.001) * 1000000) / 1000000 AS ratio, round(ln((p_size + 0.001) / (p_partkey % 9 + 1 + 0.001)) * 1000000) / 1000000 AS log_ratio FROM part")
def score_losses(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("loss"), F.col("p_retailprice").alias("size"), (F.col("p_partkey") % 9 + 1).alias("base"), F.lit(1.0).alias("scale"))
    return mt.score_loss(p).select("p_partkey", rounded("ratio").alias("ratio"), rounded("log_ratio").alias("log_ratio"))


@query(f"""
SELECT series, {_R.format('avg(CASE WHEN y IS NOT NULL THEN CASE WHEN y >= lo AND y <= hi THEN 1.0 WHEN lo IS NOT NULL THEN 0.0 END END)')} AS cover, {_R.format('avg(hi - lo) / greatest(avg(abs(y - mid)), 0.000000001)')} AS width FROM (
  SELECT series, origin, i, max(y) AS y, max(q) FILTER (WHERE level = 0.1) AS lo, max(q) FILTER (WHERE level = 0.9) AS hi, max(q) FILTER (WHERE level = 0.5) AS mid FROM $fans GROUP BY 1, 2, 3) GROUP BY 1""")
def interval_coverage(spark, sf_dir):
    s = _scored(spark, sf_dir).drop("naive", "origin_")
    return mt.coverage(s, ["series"]).select("series", rounded("cover").alias("cover"), rounded("width").alias("width"))


@query(f"SELECT part, series, {_R.format('2 * avg(l) / greatest(max(t), 0.000000001)')} AS wql FROM (SELECT CASE WHEN i < 10 THEN 0 WHEN i < 19 THEN 1 WHEN i < 29 THEN 2 WHEN i < 38 THEN 3 ELSE 4 END AS part, series, level, sum({_PIN}) AS l, sum(abs(y)) AS t FROM $fans GROUP BY 1, 2, 3) GROUP BY 1, 2")
def horizon_parts(spark, sf_dir):
    return mt.wql(mt.horizon_parts(_scored(spark, sf_dir), 48, 5), ["part", "series"]).withColumn("wql", rounded("wql"))


@query("""
WITH c AS (SELECT p_partkey, p_size / 20.0::DOUBLE + 0.01 AS reg, (p_partkey % 7 + 1) / 5.0::DOUBLE AS ours, (p_partkey % 5 + 1) / 4.0::DOUBLE AS naive, (p_partkey % 3) / 2.0::DOUBLE AS cover, (p_partkey % 11)::DOUBLE AS width FROM part),
e AS (SELECT quantile_cont(reg, 0.0) AS e0, quantile_cont(reg, 1.0 / 3) AS e1, quantile_cont(reg, 2.0 / 3) AS e2, quantile_cont(reg, 1.0) AS e3 FROM c),
r AS (SELECT 1 AS tercile, e0 AS lo, e1 AS hi FROM e UNION ALL SELECT 2, e1, e2 FROM e UNION ALL SELECT 3, e2, e3 FROM e)
SELECT tercile, round(lo * 1000000) / 1000000 AS lo, round(hi * 1000000) / 1000000 AS hi, count(*) AS n, round(exp(avg(ln(least(greatest(ours / naive, 0.001), 1000)))) * 1000000) / 1000000 AS loss_vs_naive, round(avg(cover) * 1000000) / 1000000 AS cover, median(width) AS width
FROM c JOIN r ON reg >= lo AND reg <= hi GROUP BY 1, r.lo, r.hi""")
def regularity_terciles(spark, sf_dir):
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select((F.col("p_size") / 20 + 0.01).alias("reg"), ((k % 7 + 1) / 5).alias("ours"), ((k % 5 + 1) / 4).alias("naive"), ((k % 3) / 2).alias("cover"), (k % 11).cast("double").alias("width"))
    return mt.terciles(c).select("tercile", rounded("lo").alias("lo"), rounded("hi").alias("hi"), "n", rounded("loss_vs_naive").alias("loss_vs_naive"), rounded("cover").alias("cover"), "width")


@query("""
WITH p AS (SELECT x.series, x.step, x.value + 0.5 AS f, y.value AS y FROM $vec x JOIN vec y ON y.series = x.series AND y.step = x.step + 2),
j AS (SELECT p.series, g.lag, p.f - y.y AS e FROM p CROSS JOIN (SELECT unnest(range(-4, 5)) AS lag) g JOIN p y ON y.series = p.series AND y.step = p.step - g.lag),
m AS (SELECT series, lag, e, avg(e) OVER (PARTITION BY series, lag) AS mean FROM j),
s AS (SELECT series, lag, avg(abs(e - mean)) AS s, count(*) AS n, avg(abs(e)) AS m, abs(avg(e)) AS l FROM m GROUP BY 1, 2),
z AS (SELECT series, m AS mase, l AS level, s AS shape FROM s WHERE lag = 0),
b AS (SELECT s.series, s.lag, s.s, row_number() OVER (PARTITION BY s.series ORDER BY s.s, s.lag) AS r FROM s JOIN z ON z.series = s.series WHERE lag <> 0 AND n >= 31 AND s.s < 0.95 * shape)
SELECT z.series, round(mase * 1000000) / 1000000 AS mase, round(level * 1000000) / 1000000 AS level, round(shape * 1000000) / 1000000 AS shape, CAST(coalesce(b.lag, 0) AS INT) AS lag, round(coalesce(b.s, shape) * 1000000) / 1000000 AS lag_shape FROM z LEFT JOIN b ON b.series = z.series AND b.r = 1""")
def error_parts(spark, sf_dir):
    a = arrays(spark, sf_dir)
    pairs = a.select("series", F.posexplode(F.zip_with(F.slice("values", 1, 62), F.slice("values", 3, 62), lambda x, y: F.struct((x + 0.5).alias("f"), y.alias("y")))).alias("step", "x"))
    pairs = pairs.select("series", F.col("step").cast("long").alias("step"), "x.f", "x.y", F.lit(1.0).alias("scale"))
    out = mt.error_parts(pairs, ["series"], 4)
    return out.select("series", *(rounded(c).alias(c) for c in ("mase", "level", "shape")), "lag", rounded("lag_shape").alias("lag_shape"))


@query("SELECT subset, round(avg(CASE WHEN abs(value * 15) > 2 THEN 1.0 ELSE 0.0 END) * 1000000) / 1000000 AS share, round(avg(1 / sqrt(1 + value * 15 * value * 15)) * 1000000) / 1000000 AS weight, round(sum(CASE WHEN abs(value * 15) > 2 THEN abs(value * 15) ELSE 0 END) / sum(abs(value * 15)) * 1000000) / 1000000 AS mass FROM $gappy WHERE value IS NOT NULL GROUP BY 1")
def tail_stats(spark, sf_dir):
    from .base import gappy

    out = mt.tail_stats(gappy(spark, sf_dir).withColumn("z", F.col("value") * 15), ["subset"])
    return out.select("subset", *(rounded(c).alias(c) for c in ("share", "weight", "mass")))


@query(f"SELECT series, origin, round(avg({_PIN}) * 1000) / 1000 AS loss FROM $fans GROUP BY 1, 2 ORDER BY avg({_PIN}) DESC NULLS LAST, series, origin LIMIT 7")
def worst_items(spark, sf_dir):
    return mt.item_losses(_scored(spark, sf_dir), _KEYS, 7).withColumn("loss", rounded("loss", 3))


@query(f"SELECT series, {_R.format('avg((naive - y) * (naive - y))')} AS mse, {_R.format('avg(abs(naive - y))')} AS mae FROM $cut_steps GROUP BY 1")
def point_errors(spark, sf_dir):
    out = mt.point_errors(cut_steps(spark, sf_dir), ["series"], "naive", "y")
    return out.select("series", rounded("mse").alias("mse"), rounded("mae").alias("mae"))


@query()
def forecast_registry(spark, sf_dir):
    """All registered forecasters, scored against the naive: each cut is forecast by all of them where it lies, so the cuts are made once."""
    q = fc.forecast_by(cuts(spark, sf_dir), sorted(fc.REGISTRY), 48, 24)
    s = mt.wql(mt.scored(fc.long_quantiles(q, ["forecaster", *_KEYS]), _targets(spark, sf_dir), _KEYS), ["forecaster", "series"])
    return s.select("forecaster", "series", rounded("wql").alias("wql"))


@query()
def rate_mix(spark, sf_dir):
    """Forecasts mixed over coarser and finer rates, weights pooled by series."""
    m = fc.mix_rates(cuts(spark, sf_dir), "state_space", 48, 24, pool=["series"])
    return m.select("series", "origin", F.transform("quantiles", lambda q: F.transform(q, lambda v: rounded(v, 4))).alias("quantiles"), F.transform(F.array_sort(F.map_entries("weights")), lambda e: F.struct(e["key"].alias("rate"), rounded(e["value"], 4).alias("weight"))).alias("weights"))


@query()
def rate_knob(spark, sf_dir):
    """The state-space filter at w / k: context and horizon stay native, the step size alone changes; k is that of least loss on the past."""
    out = fc.knob(cuts(spark, sf_dir), 48, 24, (1, 2, 4))
    return out.select("series", "origin", "k", F.transform("forecast", lambda v: rounded(v)).alias("forecast"))


@query("SELECT count(*) AS configs, count(*) = (SELECT count(*) FROM $own) AS complete FROM $own o JOIN $rival r ON r.config = o.config")
def completeness_gate(spark, sf_dir):
    """A comparison is refused unless every configuration is there; here some aren't."""
    from ..operators import board
    from .base import own, rival

    have = own(spark, sf_dir).join(rival(spark, sf_dir).select("config"), "config", "left_semi")
    wanted = own(spark, sf_dir).count()
    try:
        board.require(have, wanted)
        complete = True
    except ValueError:
        complete = False
    return have.agg(F.count("*").alias("configs")).withColumn("complete", F.lit(complete))


@query("SELECT series, origin, list(v ORDER BY i) AS naive FROM (SELECT c.series, c.origin, i.i, round(avg(h.value) * 1000000) / 1000000 AS v FROM (SELECT DISTINCT series, origin FROM $cut_steps) c CROSS JOIN (SELECT unnest(range(48)) AS i) i JOIN hourly h ON h.series = c.series AND h.step >= 720 - (c.origin + 1) * 48 - 24 + ((i.i // 4) % 6) * 4 AND h.step < 720 - (c.origin + 1) * 48 - 24 + ((i.i // 4) % 6) * 4 + 4 GROUP BY 1, 2, 3) GROUP BY 1, 2")
def fixed_rate(spark, sf_dir):
    return cuts(spark, sf_dir).select("series", "origin", F.transform(fc.naive_at_rate("context", 48, 24, 4), lambda v: rounded(v)).alias("naive"))


@query("""
WITH c AS (SELECT series || '/' || CAST(origin AS VARCHAR) AS id, series, origin, context, target FROM $cuts),
x AS (SELECT id, series, unnest(context) AS value FROM c), p AS (SELECT * FROM x WHERE value IS NOT NULL),
m AS (SELECT id, series, quantile_disc(value, 0.5) AS med, coalesce(stddev_samp(value), 0) AS sd FROM p GROUP BY 1, 2),
d AS (SELECT p.id, quantile_disc(abs(value - med), 0.5) * 1.4826 AS sigma FROM p JOIN m ON m.id = p.id GROUP BY 1),
r AS (SELECT m.id, series, med, greatest(CASE WHEN sigma > 0.01 * sd THEN sigma ELSE greatest(0.1 * sd, 0.001) END, 0.001) AS scale FROM m JOIN d ON d.id = m.id),
z AS (SELECT r.series, abs((t.y - med) / scale) AS z FROM (SELECT id, unnest(target) AS y FROM c) t JOIN r ON r.id = t.id WHERE t.y IS NOT NULL)
SELECT l.series, n, ctx_median, ctx_q10, ctx_short, share, weight, mass FROM (SELECT series, count(*) AS n, median(least(len(context), 1024)) AS ctx_median, quantile_cont(least(len(context), 1024), 0.1) AS ctx_q10, avg(CASE WHEN least(len(context), 1024) < 600 THEN 1.0 ELSE 0.0 END) AS ctx_short FROM c GROUP BY 1) l
JOIN (SELECT series, round(avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END) * 1000000) / 1000000 AS share, round(avg(1 / sqrt(1 + z * z)) * 1000000) / 1000000 AS weight, round(sum(CASE WHEN z > 2 THEN z ELSE 0 END) / sum(z) * 1000000) / 1000000 AS mass FROM z GROUP BY 1) t ON t.series = l.series""")
def config_stats(spark, sf_dir):
    from ..operators.norm import config_stats as stats

    c = cuts(spark, sf_dir).withColumn("id", F.concat_ws("/", "series", F.col("origin").cast("string")))
    out = stats(c, ["series"], short=600)
    return out.select("series", "n", "ctx_median", "ctx_q10", "ctx_short", *(rounded(x).alias(x) for x in ("share", "weight", "mass")))


@query("""
WITH c AS (SELECT series, origin, origin + 1 AS k, list_reverse(list_transform(context, lambda x: coalesce(x, 0))) AS back FROM $cuts),
b AS (SELECT series, origin, k, j.j, list_avg(list_slice(back, CAST(j.j * k + 1 AS INT), CAST((j.j + 1) * k AS INT))) AS v FROM c CROSS JOIN (SELECT unnest(range(24)) AS j) j WHERE j.j < 24 // k),
s AS (SELECT DISTINCT series, origin, k FROM c)
SELECT s.series, s.origin, i.i AS step, round(b.v * 1000000) / 1000000 AS middle FROM s CROSS JOIN (SELECT unnest(range(48)) AS i) i JOIN b ON b.series = s.series AND b.origin = s.origin AND b.j = 24 // s.k - 1 - (i.i // s.k) % (24 // s.k)""")
def mixed_sizes(spark, sf_dir):
    """The cuts of origin o, missing hours as 0, read in blocks of o + 1 hours; the middle quantile is the naive of the block means."""
    c = cuts(spark, sf_dir).withColumn("size", (F.col("origin") + 1).cast("int")).withColumn("context", F.transform("context", lambda v: F.coalesce(v, F.lit(0.0))))
    q = fc.long_quantiles(fc.forecast_by_size(c, "seasonal_naive", 48, 24, "size"), _KEYS)
    return q.where("level = 0.5").select("series", "origin", F.col("step").cast("long").alias("step"), rounded("q").alias("middle"))


@query()
def multivariate_forecast(spark, sf_dir):
    """The five event types as one item: clicks are the target, views known ahead, the rest past covariates; joint and single scores."""
    from ..operators import items

    c = cuts(spark, sf_dir).withColumn("role", F.when(F.col("series") == "click", 0).when(F.col("series") == "view", 2).otherwise(1)).withColumnRenamed("origin", "item_id")
    c = c.withColumn("item_id", F.col("item_id").cast("long")).withColumn("member_pos", F.when(F.col("role") == 0, 0).otherwise(F.length("series")).cast("int"))
    targets = c.where("role = 0").select("item_id", F.posexplode("target").alias("step", "y"))
    naive = c.where("role = 0").withColumn("n", fc.seasonal_naive("context", 48, 24)).select("item_id", F.posexplode("n").alias("step", "q"))
    joint = fc.long_quantiles(items.forecast_items(c, 48, 24), ["item_id"])
    single = fc.long_quantiles(items.forecast_items(c.where("role = 0"), 48, 24), ["item_id"])
    out = mt.joint_and_single(joint, single, targets, naive, ["item_id"], ["item_id"])
    return out.select("item_id", rounded("joint").alias("joint"), rounded("single").alias("single"))
