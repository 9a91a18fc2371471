"""Losses and scores of forecasts.

Long quantiles (keys, step, level, q) meet targets (keys, step, y) in one equi-join on keys and step; everything after it is partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, geomean_clipped, geomean_floored, safe_divide


def pinball(y: str | Column, q: str | Column, level: str | Column) -> Column:
    e = col(y) - col(q)
    return F.greatest(col(level) * e, (col(level) - 1) * e)


def scored(quantiles: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, level, y, loss; loss is NULL where the target is missing."""
    return quantiles.join(targets.select(*keys, "step", "y"), [*keys, "step"]).withColumn("loss", pinball("y", "q", "level"))


def pinball_loss(s: DataFrame, by: list[str], doubled: bool = True) -> DataFrame:
    """by, loss: mean over observed steps and levels (twice, if doubled)."""
    return s.groupBy(*by).agg(((2 if doubled else 1) * F.avg("loss")).alias("loss"))


def training_pinball(s: DataFrame, by: list[str]) -> DataFrame:
    """by, loss: the sum over observed steps and levels, over the number of observed steps (at least 1) and the number of levels."""
    steps = F.greatest(F.count("loss") / F.count_distinct("level"), F.lit(1.0))
    return s.groupBy(*by).agg((F.coalesce(F.sum("loss"), F.lit(0.0)) / steps / F.count_distinct("level")).alias("loss"))


def wql(s: DataFrame, by: list[str]) -> DataFrame:
    """by, wql: twice the mean over levels of the summed pinball loss, over the summed size of the targets; missing targets count in neither."""
    levels = s.groupBy(*by, "level").agg(F.sum("loss").alias("_l"), F.sum(F.abs("y")).alias("_y"))
    return levels.groupBy(*by).agg((2 * F.avg("_l") / F.greatest(F.max("_y"), F.lit(1e-9))).alias("wql"))


def naive_wql(naive: DataFrame, targets: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The same for one forecast copied to levels that are even about the middle: the mean of their losses is half the absolute error."""
    j = naive.join(targets.select(*keys, "step", "y"), [*keys, "step"])
    return j.groupBy(*by).agg((F.sum(F.abs(F.col("y") - F.col("q"))) / F.greatest(F.sum(F.abs("y")), F.lit(1e-9))).alias("wql_naive"))


def subset_scores(s: DataFrame, naive: DataFrame, targets: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, wql, wql_naive, score: the ratio of the two."""
    both = wql(s, by).join(naive_wql(naive, targets, keys, by), by)
    return both.withColumn("score", F.col("wql") / F.greatest("wql_naive", F.lit(1e-9)))


def overall(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.agg(geomean_floored(score).alias("overall"), F.count("*").alias("subsets"))


def naive_loss(cuts: DataFrame, keys: list[str], mean_level: float = 0.5) -> DataFrame:
    """keys, loss of a forecast array naive against target: over and under weighted by the mean level, per observed step."""
    pairs = cuts.select(*keys, F.explode(F.arrays_zip(F.col("target").alias("y"), F.col("naive").alias("q"))).alias("x")).select(*keys, (F.col("x.y") - F.col("x.q")).alias("_e"))
    per = F.greatest("_e", F.lit(0.0)) * mean_level + F.greatest(-F.col("_e"), F.lit(0.0)) * (1 - mean_level)
    return pairs.groupBy(*keys).agg((F.coalesce(F.sum(per), F.lit(0.0)) / F.greatest(F.count("_e"), F.lit(1))).alias("loss"))


def score_loss(losses: DataFrame, per: str = "loss", size: str = "size", base: str = "base", scale: str = "scale") -> DataFrame:
    """ratio and log_ratio per row: the loss over the mean size of the targets, and the log of its ratio to the naive's, both with a floor of a thousandth of the scale."""
    floor = 1e-3 * F.col(scale)
    return losses.withColumn("ratio", F.col(per) / (F.col(size) + floor)).withColumn("log_ratio", F.ln((F.col(per) + floor) / (F.col(base) + floor)))


def coverage(s: DataFrame, by: list[str], lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """by, cover, width: share of observed targets between the outer quantiles, and the mean distance of those over the mean error of the median (at least 1e-9)."""
    per = s.groupBy(*by, *[c for c in s.columns if c not in (*by, "level", "q", "loss", "y")]).agg(
        F.max("y").alias("y"), F.max(F.when(F.col("level") == lo, F.col("q"))).alias("lo"), F.max(F.when(F.col("level") == hi, F.col("q"))).alias("hi"), F.max(F.when(F.col("level") == 0.5, F.col("q"))).alias("mid"))
    inside = F.when(F.col("y").isNotNull(), ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("double"))
    return per.groupBy(*by).agg(F.avg(inside).alias("cover"), (F.avg(F.col("hi") - F.col("lo")) / F.greatest(F.avg(F.abs(F.col("y") - F.col("mid"))), F.lit(1e-9))).alias("width"))


def horizon_parts(s: DataFrame, h: int, parts: int) -> DataFrame:
    """s with part: the slice of the horizon, cut at even places rounded half to even."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: F.rint(i * (h / parts)).cast("int"))
    return s.withColumn("part", F.size(F.filter(edges, lambda e: e <= F.col("step"))) - 1).where(F.col("part") < parts)


def terciles(cuts: DataFrame, by: str = "reg") -> DataFrame:
    """tercile, lo, hi, n, loss_vs_naive, cover, width of rows (reg, ours, naive, cover, width). A row on an inner edge counts on both sides."""
    c = cuts.where("reg IS NOT NULL AND ours IS NOT NULL AND naive > 1e-6 AND reg > 1e-6 AND reg < 10")
    edges = c.agg(*(F.percentile(by, F.lit(p)).alias(f"e{i}") for i, p in enumerate((0.0, 1 / 3, 2 / 3, 1.0))))
    ranges = edges.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("tercile"), F.col(f"e{i}").alias("lo"), F.col(f"e{i + 1}").alias("hi")) for i in range(3)))).alias("r")).select("r.*")
    joined = c.join(F.broadcast(ranges), (F.col(by) >= F.col("lo")) & (F.col(by) <= F.col("hi")))  # three rows
    return joined.groupBy("tercile", "lo", "hi").agg(F.count("*").alias("n"), geomean_clipped(F.col("ours") / F.col("naive")).alias("loss_vs_naive"), F.avg("cover").alias("cover"), F.median("width").alias("width"))


def error_parts(pairs: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """keys, mase, level, shape, lag, lag_shape of rows (keys, step, f, y, scale): the mean absolute error, the mean error, the former without the latter, and the shift
    of the forecast at which that is least (positive: the forecast is late). A shift must beat 0.95 of the shape at 0, and overlap half the observed horizon; of
    equal ones the first from the most negative on stands."""
    n = pairs.groupBy(*keys).agg(F.count("*").alias("_h"))
    shifted = pairs.select(*keys, F.col("step"), "f", "scale", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("_s", F.col("step") - F.col("lag"))
    j = shifted.join(pairs.select(*keys, F.col("step").alias("_s"), "y"), [*keys, "_s"]).withColumn("_e", F.col("f") - F.col("y"))
    mean = F.avg("_e").over(Window.partitionBy(*keys, "lag"))
    per = j.withColumn("_d", F.abs(F.col("_e") - mean)).groupBy(*keys, "lag").agg((F.avg("_d") / F.max("scale")).alias("s"), F.count("_e").alias("_n"), (F.avg(F.abs("_e")) / F.max("scale")).alias("m"), (F.abs(F.avg("_e")) / F.max("scale")).alias("l"))
    per = per.join(n, keys)
    zero = per.where("lag = 0").select(*keys, F.col("m").alias("mase"), F.col("l").alias("level"), F.col("s").alias("shape"))
    others = per.where("lag <> 0").join(zero.select(*keys, "shape"), keys).where((F.col("_n") >= F.floor(F.col("_h") / 2)) & (F.col("s") < 0.95 * F.col("shape")))
    best = others.groupBy(*keys).agg(F.min(F.struct("s", "lag")).alias("b"))
    out = zero.join(best, keys, "left")
    return out.select(*keys, "mase", "level", "shape", F.coalesce("b.lag", F.lit(0)).alias("lag"), F.coalesce("b.s", "shape").alias("lag_shape"))


def tail_stats(df: DataFrame, by: list[str], z: str = "z", above: float = 2.0) -> DataFrame:
    """by, share (beyond above), weight (mean of 1 / sqrt(1 + z²)), mass (share of the summed size beyond above)."""
    a = F.abs(z)
    return df.where(F.col(z).isNotNull()).groupBy(*by).agg(F.avg((a > above).cast("double")).alias("share"), F.avg(1 / F.sqrt(1 + a * a)).alias("weight"), F.coalesce(safe_divide(F.sum(F.when(a > above, a).otherwise(0.0)), F.sum(a)), F.lit(0.0)).alias("mass"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, rho: rank correlation with average ranks on ties over complete pairs; NULL below 3 pairs or without spread."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        ok = ok.withColumn(f"_r{c}", F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2)
    rho = safe_divide(F.covar_pop(f"_r{x}", f"_r{y}"), F.stddev_pop(f"_r{x}") * F.stddev_pop(f"_r{y}"))
    return ok.groupBy(*by).agg(F.when(F.count("*") >= 3, rho).alias("rho"))


def item_losses(s: DataFrame, keys: list[str], worst: int) -> DataFrame:
    """keys, loss of the items with the largest mean pinball loss."""
    return pinball_loss(s, keys, doubled=False).orderBy(F.desc("loss"), *keys).limit(worst)


def point_errors(pairs: DataFrame, by: list[str], f: str = "f", y: str = "y") -> DataFrame:
    """by, mse, mae."""
    d = F.col(f) - F.col(y)
    return pairs.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))


def joint_and_single(joint: DataFrame, single: DataFrame, targets: DataFrame, naive: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, joint, single: scores of two quantile forecasts of the same target rows against the naive. Rows of other roles must not be in targets."""
    a, b = (subset_scores(scored(q, targets, keys), naive, targets, keys, by).select(*by, F.col("score").alias(n)) for q, n in ((joint, "joint"), (single, "single")))
    return a.join(b, by)
