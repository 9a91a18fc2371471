"""Normalisation, context statistics and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col

#: Added to a scale, absolutely and per unit of the centre; bound of a normalised value on the way back (fixed values).
EPSILON, RELATIVE, CLAMP = 1e-5, 1e-6, 15.0
#: Median distance to deviation, share of the deviation below which it counts as collapsed, fallback share, floor, and reach of forecasts in ranges.
MAD_TO_SIGMA, COLLAPSE, FALLBACK, FLOOR, ENVELOPE = 1.4826, 0.01, 0.1, 1e-3, 10.0


def frame(points: DataFrame, keys: list[str], robust: bool = False, value: str = "value") -> DataFrame:
    """keys, center, scale of the observed values: mean and deviation (population), or median and scaled median distance where that is above 0. One aggregation, or
    for the robust frame a second one over the distances."""
    plain = points.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("center"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("scale"), F.coalesce(F.median(value), F.lit(0.0)).alias("_med"))
    if robust:
        far = points.join(plain.select(*keys, "_med"), keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
        plain = plain.join(far, keys).withColumn("center", F.col("_med")).withColumn("scale", F.when(F.col("_mad") > 0, MAD_TO_SIGMA * F.col("_mad")).otherwise(F.col("scale")))
    return plain.select(*keys, "center", (F.col("scale") + EPSILON + RELATIVE * F.abs("center")).alias("scale"))


def into(points: DataFrame, frames: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """points with z = asinh((value - center) / scale), 0 where missing."""
    joined = points.join(frames, keys)
    return joined.withColumn("z", F.coalesce(F.asinh((F.col(value) - F.col("center")) / F.col("scale")), F.lit(0.0)))


def out_of(z: str | Column, center: str | Column, scale: str | Column) -> Column:
    """The inverse, the normalised value held within CLAMP."""
    return F.sinh(F.least(F.greatest(col(z), F.lit(-CLAMP)), F.lit(CLAMP))) * col(scale) + col(center)


def causal_frame(points: DataFrame, keys: list[str], patch: int, step: str = "step", value: str = "value") -> DataFrame:
    """keys, token, center, scale: mean and deviation of all observed steps up to the end of each token of patch steps (from step 0). Squares are taken about the first
    observed value, so that a level far above the spread loses no digits, and no later step changes an earlier token."""
    w = Window.partitionBy(*keys)
    shift = F.coalesce(F.first(value, True).over(w.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    d = F.col(value) - shift
    tokens = points.withColumn("_d", d).withColumn("_shift", shift).groupBy(*keys, F.floor(F.col(step) / patch).cast("long").alias("token"), "_shift")
    tokens = tokens.agg(F.count("_d").alias("_n"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0)).alias("_q"))
    upto = w.orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    n = F.greatest(F.sum("_n").over(upto), F.lit(1))
    some = F.sum("_n").over(upto) > 0
    mean = F.sum("_s").over(upto) / n
    var = F.greatest(F.sum("_q").over(upto) / n - mean * mean, F.lit(0.0))
    center = F.when(some, F.col("_shift") + mean).otherwise(0.0)
    return tokens.select(*keys, "token", center.alias("center"), (F.sqrt(var) + EPSILON + RELATIVE * F.abs(center)).alias("scale"))


def robust_scale(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, median (the lower one), scale, lo, hi (least and largest value)."""
    disc = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {})"
    first = points.groupBy(*keys).agg(F.expr(disc.format(value)).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_std"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    far = points.join(first.select(*keys, "median"), keys).withColumn("_far", F.abs(F.col(value) - F.col("median"))).groupBy(*keys).agg(F.expr(disc.format("_far")).alias("_mad"))
    sigma = F.col("_mad") * MAD_TO_SIGMA
    scale = F.greatest(F.when(sigma > COLLAPSE * F.col("_std"), sigma).otherwise(F.greatest(FALLBACK * F.col("_std"), F.lit(FLOOR))), F.lit(FLOOR))
    return first.join(far, keys).select(*keys, "median", scale.alias("scale"), "lo", "hi")


def robust_into(value: str | Column, median: str | Column, scale: str | Column) -> Column:
    return F.asinh((col(value) - col(median)) / col(scale))


def robust_out(z: str | Column, median: str | Column, scale: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """The inverse, held within ENVELOPE ranges (or scales) of the values seen."""
    reach = ENVELOPE * F.greatest(col(hi) - col(lo), col(scale))
    return F.least(F.greatest(F.sinh(col(z)) * col(scale) + col(median), col(lo) - reach), col(hi) + reach)


def instance_norm(points: DataFrame, keys: list[str], value: str = "value", weight: float = 1.0, bias: float = 0.0) -> DataFrame:
    """points with mean, dev and z = (value - mean) / dev (affine on the way in)."""
    w = Window.partitionBy(*keys)
    p = points.withColumn("mean", F.avg(value).over(w)).withColumn("dev", F.sqrt(F.var_pop(value).over(w) + 1e-5))
    return p.withColumn("z", (F.col(value) - F.col("mean")) / F.col("dev") * weight + bias)


def z_score(points: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """points with z; series without spread are dropped."""
    w = Window.partitionBy(*keys)
    p = points.withColumn("_sd", F.stddev_pop(value).over(w)).withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(w), F.col("_sd")))
    return p.where("_sd > 0").drop("_sd")


def context_stats(points: DataFrame, frames: DataFrame, keys: list[str], length: int, step: str = "step", value: str = "value") -> DataFrame:
    """keys, zeros, missing (shares), level, last, observed: what the normalisation removes. length: the model's context length."""
    z = into(points, frames, keys, value)
    n = F.greatest(F.count(value), F.lit(1))
    return z.groupBy(*keys).agg(
        (F.count(F.when(F.col(value) == 0, 1)) / n).alias("zeros"), (1 - F.avg(F.col(value).isNotNull().cast("double"))).alias("missing"), F.asinh(F.max("center") / F.max("scale")).alias("level"),
        F.max_by("z", step).alias("last"), (F.ln(n.cast("double")) / F.ln(F.lit(float(length)))).alias("observed"),
    )


def choose_patch(points: DataFrame, keys: list[str], sizes: list[int], max_tokens: int, step: str = "step", value: str = "value") -> DataFrame:
    """keys, span, patch: the smallest size whose max_tokens tokens cover the steps from the first observed one on, else the largest."""
    first = F.min(F.when(F.col(value).isNotNull(), F.col(step)))
    out = points.groupBy(*keys).agg((F.max(step) + 1 - F.coalesce(first, F.max(step) + 1)).alias("span"))
    chosen = F.lit(sizes[-1])
    for size in reversed(sizes):
        chosen = F.when(F.col("span") <= max_tokens * size, size).otherwise(chosen)
    return out.withColumn("patch", chosen)


def patches(values: str | Column, size: int, stride: int | None = None) -> Column:
    """Patches of size values every stride (default: size) values; with a stride of its own the array is filled up at the end with its last value."""
    v = col(values)
    if stride is None:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))
    more = F.pmod(F.lit(stride) - F.pmod(F.size(v) - size, F.lit(stride)), F.lit(stride))
    full = F.concat(v, F.array_repeat(F.element_at(v, -1), more))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) + more - size) / stride).cast("int")), lambda i: F.slice(full, i * stride + 1, size))


def unpatch(patched: DataFrame, keys: list[str], stride: int, length: int | None = None, patches_: str = "patches") -> DataFrame:
    """keys, step, value: patches laid back, the mean where they overlap."""
    flat = patched.select(*keys, F.posexplode(patches_).alias("_p", "_patch")).select(*keys, "_p", F.posexplode("_patch").alias("_i", "_v"))
    out = flat.groupBy(*keys, (F.col("_p") * stride + F.col("_i")).cast("long").alias("step")).agg(F.avg("_v").alias("value"))
    return out if length is None else out.where(F.col("step") < length)


def next_patch_targets(points: DataFrame, keys: list[str], patch: int, skip: int = 0, step: str = "step", value: str = "value") -> DataFrame:
    """keys, token, i, target, scored: patch token + 1 in the causal frame of token; scored where it is observed, something was seen before and token >= skip."""
    frames = causal_frame(points, keys, patch, step, value)
    seen = points.groupBy(*keys, F.floor(F.col(step) / patch).cast("long").alias("token")).agg(F.count(value).alias("_n"))
    seen = seen.withColumn("_seen", F.sum("_n").over(Window.partitionBy(*keys).orderBy("token").rowsBetween(Window.unboundedPreceding, 0)) > 0).drop("_n")
    nxt = points.withColumn("token", F.floor(F.col(step) / patch).cast("long") - 1).withColumn("i", (F.col(step) % patch).cast("int")).where("token >= 0")
    j = nxt.join(frames, [*keys, "token"]).join(seen, [*keys, "token"])
    scored = F.col(value).isNotNull() & F.col("_seen") & (F.col("token") >= skip)
    return j.select(*keys, "token", "i", F.asinh((F.coalesce(F.col(value), F.lit(0.0)) - F.col("center")) / F.col("scale")).alias("target"), scored.alias("scored"))


def config_stats(cuts: DataFrame, by: list[str], cap: int = 1024, short: int = 128, context: str = "context", target: str = "target") -> DataFrame:
    """by, n, ctx_median, ctx_q10, ctx_short (share below short) of the contexts' lengths (at most cap), and tail statistics of the targets in the robust frame of their
    own contexts. cuts: keys of their own in id."""
    from .metrics import tail_stats

    lengths = cuts.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile(F.least(F.size(context), F.lit(cap)), F.lit(p)).alias(n) for p, n in ((0.5, "ctx_median"), (0.1, "ctx_q10"))), F.avg((F.least(F.size(context), F.lit(cap)) < short).cast("double")).alias("ctx_short"))
    last = F.slice(context, F.greatest(F.size(context) - cap, F.lit(0)) + 1, F.lit(cap))
    points = cuts.select("id", *by, F.explode(last).alias("value")).where("value IS NOT NULL")
    frames = robust_scale(points, ["id", *by])
    z = cuts.select("id", F.explode(target).alias("_y")).join(frames, "id").withColumn("z", (F.col("_y") - F.col("median")) / F.col("scale"))
    return lengths.join(tail_stats(z, by), by, "left")
