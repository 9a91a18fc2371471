"""Leaderboards: ratios to a baseline, grouped reports, A/B tables, submissions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frequency import group_keys
from ..functions.scalars import geomean

GROUPS = ("term", "horizon", "freq", "variates", "cousin", "domain")
#: Terms in the order of a report (fixed values).
TERMS = ("short", "medium", "long")


def ratios(ours: DataFrame, baseline: DataFrame, key: str = "config") -> DataFrame:
    """key, crps, mase: ours over the baseline's, for configurations that have both (and where none is 0 or missing)."""
    b = baseline.select(key, F.col("CRPS").alias("_c"), F.col("MASE").alias("_m"))
    ok = (F.col("CRPS") != 0) & (F.col("MASE") != 0) & (F.col("_c") != 0) & (F.col("_m") != 0)
    return ours.join(b, key).where(ok).select(key, (F.col("CRPS") / F.col("_c")).alias("crps"), (F.col("MASE") / F.col("_m")).alias("mase"))


def require(rows: DataFrame, n: int) -> DataFrame:
    """rows, or an error unless there are n of them."""
    found = rows.count()
    if found != n:
        raise ValueError(f"{found} configurations where {n} are needed: not comparable")
    return rows


def report(own: DataFrame, rival: DataFrame, described: DataFrame, key: str = "config") -> DataFrame:
    """One grouping-sets query: by, grp, n, crps, mase, vs_rival, wins, both; a tie is no win. own, rival: key, crps, mase; described: key and columns of GROUPS."""
    r = rival.select(key, F.col("crps").alias("_rc"))
    j = own.join(described, key).join(r, key, "left")
    sets = [[F.col(g)] for g in GROUPS] + [[]]
    aggs = (F.count("*").alias("n"), geomean("crps").alias("crps"), geomean("mase").alias("mase"), geomean(F.col("crps") / F.col("_rc")).alias("vs_rival"), F.count_if(F.col("crps") < F.col("_rc")).alias("wins"), F.count("_rc").alias("both"))
    # Grouping columns that a set leaves out are NULL; grouping_id tells them from a NULL group.
    out = j.groupingSets(sets, *map(F.col, GROUPS)).agg(F.grouping_id().alias("_g"), *aggs)
    by, grp = F.lit("all"), F.lit("ALL")
    for i, g in enumerate(GROUPS):
        own_set = (1 << len(GROUPS)) - 1 - (1 << (len(GROUPS) - 1 - i))
        by, grp = F.when(F.col("_g") == own_set, g).otherwise(by), F.when(F.col("_g") == own_set, F.coalesce(F.col(g).cast("string"), F.lit("?"))).otherwise(grp)
    return out.select(by.alias("by"), grp.alias("grp"), "n", "crps", "mase", "vs_rival", "wins", "both")


def in_print_order(rows: DataFrame, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """report()'s rows with place (from 1), the order in which they are printed: groupings in the order of GROUPS, the whole last; terms in their fixed order, other groups by falling size, then
    by name. A report has a row a group, so one task orders it."""
    by = F.array_position(F.array(*map(F.lit, (*GROUPS, "all"))), F.col("by"))
    term = F.when(F.col("by") == "term", F.array_position(F.array(*map(F.lit, terms)), F.col("grp"))).otherwise(0)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(by, term, F.desc("n"), "grp")))


def describe(configs: DataFrame) -> DataFrame:
    """config with the columns of GROUPS, from config, prediction_length, num_variates, domain, cousin."""
    return configs.select("config", *group_keys())


def coverage_report(runs: DataFrame, by: Column) -> DataFrame:
    """grp, n, q10, q90, interval, coarse (mean share of instances read at a coarser rate, over those that say)."""
    q10, q90 = F.avg("q10"), F.avg("q90")
    return runs.where("q10 IS NOT NULL").groupBy(by.alias("grp")).agg(F.count("*").alias("n"), q10.alias("q10"), q90.alias("q90"), (q90 - q10).alias("interval"), F.avg("frac_k_gt1").alias("coarse"))


def worst(own: DataFrame, rival: DataFrame, k: int = 10, key: str = "config", metric: str = "crps") -> DataFrame:
    """The k configurations with the largest ratio to the rival."""
    j = own.join(rival.select(key, F.col(metric).alias("_r")), key)
    return j.select(key, (F.col(metric) / F.col("_r")).alias("ratio"), F.col(metric).alias("ours"), F.col("_r").alias("theirs")).orderBy(F.desc("ratio"), key).limit(k)


def decoupled(own: DataFrame, rival: DataFrame, k: int = 10, key: str = "config") -> DataFrame:
    """The k configurations whose median is worst against their fan, both relative to the rival."""
    j = own.join(rival.select(key, F.col("crps").alias("_c"), F.col("mase").alias("_m")), key)
    j = j.select(key, (F.col("mase") / F.col("_m")).alias("mase_rel"), (F.col("crps") / F.col("_c")).alias("crps_rel"))
    return j.withColumn("ratio", F.col("mase_rel") / F.col("crps_rel")).orderBy(F.desc("ratio"), key).limit(k)


def oracle_bound(own: DataFrame, metric: str = "mase", near: float = 0.95) -> DataFrame:
    """near, actual, oracle: configurations at near or above, the geometric mean, and that of the better of model and baseline."""
    return own.agg(F.count_if(F.col(metric) >= near).alias("near"), geomean(metric).alias("actual"), geomean(F.least(F.col(metric), F.lit(1.0))).alias("oracle"))


def ab_table(a: DataFrame, b: DataFrame, k: int = 12, key: str = "config", metric: str = "crps") -> DataFrame:
    """side, key, ratio: the k smallest and the k largest ratios a / b on common configurations."""
    j = a.select(key, F.col(metric).alias("_a")).join(b.select(key, F.col(metric).alias("_b")), key).select(key, (F.col("_a") / F.col("_b")).alias("ratio"))
    low, high = j.orderBy("ratio", key).limit(k), j.orderBy(F.desc("ratio"), key).limit(k)
    return low.select(F.lit("smallest").alias("side"), key, "ratio").unionByName(high.select(F.lit("largest").alias("side"), key, "ratio"))


def regression(a: DataFrame, b: DataFrame, metrics: list[str], key: str = "config", tolerance: float = 1e-6) -> DataFrame:
    """metric, configs, worst, ok: the largest relative difference of two runs."""
    j = a.select(key, *(F.col(m).alias(f"_a_{m}") for m in metrics)).join(b.select(key, *(F.col(m).alias(f"_b_{m}") for m in metrics)), key)
    long = j.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.abs(F.col(f"_a_{m}") / F.col(f"_b_{m}") - 1).alias("d")) for m in metrics))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.count("*").alias("configs"), F.max("d").alias("worst"), (F.max("d") <= tolerance).alias("ok"))


def submission(rows: DataFrame, metadata: DataFrame, model: str, metrics: list[str], key: str = "dataset") -> DataFrame:
    """rows with the model's name and each configuration's domain and number of variates; NaN and infinite values are left blank. A count other than the metadata's,
    or a row without metadata, is an error."""
    from .match import with_metadata

    if rows.count() != metadata.count():
        raise ValueError("the results and the configurations differ in number")
    blank = {m: F.when(~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m)) for m in metrics}
    return with_metadata(rows, metadata.select(key, "domain", "num_variates"), key).withColumns(blank).withColumn("model", F.lit(model))


def schedule(step: Column, warmup: int, total: int, kind: str = "cosine", decay: float = 0.2, least: float = 1e-3) -> Column:
    """Learning rate factor: a rise over the warm-up, then a fall from 1 to least, along a cosine over all other steps or (wsd) along a line over the last decay of the
    steps. What has fallen is one number between 0 and 1, whose shape differs by kind."""
    length = total - warmup if kind == "cosine" else int(decay * total)
    fallen = F.greatest((step - (total - length)) / max(length, 1), F.lit(0.0))
    left = F.pow(F.cos(fallen * (math.pi / 2)), 2) if kind == "cosine" else 1 - fallen
    return F.when(step < warmup, (step + 1) / max(warmup, 1)).otherwise(least + (1 - least) * left)
