"""Multivariate items: windows, forecasts with known covariates, joint scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..types import FUTURE_COVARIATE, LEVELS, TARGET
from .grid import decimate_array
from .match import aligned, item_span
from .sample import bounds, uniform


def item_windows(items: DataFrame, points: DataFrame, lengths: DataFrame, k: int, horizon: int, context: int, patch: int, variates: int = 8, seed: int = 0, scales: DataFrame | None = None) -> DataFrame:
    """item_id, slot, member_pos, valid, k, w, h, context, target: one window per item on the span that all its members cover, read in blocks of k (of 1 if that leaves
    fewer than two patches or a rate scale above 8). Of more than variates members a seeded sample is taken; with fewer, slots are filled up with variates that
    aren't valid and hold no values. scales: item_id, scale (without: 1)."""
    order = Window.partitionBy("item_id").orderBy(uniform(F.concat_ws("/", "item_id", "member_pos"), "variate", seed), "member_pos")
    kept = items.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= variates).drop("_n")
    spans = item_span(kept, lengths).where("start < end").withColumn("n", (F.col("end") - F.col("start")).cast("int")).where("n >= 4")
    spans = spans.join(scales.select("item_id", "scale"), "item_id") if scales is not None else spans.withColumn("scale", F.lit(1.0))
    fits = (F.floor(F.col("n") / k) >= 2 * patch) & (F.col("scale") * k <= 8)
    drawn = bounds(spans.withColumn("k", F.when(fits, k).otherwise(1)), horizon, context, patch, id_="item_id", seed=seed).withColumn("w", F.col("scale") * F.col("k"))
    cut = drawn.select("item_id", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi")).alias("end"))
    grid = aligned(kept, points, cut).groupBy("item_id", "member_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda p: p["value"]).alias("v"))
    y = grid.join(drawn.select("item_id", "k"), "item_id").select("item_id", "member_pos", decimate_array("v", F.col("k")).alias("v"))
    slots = y.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("member_pos", "v"))).alias("_m")).join(drawn.select("item_id", "k", "w", "h"), "item_id")
    slots = slots.withColumn("_none", F.transform(F.get("_m", F.lit(0))["v"], lambda _: F.lit(None).cast("double"))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(variates - 1))))
    slots = slots.withColumn("member_pos", F.get("_m", F.col("slot"))["member_pos"]).withColumn("v", F.coalesce(F.get("_m", F.col("slot"))["v"], "_none"))
    return slots.select("item_id", "slot", "member_pos", F.col("member_pos").isNotNull().alias("valid"), "k", "w", "h", F.slice("v", F.lit(1), F.size("v") - F.col("h")).alias("context"), F.slice("v", F.size("v") - F.col("h") + 1, F.col("h")).alias("target"))


def visible(windows: DataFrame) -> DataFrame:
    """windows (role, context, target) as a forecaster may see them: known is the horizon of future covariates and NULL for all others, and target is gone."""
    return windows.withColumn("known", F.when(F.col("role") == FUTURE_COVARIATE, F.col("target"))).drop("target")


def _joint(contexts: list[np.ndarray], known: list[np.ndarray | None], roles: list[int], h: int, season: int) -> dict[int, np.ndarray]:
    """Median forecasts of the targets: the seasonal naive, plus a ridge regression of what it misses on the covariates known ahead."""
    out = {}
    future = [j for j, r in enumerate(roles) if r == FUTURE_COVARIATE and known[j] is not None]
    for i, r in enumerate(roles):
        if r != TARGET:
            continue
        x = contexts[i]
        n, m = len(x), min(season, len(x))
        base = np.resize(x[n - m :], h)
        if future and n > m + 8:
            z = np.stack([np.nan_to_num(contexts[j][-n:]) for j in future], 1)
            a, y = z[m:] - z[:-m], np.nan_to_num(x[m:] - x[:-m])
            beta = np.linalg.solve(a.T @ a + 1e-3 * np.eye(len(future)), a.T @ y)
            ahead = np.stack([np.nan_to_num(known[j]) for j in future], 1)
            base = base + (ahead - np.resize(z[-m:], ahead.shape)) @ beta
        out[i] = base
    return out


def forecast_items(windows: DataFrame, h: int, season: int, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """item_id, member_pos, quantiles of the targets: items are forecast together; of a horizon only what is visible() is read. Quantiles spread by the naive's errors."""
    seen = visible(windows) if "target" in windows.columns else windows
    q = np.array(levels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member_pos").reset_index(drop=True)
        floats = lambda v: np.array([np.nan if x is None else x for x in v], float)
        contexts = [floats(v) for v in pdf["context"]]
        known = [None if v is None else floats(v) for v in pdf["known"]]
        rows = []
        for i, f in _joint(contexts, known, pdf["role"].tolist(), h, season).items():
            x = contexts[i]
            m = min(season, max(len(x) - 1, 1))
            miss = x[m:] - x[:-m]
            miss = miss[np.isfinite(miss)]
            spread = np.quantile(miss, q) - np.median(miss) if len(miss) else np.zeros(len(q))
            rows.append((int(pdf["item_id"].iloc[0]), int(pdf["member_pos"].iloc[i]), [[None if np.isnan(v) else float(v) for v in row] for row in f[:, None] + spread[None]]))
        return pd.DataFrame(rows, columns=["item_id", "member_pos", "quantiles"])

    return seen.select("item_id", "member_pos", "role", "context", "known").groupBy("item_id").applyInPandas(run, "item_id long, member_pos int, quantiles array<array<double>>")


def save_items(items: DataFrame, path: str) -> None:
    """The items table: one row per member."""
    items.select("item_id", "member_pos", "subset", "series_id", "shift").write.mode("overwrite").parquet(path)
