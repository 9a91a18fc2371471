"""Forecasters that are fitted: mixers with frozen weights read a context in patches of any size, a last layer fitted on the cluster turns what they read into sorted quantiles.

A model is a dictionary of arrays (see artefact for how it is kept). Each Arrow batch of series goes through one function; what a series gets depends on nothing but itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import LEVELS
from . import recurrence as rc
from .fit import cluster_sum, fan, lbfgs, refit

#: Steps of a context that a model reads.
LENGTH = 512


def frozen(width: int = 12, layers: int = 2, patches: tuple[int, ...] = (1, 8), season: int = 24, seed: int = 11) -> dict[str, np.ndarray]:
    """A model's weights but for its last layer: an embedding for each patch size, and gated state-space layers whose poles span slow to fast."""
    rng = np.random.default_rng(seed)
    out = {"patches": np.array(patches, float), "season": np.array([float(season)])}
    for p in patches:
        out[f"in{p}"] = rng.normal(0, 1 / np.sqrt(p), (p, width))
    for i in range(layers):
        for name in ("in_u", "in_z", "out"):
            out[f"{i}.{name}"] = rng.normal(0, 1 / np.sqrt(width), (width, width))
        n = 4
        out[f"{i}.poles"] = np.stack([-np.geomspace(0.02, 1.0, n), np.linspace(0, np.pi / 2, n), np.ones(n), rng.normal(0, 0.5, n)])  # re, im, b, c
    return out


def _frame(x: np.ndarray) -> tuple[float, float]:
    seen = x[np.isfinite(x)]
    center = float(seen.mean()) if len(seen) else 0.0
    return center, (float(seen.std()) if len(seen) else 0.0) + 1e-5 + 1e-6 * abs(center)


def _tokens(z: np.ndarray, patch: int) -> np.ndarray:
    """[T, patch] of a context in its frame, the oldest patch filled up with zeros."""
    lead = -len(z) % patch
    return np.concatenate([np.zeros(lead), z]).reshape(-1, patch)


def features(context: np.ndarray, h: int, model: dict[str, np.ndarray], patch: int, scale: float = 1.0) -> tuple[np.ndarray, float, float]:
    """[h, width + 4] features of the steps to come, and the context's center and scale. scale multiplies the layers' step size. A missing value is read as the frame's center."""
    if f"in{patch}" not in model:
        raise ValueError(f"the model has no patches of {patch} steps")
    x = np.asarray(context, float)[-LENGTH:]
    center, size = _frame(x)
    z = np.where(np.isfinite(x), np.arcsinh((x - center) / size), 0.0)
    if not len(z):
        z = np.zeros(1)
    stack, i = [], 0
    while f"{i}.in_u" in model:
        re, im, b, c = model[f"{i}.poles"]
        w = {n: model[f"{i}.{n}"] for n in ("in_u", "in_z", "out")} | {"a": re + 1j * im, "b": b.astype(complex), "c": c.astype(complex)}
        stack.append(lambda t, w=w: rc.gated_block(t, w, patch * scale))
        i += 1
    read = np.tanh(rc.layer_loop(_tokens(z, patch) @ model[f"in{patch}"], stack)[-1])
    m = min(max(1, round(float(model["season"][0]) / scale)), len(z))
    whole = z[len(z) % m :].reshape(-1, m)
    usual = np.resize(whole.mean(0), h)  # of all seasons
    naive, step = np.resize(z[-m:], h), np.arange(1, h + 1) / h
    return np.concatenate([np.tile(read, (h, 1)), naive[:, None], usual[:, None], np.full((h, 1), z[-1]) * (1 - step[:, None]), step[:, None]], 1), center, size


def width_of(model: dict[str, np.ndarray]) -> int:
    return model[f"in{int(model['patches'][0])}"].shape[1] + 4


def _floats(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], float)


def training_rows(cuts: DataFrame, model: dict[str, np.ndarray], patch: int, context: str = "context", target: str = "target") -> DataFrame:
    """phi, y: a row for each known step of each cut's target, in the frame of its context."""

    def run(batches):
        for b in batches:
            phi, y = [np.zeros((0, width_of(model)))], [np.zeros(0)]
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c and t:
                    x, center, size = features(_floats(c), len(t), model, patch)
                    z = np.arcsinh((_floats(t) - center) / size)
                    phi.append(x[np.isfinite(z)])
                    y.append(z[np.isfinite(z)])
            phi, y = np.concatenate(phi), np.concatenate(y)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * phi.shape[1], pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(y)], ["phi", "y"])

    return cuts.select(context, target).mapInArrow(run, "phi array<double>, y double")


def fit(cuts: DataFrame, model: dict[str, np.ndarray], patch: int, written, levels: tuple[float, ...] = LEVELS, lam: float = 1e-3, steps: int = 30) -> tuple[dict[str, np.ndarray], list[float]]:
    """The model with a last layer for a patch size, and the losses on the way. written(df) keeps a table that is read many times (a written one, on a cluster)."""
    rows = written(training_rows(cuts, model, patch))
    weight, bias, losses = refit(rows, width_of(model), levels, lam, steps)
    return model | {f"weight{patch}": weight, f"bias{patch}": bias, "levels": np.array(levels)}, losses


def quantiles(context: np.ndarray, h: int, model: dict[str, np.ndarray], patch: int, scale: float = 1.0) -> np.ndarray:
    """[h, levels]."""
    x, center, size = features(context, h, model, patch, scale)
    return center + size * np.sinh(fan(x @ model[f"weight{patch}"].T + model[f"bias{patch}"]))


def forecast(cuts: DataFrame, model: dict[str, np.ndarray], h: int, patch: int | str, context: str = "context", scale: float = 1.0) -> DataFrame:
    """cuts with quantiles (h arrays). patch is a size, or a column of sizes: rows of several sizes go through one pass. A null or empty context gives a null."""

    @F.pandas_udf("array<array<double>>")
    def run(contexts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([quantiles(_floats(c), h, model, int(p), scale).tolist() if c is not None and len(c) else None for c, p in zip(contexts, sizes)])

    return cuts.withColumn("quantiles", run(context, F.col(patch) if isinstance(patch, str) else F.lit(patch)))


# The rate selector.

#: Rates (as logarithms) at which losses are looked at in training; what lies between is interpolated.
GRID = tuple(float(x) for x in np.linspace(np.log(0.25), np.log(8.0), 31))
#: Where the fit may begin: losses have many dips, so one pass compares these. The first is the bare forecast.
STARTS = np.array([(a, 0.0, c) for a in (0.0, 0.5, 1.0) for c in (0.0, -0.7, 0.7)])


def resampled(x: np.ndarray, k: float) -> np.ndarray:
    """A context at steps k native ones apart, its last step kept: means over k steps where k is above 1, between neighbours below. k = 1 is the context itself."""
    if k == 1.0:
        return x
    n = max(int(np.floor((len(x) - 1) / k)) + 1, 1)
    at = len(x) - 1 - k * np.arange(n)[::-1]
    if k < 1:
        return np.interp(at, np.arange(len(x)), x)
    total = np.concatenate([[0.0], np.cumsum(x)])
    upto = lambda t: np.interp(np.clip(t, 0, len(x)), np.arange(len(x) + 1), total)
    lo, hi = np.maximum(at + 1 - k, 0), at + 1
    return (upto(hi) - upto(lo)) / (hi - lo)


def at_rate(inner, x: np.ndarray, h: int, log_k: float) -> np.ndarray:
    """inner(context, steps)'s forecast of h native steps, made at rate exp(log_k). Rate 1 gives inner's own numbers, bit for bit."""
    k = float(np.exp(log_k))
    if k == 1.0:
        return inner(x, h)
    y = resampled(x, k)
    ahead = np.concatenate([[y[-1]], inner(y, max(int(np.ceil(h / k)), 1))])
    return np.interp(np.arange(1, h + 1) / k, np.arange(len(ahead)), ahead)


def rhythm(x: np.ndarray) -> np.ndarray:
    """What the selector sees: the logarithm of the strongest period of a context without gaps over 24 steps, its share of the variance, and 1."""
    z = x - x.mean()
    power = np.abs(np.fft.rfft(z * np.hanning(len(z)))) ** 2 if len(z) > 3 else np.zeros(2)
    power[:2] = 0
    if power.sum() <= 1e-12:
        return np.array([0.0, 0.0, 1.0])
    i = int(power.argmax())
    near = power[max(i - 1, 0) : i + 2]
    peak = float((near * np.arange(max(i - 1, 0), max(i - 1, 0) + len(near))).sum() / near.sum())
    return np.array([np.log(len(z) / peak / 24.0), float(near.sum() / power.sum()), 1.0])


def _filled(values) -> np.ndarray:
    x = _floats(values)
    seen = np.flatnonzero(np.isfinite(x))
    return np.interp(np.arange(len(x)), seen, x[seen]) if len(seen) else np.zeros(len(x))


def loss_curves(cuts: DataFrame, inner, grid: tuple[float, ...] = GRID, context: str = "context", target: str = "target") -> DataFrame:
    """cuts with seen (what the selector sees) and losses: the mean absolute error at each rate of the grid over that of the last value held."""

    @F.pandas_udf("seen array<double>, losses array<double>")
    def run(contexts: pd.Series, targets: pd.Series) -> pd.DataFrame:
        rows = []
        for c, t in zip(contexts, targets):
            x, y = _filled(c), _floats(t)
            base = np.nanmean(np.abs(y - x[-1])) + 1e-9
            rows.append((rhythm(x).tolist(), [float(np.nanmean(np.abs(y - at_rate(inner, x, len(y), g))) / base) for g in grid]))
        return pd.DataFrame(rows, columns=["seen", "losses"])

    known = cuts.where((F.size(context) > 0) & F.exists(target, lambda v: v.isNotNull()))
    return known.withColumn("_m", run(context, target)).select(*cuts.columns, "_m.seen", "_m.losses")


def fit_selector(curves: DataFrame, grid: tuple[float, ...] = GRID, lam: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, list[float]]:
    """Weights of the selector, log k = seen . weights held within the grid: they minimise the interpolated losses, by sums over the cluster."""
    knots, width = np.array(grid), 3
    n = max(curves.count(), 1)

    def value_and_slope(w: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(b: pa.RecordBatch) -> np.ndarray:
            seen = b.column(0).flatten().to_numpy().reshape(-1, width)
            losses = b.column(1).flatten().to_numpy().reshape(-1, len(knots))
            at = seen @ w
            held = np.clip(at, knots[0], knots[-1])
            i = np.clip(np.searchsorted(knots, held, "right") - 1, 0, len(knots) - 2)
            r = np.arange(len(i))
            slope = (losses[r, i + 1] - losses[r, i]) / (knots[i + 1] - knots[i])
            value = losses[r, i] + slope * (held - knots[i])
            return np.concatenate([[value.sum()], seen.T @ (slope * (at == held))])

        s = cluster_sum(curves.select("seen", "losses"), sums, 1 + width) / n
        return s[0] + lam * float(w @ w), s[1:] + 2 * lam * w

    def at_starts(b: pa.RecordBatch) -> np.ndarray:
        at = b.column(0).flatten().to_numpy().reshape(-1, width) @ STARTS.T
        losses = b.column(1).flatten().to_numpy().reshape(-1, len(knots))
        return np.array([sum(np.interp(x, knots, y) for x, y in zip(column, losses)) for column in at.T])

    values = cluster_sum(curves.select("seen", "losses"), at_starts, len(STARTS)) / n + lam * (STARTS**2).sum(1)
    return lbfgs(value_and_slope, STARTS[int(values.argmin())], steps)


def select_rate(cuts: DataFrame, inner, h: int, weights: np.ndarray, grid: tuple[float, ...] = GRID, context: str = "context") -> DataFrame:
    """cuts with k and forecast (h values): inner at the rate that the selector picks. Weights of zero pick k = 1 and give inner's own forecast. An empty context gives nulls."""
    w, lo, hi = np.array(weights, float), grid[0], grid[-1]

    @F.pandas_udf("k double, forecast array<double>")
    def run(contexts: pd.Series) -> pd.DataFrame:
        rows = []
        for c in contexts:
            if c is None or not len(c):
                rows.append((None, None))
                continue
            x = _filled(c)
            log_k = float(np.clip(rhythm(x) @ w, lo, hi)) if w.any() else 0.0
            rows.append((float(np.exp(log_k)), at_rate(inner, x, h, log_k).tolist()))
        return pd.DataFrame(rows, columns=["k", "forecast"])

    return cuts.withColumn("_m", run(context)).select(*cuts.columns, "_m.k", "_m.forecast")
