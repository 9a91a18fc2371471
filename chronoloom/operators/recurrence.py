"""Linear recurrences and token mixers.

Diagonal state-space recurrences with real poles run as array folds in the JVM; complex poles, selective scans, the delta rule and attention are numpy functions
over whole sequences, applied per series by Arrow. The numpy functions are plain recurrences or their transforms, so each has a slower twin to be tested against.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, let


def discretise(a: str | Column, b: str | Column, dt: str | Column) -> tuple[Column, Column]:
    """Zero-order hold of a real pole a < 0: its factor per step, and that of the input."""
    decay = F.exp(col(dt) * col(a))
    return decay, (decay - 1) / col(a) * col(b)


def discretise_complex(a_re: str | Column, a_im: str | Column, b_re: str | Column, b_im: str | Column, dt: str | Column) -> Column:
    """The same for a complex pole: STRUCT<a_re, a_im, b_re, b_im>."""
    ar, ai, br, bi, t = (col(x) for x in (a_re, a_im, b_re, b_im, dt))
    size = F.exp(t * ar)
    er, ei = size * F.cos(t * ai), size * F.sin(t * ai)
    norm = ar * ar + ai * ai
    qr, qi = ((er - 1) * ar + ei * ai) / norm, (ei * ar - (er - 1) * ai) / norm
    return F.struct(er.alias("a_re"), ei.alias("a_im"), (qr * br - qi * bi).alias("b_re"), (qr * bi + qi * br).alias("b_im"))


def kernel(decays: str | Column, inputs: str | Column, outputs: str | Column, length: int) -> Column:
    """Impulse response of length steps of real poles: sum of output * decay ** j * input."""
    poles = F.arrays_zip(col(decays).alias("a"), col(inputs).alias("b"), col(outputs).alias("c"))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.aggregate(poles, F.lit(0.0), lambda s, p: s + p["c"] * F.pow(p["a"], j.cast("double")) * p["b"]))


def fold(values: str | Column, decays: str | Column, inputs: str | Column, outputs: str | Column, skip: float = 0.0) -> Column:
    """y of x' = decay x + input u, y = output x' + skip u, from rest; a missing u counts as 0. Steps are folded in blocks of the root of their number, as appending to
    an array copies it."""
    poles = F.arrays_zip(col(decays).alias("a"), col(inputs).alias("b"))
    none = F.array().cast("array<double>")

    def step(s: Column, u: Column) -> Column:
        v = F.coalesce(u, F.lit(0.0))
        x = F.zip_with(s["x"], poles, lambda x, p: p["a"] * x + p["b"] * v)
        y = F.aggregate(F.zip_with(x, col(outputs), lambda x, c: x * c), F.lit(0.0), lambda t, z: t + z) + skip * v
        return F.struct(x.alias("x"), F.array_append(s["y"], y).alias("y"))

    def folded(u: Column, width: Column) -> Column:
        def block(s: Column, i: Column) -> Column:
            done = F.aggregate(F.slice(u, i * width + 1, width), F.struct(s["x"].alias("x"), none.alias("y")), step)
            return let(done, lambda d: F.struct(d["x"].alias("x"), F.array_append(s["y"], d["y"]).alias("y")))

        start = F.struct(F.transform(col(decays), lambda _: F.lit(0.0)).alias("x"), F.array().cast("array<array<double>>").alias("y"))
        blocks = F.sequence(F.lit(0), F.ceil(F.size(u) / width).cast("int") - 1)
        return F.when(F.size(u) == 0, none).otherwise(F.flatten(F.aggregate(blocks, start, block, lambda s: s["y"])))

    return let(col(values), lambda u: let(F.greatest(F.ceil(F.sqrt(F.size(u).cast("double"))).cast("int"), F.lit(1)), lambda w: folded(u, w)))


def convolve(values: str | Column, response: str | Column, skip: float = 0.0) -> Column:
    """Causal convolution as a double loop over arrays: the definition, for responses and series of some hundred steps; filter_series() does it by FFT for any length."""

    def summed(u: Column, r: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(u) - 1), lambda t: F.aggregate(F.sequence(F.lit(0), t), skip * F.get(u, t), lambda s, j: s + F.get(r, j) * F.get(u, t - j)))

    return let(F.transform(col(values), lambda v: F.coalesce(v, F.lit(0.0))), lambda u: let(col(response), lambda r: summed(u, r)))


# numpy: u [T], poles a, b, c [N] (continuous, complex), dt.


def s4d_kernel(length: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, dt: float) -> np.ndarray:
    decay = np.exp(dt * a)
    return ((c * (decay - 1) / a * b)[None, :] * decay[None, :] ** np.arange(length)[:, None]).sum(1).real


def s4d_fft(u: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, dt: float, skip: float = 0.0) -> np.ndarray:
    n = 2 * len(u)
    return np.fft.irfft(np.fft.rfft(u, n) * np.fft.rfft(s4d_kernel(len(u), a, b, c, dt), n), n)[: len(u)] + skip * u


def s4d_steps(u: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, dt: float, skip: float = 0.0, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    decay = np.exp(dt * a)
    gain = (decay - 1) / a * b
    x, y = np.zeros(len(a), complex) if state is None else state, np.empty(len(u))
    for t, v in enumerate(u):
        x = decay * x + gain * v
        y[t] = (c @ x).real + skip * v
    return y, x


def selective_scan(u: np.ndarray, dt: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, chunk: int = 64) -> np.ndarray:
    """u, dt [T], a [N] < 0, b, c [T, N]: a diagonal recurrence whose step depends on the input, chunk by chunk with a log-space triangle inside."""
    y, x = np.empty(len(u)), np.zeros(len(a))
    for lo in range(0, len(u), chunk):
        d, s = dt[lo : lo + chunk, None] * a[None], slice(lo, lo + chunk)
        gain = np.expm1(d) / a[None] * b[s] * u[s, None]
        upto = np.cumsum(d, 0)
        tri = np.tril(np.ones((len(upto), len(upto))))[:, :, None]
        weight = np.exp(np.where(tri > 0, upto[:, None] - upto[None], -np.inf))
        states = (weight * gain[None]).sum(1) + np.exp(upto) * x[None]
        y[s], x = (c[s] * states).sum(1), states[-1]
    return y


def selective_scan_steps(u: np.ndarray, dt: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, y = np.zeros(len(a)), np.empty(len(u))
    for t in range(len(u)):
        x = np.exp(dt[t] * a) * x + np.expm1(dt[t] * a) / a * b[t] * u[t]
        y[t] = c[t] @ x
    return y


def delta_rule(q: np.ndarray, k: np.ndarray, v: np.ndarray, beta: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Fast weights that overwrite what a key held: one triangular solve per chunk instead of a step per token."""
    s, out = np.zeros((k.shape[1], v.shape[1])), np.empty_like(v)
    for lo in range(0, len(k), chunk):
        i = slice(lo, lo + chunk)
        kk, bb = k[i], beta[i, None]
        lower = np.tril(bb * (kk @ kk.T), -1)
        u = np.linalg.solve(np.eye(len(kk)) + lower, bb * (v[i] - kk @ s))
        out[i] = q[i] @ s + np.tril(q[i] @ kk.T) @ u
        s = s + kk.T @ u
    return out


def delta_rule_steps(q: np.ndarray, k: np.ndarray, v: np.ndarray, beta: np.ndarray) -> np.ndarray:
    s, out = np.zeros((k.shape[1], v.shape[1])), np.empty_like(v)
    for t in range(len(k)):
        s = s + beta[t] * np.outer(k[t], v[t] - s.T @ k[t])
        out[t] = s.T @ q[t]
    return out


def rotate(x: np.ndarray, position: np.ndarray, w: float = 1.0, base: float = 10000.0) -> np.ndarray:
    """Rotary embedding of x [T, D] at real positions, scaled by w."""
    half = x.shape[1] // 2
    angle = w * position[:, None] * base ** (-np.arange(half) / half)[None]
    return np.concatenate([x[:, :half] * np.cos(angle) - x[:, half:] * np.sin(angle), x[:, half:] * np.cos(angle) + x[:, :half] * np.sin(angle)], 1)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Rows of allowed [T, T] say what a token reads; a row without any reads itself."""
    allowed = allowed | (np.eye(len(q), dtype=bool) & ~allowed.any(1, keepdims=True))
    score = np.where(allowed, q @ k.T / np.sqrt(q.shape[1]), -np.inf)
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True) @ v


def variate_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """[V, D] of one token: variates read the valid ones and themselves, never padding."""
    return attention(q, k, v, valid[None, :] | np.eye(len(q), dtype=bool))


def _norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def _silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def causal_filter(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """x [T, D], taps [K, D]: each channel's own sum over the last K steps, the newest by the last tap; what is before the first step counts as 0."""
    padded = np.concatenate([np.zeros((len(taps) - 1, x.shape[1])), x])
    return np.einsum("tdk,kd->td", np.lib.stride_tricks.sliding_window_view(padded, len(taps), axis=0), taps)


def gated_block(x: np.ndarray, w: dict, dt: float = 1.0) -> np.ndarray:
    """x [T, D] through norm, two projections, a state-space layer per channel, a gate, and back, plus itself. w: in_u, in_z, out matrices and a, b, c poles; optionally
    taps of a causal filter before the layer, and readout, a matrix whose sigmoid gates what the layer reads out."""
    h = _norm(x)
    u, z = h @ w["in_u"], h @ w["in_z"]
    u = _silu(causal_filter(u, w["taps"]) if "taps" in w else u)
    y = np.stack([s4d_fft(u[:, j], w["a"], w["b"], w["c"], dt) for j in range(u.shape[1])], 1)
    if "readout" in w:
        y = y * _sigmoid(u @ w["readout"])
    return x + (y * _silu(z)) @ w["out"]


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def attention_block(x: np.ndarray, w: dict, position: np.ndarray, allowed: np.ndarray, heads: int = 1, scale: float = 1.0) -> np.ndarray:
    """x [T, D] plus attention over its normed tokens, by heads with rotated queries and keys, plus a feed-forward network over what comes of it. w: q, k, v, out, up, down."""
    h = _norm(x)
    q, k, v = (np.split(h @ w[n], heads, axis=1) for n in ("q", "k", "v"))
    read = np.concatenate([attention(rotate(a, position, scale), rotate(b, position, scale), c, allowed) for a, b, c in zip(q, k, v)], 1)
    x = x + read @ w["out"]
    return x + _gelu(_norm(x) @ w["up"]) @ w["down"]


def layer_loop(x: np.ndarray, layers: list, loops: int = 1) -> np.ndarray:
    """A stack of mixers of any kinds (functions of a token sequence), passed through loops times with the same weights."""
    for _ in range(loops):
        for layer in layers:
            x = layer(x)
    return x


def filter_series(series: DataFrame, a: list[complex], b: list[complex], c: list[complex], dt: float | str = 1.0, skip: float = 0.0, values: str = "values") -> DataFrame:
    """series with filtered: a state-space layer with complex poles over each array, by FFT; dt may be a column. Missing values count as 0."""
    poles = [np.array(x, complex) for x in (a, b, c)]

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([s4d_fft(np.nan_to_num(np.array([np.nan if x is None else x for x in u], float)), *poles, float(s), skip) for u, s in zip(v, t)])

    return series.withColumn("filtered", run(values, F.col(dt) if isinstance(dt, str) else F.lit(float(dt))))
