"""Fitting on the cluster: sums over Arrow blocks are added up by cell, and a small solver on the driver sees nothing but those sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of numbers.
BLOCK = 4096


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column, all lists of one width, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def cluster_sum(rows: DataFrame, each: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of each(block) over all blocks of rows: vectors of the given size, one a task, are added cell by cell. No rows give zeros."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                total += each(b.slice(lo, BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["cell", "value"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # size rows
        out[r["cell"]] = r["value"]
    return out


def ridge(rows: DataFrame, width: int, lam: float = 0.0, phi: str = "phi", y: str = "y") -> tuple[np.ndarray, float]:
    """Coefficients and intercept of least squares with a penalty lam on the coefficients' squares: one pass sums the Gram matrix of (phi, 1, y), whose solution is exact.
    Rows with a null aren't used."""
    n = width + 2

    def gram(b: pa.RecordBatch) -> np.ndarray:
        x = np.concatenate([matrix(b.column(0), width), np.ones((b.num_rows, 1)), b.column(1).to_numpy(zero_copy_only=False)[:, None]], 1)
        return (x.T @ x).ravel()

    g = cluster_sum(rows.where(F.col(phi).isNotNull() & F.col(y).isNotNull()).select(phi, F.col(y).cast("double")), gram, n * n).reshape(n, n)
    left = g[: n - 1, : n - 1] + lam * np.diag([1.0] * width + [0.0])
    w = np.linalg.lstsq(left, g[: n - 1, n - 1], rcond=None)[0] if g[width, width] else np.zeros(n - 1)
    return w[:width], float(w[width])


def lbfgs(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 50, memory: int = 10, tolerance: float = 1e-8) -> tuple[np.ndarray, list[float]]:
    """Minimises a function whose value and slope are a job on the cluster each: limited-memory BFGS with a line search that asks for enough descent. Returns the best point and
    the values on the way, which never rise."""
    x = np.array(start, float)
    f, g = value_and_slope(x)
    values, pairs = [f], []
    for _ in range(steps):
        if np.abs(g).max(initial=0.0) < tolerance:
            break
        q, alphas = g.copy(), []
        for s, y, r in reversed(pairs):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(pairs, reversed(alphas)):
            q += (a - r * (y @ q)) * s
        down, size = -q, 1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        if down @ g >= 0:
            down, pairs = -g, []
        for _ in range(25):
            new = x + size * down
            f_new, g_new = value_and_slope(new)
            if np.isfinite(f_new) and f_new <= f + 1e-4 * size * (down @ g):
                break
            size /= 2
        else:
            break
        s, y = new - x, g_new - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            pairs = [*pairs, (s, y, 1.0 / (s @ y))][-memory:]
        done = f - f_new <= tolerance * max(abs(f), 1e-12)
        x, f, g = new, f_new, g_new
        values.append(f)
        if done:
            break
    return x, values


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fan(raw: np.ndarray) -> np.ndarray:
    """Rows of raw outputs -> sorted quantiles: the middle one is the median, the others lie sums of softplus widths away."""
    mid = raw.shape[1] // 2
    width = np.maximum(raw, 0) + np.log1p(np.exp(-np.abs(raw)))
    below, above = np.cumsum(width[:, :mid][:, ::-1], 1)[:, ::-1], np.cumsum(width[:, mid + 1 :], 1)
    return np.concatenate([raw[:, mid : mid + 1] - below, raw[:, mid : mid + 1], raw[:, mid : mid + 1] + above], 1)


def fan_loss(phi: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: np.ndarray, levels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Pinball loss of the fans of phi weight' + bias, summed over rows and averaged over levels, and its slopes."""
    raw, mid = phi @ weight.T + bias, len(levels) // 2
    e = y[:, None] - fan(raw)
    loss = np.maximum(levels * e, (levels - 1) * e).sum() / len(levels)
    g = np.where(e > 0, -levels, np.where(e < 0, 1 - levels, 0.0)) / len(levels)
    slope, s = np.empty_like(raw), _sigmoid(raw)
    slope[:, mid] = g.sum(1)
    slope[:, mid + 1 :] = s[:, mid + 1 :] * np.cumsum(g[:, mid + 1 :][:, ::-1], 1)[:, ::-1]
    slope[:, :mid] = -s[:, :mid] * np.cumsum(g[:, :mid], 1)
    return float(loss), slope.T @ phi, slope.sum(0)


def refit(rows: DataFrame, width: int, levels: tuple[float, ...], lam: float = 1e-3, steps: int = 30, weight: np.ndarray | None = None, bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """A last layer (weight [levels, width], bias) on frozen features, rows (phi, y): from the given one, or from a ridge start whose fan is that of normal errors, by L-BFGS on the
    pinball loss. Returns it and the mean losses on the way. rows are read once an evaluation, so they should be a written table."""
    q = np.array(levels)
    n = rows.count()
    if not n:
        raise ValueError("nothing to fit on")
    if weight is None or bias is None:
        w, b = ridge(rows, width, lam * n)

        def squares(part: pa.RecordBatch) -> np.ndarray:
            return np.array([((part.column(1).to_numpy() - matrix(part.column(0), width) @ w - b) ** 2).sum()])

        spread = max(float(np.sqrt(cluster_sum(rows.select("phi", "y"), squares, 1)[0] / n)), 1e-3)
        gap = 2.5 * spread / len(q)  # about the distance of neighbouring levels
        weight, bias = np.zeros((len(q), width)), np.full(len(q), np.log(np.expm1(gap)))
        weight[len(q) // 2], bias[len(q) // 2] = w, b

    def value_and_slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        m, c = x[: weight.size].reshape(weight.shape), x[weight.size :]

        def sums(part: pa.RecordBatch) -> np.ndarray:
            loss, dw, db = fan_loss(matrix(part.column(0), width), part.column(1).to_numpy(), m, c, q)
            return np.concatenate([[loss], dw.ravel(), db])

        s = cluster_sum(rows.select("phi", "y"), sums, 1 + x.size) / n
        return s[0] + lam * float((m * m).sum()), s[1:] + 2 * lam * np.concatenate([m.ravel(), np.zeros(c.size)])

    x, losses = lbfgs(value_and_slope, np.concatenate([weight.ravel(), bias]), steps)
    return x[: weight.size].reshape(weight.shape), x[weight.size :], losses
