"""Token mixers with plain weights, token by token against SQL: each series is sixteen tokens of four numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import recurrence as rc
from .base import arrays, query

_TOKENS = "tok AS (SELECT vec_id AS series, t, " + ", ".join(f"embedding[CAST(4 * t + {j + 1} AS INT)]::DOUBLE AS x{j}" for j in range(4)) + " FROM embeddings, (SELECT unnest(range(16)) AS t))"
_CELLS = "cell AS (" + " UNION ALL ".join(f"SELECT series, t, {j} AS j, x{j} AS x FROM tok" for j in range(4)) + ")"
#: To five digits, a little beside the halves, on which rounding would hang on the last bit.
_OUT = "round(({} + 0.00000123) * 100000) / 100000 AS value"


def _mixed(spark: SparkSession, sf_dir: str, mix, width: int = 4) -> DataFrame:
    """series, t, j, value: mix applied to each series' tokens [16, 4]."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(mix(np.asarray(v, float).reshape(-1, 4))).ravel().tolist() for v in values])

    out = arrays(spark, sf_dir).select("series", F.posexplode(run("values")).alias("at", "y"))
    return out.select("series", F.floor(F.col("at") / width).cast("long").alias("t"), (F.col("at") % width).cast("int").alias("j"), rounded(F.col("y") + 1.23e-6, 5).alias("value"))


@query(f"""
WITH {_TOKENS}, d AS (SELECT *, abs(x1) + 0.1 AS dt, sum(abs(x1) + 0.1) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS upto FROM tok),
y AS (SELECT n.series, n.t, sum(n.x2 * exp(-1.0 * (n.upto - p.upto)) * (exp(-p.dt) - 1) / -1.0 * p.x0 * p.x0 + n.x3 * exp(-0.3 * (n.upto - p.upto)) * (exp(-0.3 * p.dt) - 1) / -0.3 * p.x1 * p.x0) AS y FROM d n JOIN d p ON p.series = n.series AND p.t <= n.t GROUP BY 1, 2)
SELECT series, t, 0 AS j, {_OUT.format("y")} FROM y""")
def mixer_selective_scan(spark, sf_dir):
    """A recurrence whose step depends on the input, chunk by chunk."""
    return _mixed(spark, sf_dir, lambda x: rc.selective_scan(x[:, 0], np.abs(x[:, 1]) + 0.1, np.array([-1.0, -0.3]), x[:, :2], x[:, 2:], chunk=5), 1)


_STATE = [(i, j) for i in range(4) for j in range(2)]
_KEPT = {j: " + ".join(f"r.s{i}{j} * e.k{i}" for i in range(4)) for j in range(2)}
_NEXT = ", ".join(f"r.s{i}{j} + 0.5 * e.k{i} * (e.x{j} - ({_KEPT[j]})) AS s{i}{j}" for i, j in _STATE)


@query(f"""
WITH RECURSIVE {_TOKENS}, e AS (SELECT *, {", ".join(f"x{i} / greatest(sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3), 1e-9) AS k{i}" for i in range(4))} FROM tok),
r AS (SELECT DISTINCT series, CAST(-1 AS BIGINT) AS t, {", ".join(f"0.0::DOUBLE AS s{i}{j}" for i, j in _STATE)} FROM e UNION ALL SELECT r.series, e.t, {_NEXT} FROM r JOIN e ON e.series = r.series AND e.t = r.t + 1),
o AS (SELECT r.series, r.t, {", ".join(" + ".join(f"r.s{i}{j} * e.x{i}" for i in range(4)) + f" AS o{j}" for j in range(2))} FROM r JOIN e ON e.series = r.series AND e.t = r.t)
SELECT series, t, 0 AS j, {_OUT.format("o0")} FROM o UNION ALL SELECT series, t, 1, {_OUT.format("o1")} FROM o""")
def mixer_delta_rule(spark, sf_dir):
    """Fast weights that overwrite what a key held, a triangular solve per chunk."""

    def mix(x):
        k = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return rc.delta_rule(x, k, x[:, :2].copy(), np.full(len(x), 0.5), chunk=6)

    return _mixed(spark, sf_dir, mix, 2)


_ANGLE = "(0.5 * t * pow(10000.0, -({}) / 2.0))"


@query(f"""WITH {_TOKENS} """ + " UNION ALL ".join(
    f"SELECT series, t, {j} AS j, " + _OUT.format(f"(x{j % 2} * {'cos' if j < 2 else 'sin'}({_ANGLE.format(j % 2)}) {'-' if j < 2 else '+'} x{j % 2 + 2} * {'sin' if j < 2 else 'cos'}({_ANGLE.format(j % 2)}))") + " FROM tok" for j in range(4)))
def mixer_rotary(spark, sf_dir):
    """Rotary embedding at half positions."""
    return _mixed(spark, sf_dir, lambda x: rc.rotate(x, np.arange(len(x), dtype=float), 0.5))


def _attended(allowed: str) -> str:
    """SQL of attention of the tokens among themselves."""
    return f"""
WITH {_TOKENS}, p AS (SELECT a.series, a.t, exp((a.x0 * b.x0 + a.x1 * b.x1 + a.x2 * b.x2 + a.x3 * b.x3) / 2) AS w, b.x0, b.x1, b.x2, b.x3 FROM tok a JOIN tok b ON b.series = a.series AND ({allowed})),
o AS (SELECT series, t, {", ".join(f"sum(w * x{j}) / sum(w) AS o{j}" for j in range(4))} FROM p GROUP BY 1, 2)
""" + " UNION ALL ".join(f"SELECT series, t, {j} AS j, {_OUT.format(f'o{j}')} FROM o" for j in range(4))


@query(_attended("b.t <= a.t"))
def mixer_attention(spark, sf_dir):
    """Causal attention over time."""
    return _mixed(spark, sf_dir, lambda x: rc.attention(x, x, x, np.tril(np.ones((len(x), len(x)), bool))))


@query(_attended("b.t % 3 > 0 OR b.t = a.t"))
def mixer_variates(spark, sf_dir):
    """Attention over variates: the valid ones are read, and each reads itself."""
    return _mixed(spark, sf_dir, lambda x: rc.variate_attention(x, x, x, np.arange(len(x)) % 3 > 0))


@query(f"""
WITH {_TOKENS}, {_CELLS}, h AS (SELECT *, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 0.00001) AS h FROM cell WINDOW w AS (PARTITION BY series, t)),
u AS (SELECT *, 0.2 * coalesce(lag(h, 2) OVER o, 0) + 0.3 * coalesce(lag(h, 1) OVER o, 0) + 0.5 * h AS f FROM h WINDOW o AS (PARTITION BY series, j ORDER BY t)),
s AS (SELECT *, f / (1 + exp(-f)) AS u FROM u),
y AS (SELECT n.series, n.t, n.j, sum(0.7 * (exp(-0.5) - 1) / -0.5 * exp(-0.5 * (n.t - p.t)) * p.u) AS y FROM s n JOIN s p ON p.series = n.series AND p.j = n.j AND p.t <= n.t GROUP BY 1, 2, 3)
SELECT s.series, s.t, s.j, {_OUT.format("x + 0.5 * (y / (1 + exp(-s.u))) * h / (1 + exp(-h))")} FROM s JOIN y ON y.series = s.series AND y.t = s.t AND y.j = s.j""")
def mixer_gated_block(spark, sf_dir):
    """Norm, causal filter, state-space layer, readout gate, output gate and back, with unit matrices."""
    one = np.eye(4)
    w = {"in_u": one, "in_z": one, "out": 0.5 * one, "readout": one, "taps": np.array([[0.2] * 4, [0.3] * 4, [0.5] * 4]), "a": np.array([-0.5 + 0j]), "b": np.array([1.0 + 0j]), "c": np.array([0.7 + 0j])}
    return _mixed(spark, sf_dir, lambda x: rc.gated_block(x, w))
