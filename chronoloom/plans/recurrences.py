"""State-space recurrences on series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.scalars import rounded
from ..operators import recurrence as rc
from ..operators import synthetic
from .base import arrays, query, table

_A, _B, _C = [-0.5, -0.1, -2.0], [1.0, 0.5, 0.3], [0.7, -0.2, 1.1]
_R = "round({} * 1000000) / 1000000"
_POLES = "(SELECT unnest([-0.5, -0.1, -2.0]::DOUBLE[]) AS a, unnest([1.0, 0.5, 0.3]::DOUBLE[]) AS b, unnest([0.7, -0.2, 1.1]::DOUBLE[]) AS c)"


def _poles(dt):
    pairs = [rc.discretise(F.lit(a), F.lit(b), dt) for a, b in zip(_A, _B)]
    return F.array(*(p[0] for p in pairs)), F.array(*(p[1] for p in pairs)), F.array(*map(F.lit, _C))


@query(f"SELECT p_partkey, {_R.format('exp(-0.5 * p_size / 10.0)')} AS decay, {_R.format('(exp(-0.5 * p_size / 10.0) - 1) / -0.5 * 1.5')} AS gain, {_R.format('exp(-0.2 * p_size / 10.0) * cos(0.7 * p_size / 10.0)')} AS re, {_R.format('exp(-0.2 * p_size / 10.0) * sin(0.7 * p_size / 10.0)')} AS im FROM part")
def ssm_discretise(spark, sf_dir):
    dt = F.col("p_size") / 10.0
    decay, gain = rc.discretise(F.lit(-0.5), F.lit(1.5), dt)
    z = rc.discretise_complex(F.lit(-0.2), F.lit(0.7), F.lit(1.0), F.lit(0.0), dt)
    return table(spark, sf_dir, "part").select("p_partkey", rounded(decay).alias("decay"), rounded(gain).alias("gain"), rounded(z["a_re"]).alias("re"), rounded(z["a_im"]).alias("im"))


@query(f"SELECT p_size, list(k ORDER BY j) AS kernel FROM (SELECT p_size, j, {_R.format('sum(c * pow(exp(p_size / 10.0 * a), j) * (exp(p_size / 10.0 * a) - 1) / a * b)')} AS k FROM (SELECT DISTINCT p_size FROM part) CROSS JOIN {_POLES} CROSS JOIN (SELECT unnest(range(16)) AS j) GROUP BY 1, 2) GROUP BY 1")
def ssm_kernel(spark, sf_dir):
    dt = F.col("p_size") / 10.0
    return table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", F.transform(rc.kernel(*_poles(dt), 16), lambda v: rounded(v)).alias("kernel"))


_SSM = f"""
WITH k AS (SELECT j, sum(c * pow(exp(0.5 * a), j) * (exp(0.5 * a) - 1) / a * b) AS k FROM {_POLES} CROSS JOIN (SELECT unnest(range(64)) AS j) GROUP BY 1)
SELECT series, list(round((y + 0.25 * u) * 1000000) / 1000000 ORDER BY t) AS y FROM (SELECT x.series, x.step AS t, max(x.value) AS u, sum(k.k * z.value) AS y FROM $vec x JOIN vec z ON z.series = x.series AND z.step <= x.step JOIN k ON k.j = x.step - z.step GROUP BY 1, 2) GROUP BY 1"""


@query(_SSM)
def ssm_fold(spark, sf_dir):
    return arrays(spark, sf_dir).select("series", F.transform(rc.fold("values", *_poles(F.lit(0.5)), 0.25), lambda v: rounded(v)).alias("y"))


@query(_SSM)
def ssm_convolution(spark, sf_dir):
    a = arrays(spark, sf_dir).withColumn("k", rc.kernel(*_poles(F.lit(0.5)), 64))
    return a.select("series", F.transform(rc.convolve("values", "k", 0.25), lambda v: rounded(v)).alias("y"))


@query(_SSM)
def ssm_fft(spark, sf_dir):
    return rc.filter_series(arrays(spark, sf_dir), _A, _B, _C, 0.5, 0.25).select("series", F.transform("filtered", lambda v: rounded(v)).alias("y"))


@query("SELECT DISTINCT series, 0.0::DOUBLE AS gap FROM $vec")
def ssm_rate(spark, sf_dir):
    """The rate law: a series held for k steps at one step size and the series itself at k times that size agree at block ends; the largest difference."""
    held = arrays(spark, sf_dir).select("series", F.flatten(F.transform("values", lambda v: F.array_repeat(v, 4))).alias("values"))
    fine = rc.filter_series(held, _A, _B, _C, 0.25).select("series", F.filter("filtered", lambda v, i: i % 4 == 3).alias("f"))
    coarse = rc.filter_series(arrays(spark, sf_dir), _A, _B, _C, 1.0).select("series", F.col("filtered").alias("c"))
    gap = F.array_max(F.zip_with("f", "c", lambda x, y: F.abs(x - y)))
    return fine.join(coarse, "series").select("series", rounded(gap).alias("gap"))


def _weights(d: int, names: tuple[str, ...], wide: int = 0) -> dict[str, np.ndarray]:
    """Fixed matrices of d rows and columns (up: d by wide, down: wide by d)."""
    rng = np.random.default_rng(17)
    shape = {"up": (d, wide), "down": (wide, d)}
    return {n: rng.normal(0, 0.5, shape.get(n, (d, d))) for n in names}


def _mixers(x: np.ndarray) -> dict[str, np.ndarray]:
    """Each kind of mixer over tokens x [T, 4]."""
    t = len(x)
    k = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    past, at = np.tril(np.ones((t, t), bool)), np.arange(t, dtype=float)
    gate = _weights(4, ("in_u", "in_z", "out", "readout")) | {"taps": np.array([[0.2] * 4, [0.3] * 4, [0.5] * 4]), "a": np.array([-0.5 + 0.3j]), "b": np.array([1.0 + 0j]), "c": np.array([0.7 + 0j])}
    att = _weights(4, ("q", "k", "v", "out", "up", "down"), 16)
    return {
        "scan": rc.selective_scan(x[:, 0], np.abs(x[:, 1]) + 0.1, np.array([-1.0, -0.3]), x[:, :2], x[:, 2:]), "delta": rc.delta_rule(x, k, x[:, :2], np.full(t, 0.5)), "rotated": rc.rotate(x, at, 0.5),
        "gated": rc.gated_block(x, gate), "attended": rc.attention_block(x, att, at, past, 2), "variates": rc.variate_attention(x @ att["q"], x @ att["k"], x @ att["v"], at % 3 > 0),
        "stack": rc.layer_loop(x, [lambda y: rc.gated_block(y, gate), lambda y: rc.attention_block(y, att, at, past, 2)], 2),
    }


#: Series whose results a task holds as Python's numbers at once.
_FEW = 200


def _by_few(rows: DataFrame, run, columns: str) -> DataFrame:
    """series and run(values) of each row, given out a few series at a time: lists of numbers take many times the room of their values, and a batch of Spark's has 10,000 rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _FEW):
                few = batch.slice(lo, _FEW)
                made = [run(v) for v in few.column("values").to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column("series"), *(pa.array([m[n] for m in made], kind) for n, kind in kinds)], ["series", *(n for n, _ in kinds)])

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(columns)]
    return rows.mapInArrow(each, f"series {dict(rows.dtypes)['series']}, {columns}")


@query()
def mixers(spark, sf_dir):
    """Selective scan, delta rule, rotary embedding, gated block, attention over time and over variates, and a looped stack of two, token by token."""

    names = ("scan", "delta", "rotated", "gated", "attended", "variates", "stack")

    def run(values) -> dict:
        made = _mixers(np.asarray(values, float).reshape(-1, 4))
        return {n: np.round(made[n].ravel(), 6).tolist() for n in names}

    return _by_few(arrays(spark, sf_dir).select("series", "values"), run, ", ".join(f"{n} array<double>" for n in names))


@query()
def quantile_head(spark, sf_dir):
    """Tokens of eight steps, two queries for what comes, and the sorted fans that the head reads out, in patches of four steps."""
    from ..operators.forecast import quantile_head as head

    w = _weights(8, ("q", "k", "v")) | {n: x * 0.3 for n, x in (("up", np.random.default_rng(5).normal(size=(8, 16))), ("down", np.random.default_rng(6).normal(size=(16, 36))))}

    def run(values) -> dict:
        tokens = np.asarray(values, float).reshape(-1, 8)
        return {"fans": np.round(head(tokens, tokens[-2:], w, 4), 6).tolist()}

    return _by_few(arrays(spark, sf_dir).select("series", "values"), run, "fans array<array<double>>")


@query("SELECT n, list(DISTINCT CAST(round_even(pow(n, i / 7.0::DOUBLE), 0) - 1 AS INT) ORDER BY CAST(round_even(pow(n, i / 7.0::DOUBLE), 0) - 1 AS INT)) AS blocks FROM (SELECT DISTINCT CAST(p_size * 10 AS INT) AS n FROM part) CROSS JOIN (SELECT unnest(range(8)) AS i) GROUP BY n")
def log_blocks(spark, sf_dir):
    """Block numbers spaced evenly in logarithm."""
    from ..functions.frequency import log_blocks as blocks

    @F.pandas_udf("array<int>")
    def picked(n: pd.Series) -> pd.Series:
        return pd.Series([blocks(int(x)) for x in n])

    sizes = table(spark, sf_dir, "part").select((F.col("p_size") * 10).cast("int").alias("n")).distinct()
    return sizes.select("n", picked("n").alias("blocks"))


@query("SELECT p_brand, count(*) AS expected, count(*) FILTER (WHERE p_partkey % 10 > 0) AS found, count(*) = 0 OR count(*) FILTER (WHERE p_partkey % 10 > 0) >= 0.9 * count(*) AS ok FROM part GROUP BY 1")
def match_gate(spark, sf_dir):
    """Whether enough of the variates that should be stored were found, by brand."""
    from ..operators.overlap import enough_matches

    per = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("expected"), F.count_if(F.col("p_partkey") % 10 > 0).alias("found"))
    return per.withColumn("ok", enough_matches("found", "expected", 0.9))


_FREQS = ("10S", "1T", "5T", "10T", "15T", "30T", "H", "D", "W", "M", "Q", "A")


def _wanted(spark, sf_dir):
    """How many series of each frequency: ten a part."""
    freq = F.element_at(F.array(*map(F.lit, _FREQS)), (F.col("p_partkey") % len(_FREQS) + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(freq.alias("freq")).agg((F.count("*") * 10).alias("count"))


@query("""
WITH g AS (SELECT * FROM (VALUES ('10S', 'S', 8192, 360.0::DOUBLE), ('1T', 'T', 8192, 1440.0), ('5T', 'T', 8192, 288.0), ('10T', 'T', 8192, 144.0), ('15T', 'T', 8192, 96.0), ('30T', 'T', 8192, 48.0),
  ('H', 'H', 8192, 24.0), ('D', 'D', 4096, 7.0), ('W', 'W', 1024, 365.0::DOUBLE / 7), ('M', 'M', 512, 12.0), ('Q', 'Q', 256, 4.0), ('A', 'A', 128, 4.0)) t(freq, unit, length, s)),
n AS (SELECT ['10S', '1T', '5T', '10T', '15T', '30T', 'H', 'D', 'W', 'M', 'Q', 'A'][CAST(p_partkey % 12 + 1 AS INT)] AS freq, count(*) * 10 AS cnt FROM part GROUP BY 1),
x AS (SELECT *, s >= 24 AS ops, unit IN ('D', 'W', 'M', 'Q') AS rare FROM g JOIN n USING (freq)),
r AS (SELECT 'tight' AS name, 'template' AS kind, * FROM x UNION ALL SELECT 'wide', 'template', * FROM x UNION ALL SELECT 'ops', 'ops', * FROM x WHERE ops UNION ALL SELECT 'intermittent', 'intermittent', * FROM x WHERE rare UNION ALL SELECT 'arima', 'arima', * FROM x
  UNION ALL SELECT 'regime', 'regimes', * FROM x UNION ALL SELECT 'calendar', 'calendar', * FROM x WHERE unit IN ('T', 'H', 'D') UNION ALL SELECT 'growth', 'growth', * FROM x WHERE unit IN ('D', 'W', 'M', 'Q', 'A'))
SELECT 'synth_' || name || '_' || freq AS subset, freq, kind, length, round(CASE WHEN name IN ('tight', 'ops', 'intermittent') THEN greatest(2.0, s / 1.15::DOUBLE) WHEN name = 'wide' THEN greatest(2.0, s / 4) WHEN name = 'calendar' AND unit = 'D' THEN 1.0 ELSE s END * 1000000) / 1000000 AS low,
  round(CASE WHEN name IN ('tight', 'ops', 'intermittent') THEN s * 1.15::DOUBLE WHEN name = 'wide' THEN least(s * 8, length / 2.0::DOUBLE) WHEN name = 'calendar' AND unit = 'D' THEN 1.0 ELSE s END * 1000000) / 1000000 AS high, CAST(cnt // (2 + CAST(ops AS INT) + CAST(rare AS INT)) AS BIGINT) AS count FROM r""")
def synthetic_grid(spark, sf_dir):
    """What is to be made: subsets with their generators, lengths, periods and numbers of series, for the frequencies of a table."""
    return synthetic.specs(spark, _wanted(spark, sf_dir)).select("subset", "freq", "kind", "length", rounded("low").alias("low"), rounded("high").alias("high"), "count")


@query()
def synthetic_series(spark, sf_dir):
    """A series a part, of the kinds in turn, with lengths and periods of its own."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, synthetic.GENERATORS)), (F.col("p_partkey") % len(synthetic.GENERATORS) + 1).cast("int"))
    period = (F.col("p_size") % 20 + 4).cast("double")
    what = p.select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("subset"), kind.alias("kind"), (F.col("p_size") * 8 + 100).cast("int").alias("length"), period.alias("low"), (period * 1.2).alias("high"), F.lit(1).cast("long").alias("count"))
    return synthetic.generate(what, 3).select("subset", "series_id", "kind", F.transform("values", lambda v: F.round(v.cast("double"), 3)).alias("values"))


def _u(purpose: str, counter: str = "") -> str:
    """DuckDB SQL of synthetic.uniform() for the key p_partkey."""
    key = f"CAST(p_partkey AS VARCHAR) || ':{purpose}'" + (f" || ':' || CAST({counter} AS VARCHAR)" if counter else "")
    return f"((CAST('0x' || substr(md5({key}), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0)"


def _g(purpose: str, counter: str = "") -> str:
    return f"(sqrt(-2 * ln({_u(purpose + '1', counter)})) * cos(2 * pi() * {_u(purpose + '2', counter)}))"


@query(f"""
WITH w AS (SELECT p_partkey, CAST(40 + p_size AS INT) AS n, CAST(3 + p_partkey % 17 AS DOUBLE) AS p FROM part),
k AS (SELECT *, CAST(3 + floor(10 * {_u("knots")}) AS INT) AS m, {_u("phase")} AS phase, {_u("line")} AS line FROM w),
s AS (SELECT p_partkey, m, i, (i + {_u("at", "i")}) / m AS spot, {_g("knot", "i")} AS v FROM (SELECT *, unnest(range(m)) AS i FROM k)),
spots AS (SELECT p_partkey, spot, v FROM s UNION ALL SELECT p_partkey, spot - 1, v FROM s WHERE i = m - 1 UNION ALL SELECT p_partkey, spot + 1, v FROM s WHERE i = 0),
t AS (SELECT *, t / p + phase - floor(t / p + phase) AS f FROM (SELECT *, unnest(range(n)) AS t FROM k)),
b AS (SELECT t.p_partkey, t.t, t.f, t.line, max(spots.spot) FILTER (WHERE spots.spot <= t.f) AS b_at, arg_max(spots.v, spots.spot) FILTER (WHERE spots.spot <= t.f) AS b_v, min(spots.spot) FILTER (WHERE spots.spot > t.f) AS a_at, arg_min(spots.v, spots.spot) FILTER (WHERE spots.spot > t.f) AS a_v
  FROM t JOIN spots ON spots.p_partkey = t.p_partkey GROUP BY ALL),
x AS (SELECT p_partkey, t, CASE WHEN line < 0.5 THEN b_v ELSE b_v + (a_v - b_v) * (f - b_at) / (a_at - b_at) END AS x FROM b),
z AS (SELECT *, (x - avg(x) OVER o) / greatest(stddev_pop(x) OVER o, 0.00000001) AS z FROM x WINDOW o AS (PARTITION BY p_partkey)),
r AS (SELECT z.p_partkey, t, z + CASE WHEN {_u("second")} < 0.5 AND p * 7 <= n / 3 THEN (0.3 + 0.7 * {_u("size")}) * sin(2 * pi() * (t / (p * 7) + {_u("second phase")})) ELSE 0 END
  + CASE WHEN {_u("trend")} < 0.5 THEN {_g("slope")} * t / n ELSE 0 END + CASE WHEN {_u("shift")} < 0.2 AND t / n > 0.2 + 0.7 * {_u("when")} THEN {_g("jump")} ELSE 0 END
  + exp(ln(0.003) + {_u("noise")} * (ln(0.15) - ln(0.003))) * {_g("error", "t")} AS y FROM z JOIN (SELECT p_partkey AS q, n, p FROM w) w ON w.q = z.p_partkey),
d AS (SELECT *, CASE WHEN {_u("floor")} < 0.3 THEN min(y) OVER (PARTITION BY p_partkey) ELSE 0 END AS low FROM r)
SELECT p_partkey, t AS step, round(((y - low) * exp(-1 + 5 * {_u("scale")}) - 10 + 1010 * {_u("level")}) * 10000) / 10000 AS value FROM d""")
def synthetic_templates(spark, sf_dir):
    """Templates for the parts, by expressions alone: knots, cycles, trends, shifts and noise from counted random numbers."""
    p = table(spark, sf_dir, "part")
    what = p.select("p_partkey", (F.col("p_size") + 40).alias("length"), (F.col("p_partkey") % 17 + 3).alias("period"))
    made = synthetic.templates(what, "p_partkey").select("p_partkey", F.posexplode_outer("values").alias("step", "value"))
    return made.select("p_partkey", F.col("step").cast("long").alias("step"), rounded("value", 4).alias("value"))
