"""Synthetic series: one seeded generator per kind, run by Arrow over a grid of ids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frequency import frequency_multiple, frequency_unit, season_length
from ..functions.scalars import let

LARGEST = 1e12


def template(n: int, season: float, rng: np.random.Generator) -> np.ndarray:
    """A cycle through random knots (steps or lines), a second slower cycle, a trend, at times a shift, and noise."""
    t = np.arange(n)
    knots = rng.normal(0, 1, int(rng.integers(3, 9)))
    phase = (t / season) % 1 * len(knots)
    i = phase.astype(int) % len(knots)
    cycle = knots[i] if rng.random() < 0.5 else knots[i] + (phase % 1) * (knots[(i + 1) % len(knots)] - knots[i])
    slow = rng.normal(0, 0.5) * np.sin(2 * np.pi * t / (season * rng.integers(4, 9)) + rng.uniform(0, 6.28))
    shift = rng.normal(0, 1) * (t >= rng.integers(0, n)) if rng.random() < 0.3 else 0.0
    return rng.normal(0, 5) + cycle + slow + rng.normal(0, 1) * t / n + shift + rng.normal(0, rng.uniform(0.01, 0.3), n)


def _recursive(noise: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """Autoregression with the given poles inside the unit circle."""
    coefficients = np.poly(poles).real[1:]
    out = np.zeros(len(noise) + len(coefficients))
    for i, e in enumerate(noise):
        j = i + len(coefficients)
        out[j] = e - coefficients @ out[j - len(coefficients) : j][::-1]
    return out[len(coefficients) :]


def arima(n: int, season: float, rng: np.random.Generator) -> np.ndarray:
    """Stable autoregression, at times seasonal and integrated, driven by heavy-tailed noise whose variance clusters; at times exponentiated."""
    shocks, var, noise = rng.standard_t(5, n), 1.0, np.empty(n)
    a, b = rng.uniform(0.02, 0.15), rng.uniform(0.6, 0.8)
    for i in range(n):
        noise[i] = np.sqrt(var) * shocks[i]
        var = (1 - a - b) + a * min(noise[i] ** 2, 25.0) + b * var
    r, angle = rng.uniform(0.1, 0.95), rng.uniform(0, np.pi)
    x = _recursive(noise, np.array([r * np.exp(1j * angle), r * np.exp(-1j * angle), rng.uniform(-0.8, 0.8)]))
    m = int(round(season))
    if 1 < m < n and rng.random() < 0.5:
        phi = rng.uniform(0.3, 0.95)
        for i in range(m, n):
            x[i] += phi * x[i - m]
    if rng.random() < 0.4:
        x = np.cumsum(x)
    return np.exp(0.2 * x / (x.std() + 1e-9)) if rng.random() < 0.3 else x


def regimes(n: int, season: float, rng: np.random.Generator) -> np.ndarray:
    """A Markov chain of states with their own level, cycle and noise; geometric stays, ramps between them."""
    k = int(rng.integers(2, 5))
    level, size, noise, stay = rng.normal(0, 3, k), np.abs(rng.normal(0, 1, k)), rng.uniform(0.01, 0.5, k), rng.geometric(1 / (4 * season), 10_000) + 1
    state, t, states = int(rng.integers(k)), 0, np.empty(n, int)
    for d in stay:
        states[t : t + d] = state
        t, state = t + d, (state + int(rng.integers(1, k))) % k
        if t >= n:
            break
    ramp = max(1, int(season / 4))
    smooth = np.convolve(np.concatenate([np.full(ramp, level[states[0]]), level[states]]), np.ones(ramp) / ramp, "same")[ramp:]
    return smooth + size[states] * np.sin(2 * np.pi * np.arange(n) / season) + noise[states] * rng.normal(0, 1, n)


def calendar(n: int, season: float, rng: np.random.Generator) -> np.ndarray:
    """A load: day shape by weekday and year, holidays, a driver that acts at both ends, and correlated noise. season: steps a day."""
    t = np.arange(n)
    day, hour = (t // season).astype(int), (t / season) % 1
    shape = 1 + 0.4 * np.sin(2 * np.pi * (hour - 0.3)) + 0.2 * np.sin(4 * np.pi * (hour - rng.uniform()))
    week = np.array([1, 1, 1, 1, 1, rng.uniform(0.6, 0.9), rng.uniform(0.5, 0.8)])[day % 7]
    holiday = np.where(np.isin(day % 365, rng.choice(365, 10, replace=False)), rng.uniform(0.5, 0.8), 1.0)
    driver = np.cos(2 * np.pi * day / 365) + 0.3 * rng.normal(0, 1, day.max() + 1)[day]
    return 100 * shape * week * holiday * (1 + 0.15 * driver**2) + _recursive(rng.normal(0, 1.5, n), np.array([0.8]))


def growth(n: int, season: float, rng: np.random.Generator) -> np.ndarray:
    """A stochastic trend times a drifting cycle, at times with a drop and a recovery."""
    t = np.arange(n)
    trend = np.exp(np.cumsum(rng.normal(rng.uniform(0, 2) / n, 0.3 / np.sqrt(n), n)))
    cycle = 1 + rng.uniform(0.05, 0.4) * np.sin(2 * np.pi * t / season + np.cumsum(rng.normal(0, 0.02, n)))
    drop = 1 - (rng.uniform(0.2, 0.7) * np.exp(-np.maximum(t - rng.integers(0, n), 0) / (n / 10)) * (t >= rng.integers(0, n))) if rng.random() < 0.4 else 1.0
    return 100 * trend * cycle * drop * np.exp(rng.normal(0, 0.02, n))


def operations(n: int, season: float, rng: np.random.Generator) -> np.ndarray:
    """A load of machines: a daily shape on a floor, bursts that decay, and restarts that set it back."""
    t = np.arange(n)
    base = rng.uniform(5, 50) * (1 + rng.uniform(0.1, 0.6) * np.sin(2 * np.pi * t / season + rng.uniform(0, 6.28)))
    starts = rng.random(n) < rng.uniform(0.5, 3) / season
    bursts = _recursive(starts * rng.exponential(rng.uniform(10, 100), n), np.array([rng.uniform(0.6, 0.98)]))
    since = t - np.maximum.accumulate(np.where(rng.random(n) < 0.2 / season, t, 0))
    return np.maximum(base * np.minimum(since / max(season / 8, 1), 1) + bursts + rng.normal(0, 1, n), 0)


def intermittent(n: int, season: float, rng: np.random.Generator) -> np.ndarray:
    """Mostly zeros: demands of a few units, likelier at some phases of the cycle."""
    phase = np.arange(n) / season % 1
    chance = rng.uniform(0.05, 0.4) * (1 + rng.uniform(0, 0.9) * np.sin(2 * np.pi * phase + rng.uniform(0, 6.28)))
    return (rng.random(n) < chance) * (1 + rng.poisson(rng.uniform(0.5, 6), n)).astype(float)


GENERATORS = {"template": template, "arima": arima, "regimes": regimes, "calendar": calendar, "growth": growth, "ops": operations, "intermittent": intermittent}

# Length and number of series by frequency.
GRID = {
    "10S": (8192, 36000), "1T": (8192, 24000), "5T": (8192, 36000), "10T": (8192, 24000), "15T": (8192, 24000), "30T": (8192, 18000), "H": (8192, 36000), "D": (4096, 48000), "W": (1024, 96000),
    "M": (512, 144000), "Q": (256, 144000), "A": (128, 144000),
}


def seasons(spark: SparkSession) -> DataFrame:
    """freq, length, count, season (steps of the weekly or reference cycle), unit, day (steps a day, where there are whole ones): the grid as a table."""
    grid = spark.createDataFrame([(f, *x) for f, x in GRID.items()], "freq string, length int, count long")
    return grid.withColumn("season", season_length("freq", F.lit(True))).withColumn("unit", frequency_unit("freq")).withColumn("day", F.when(F.col("unit") == "T", 1440.0).when(F.col("unit") == "H", 24.0).when(F.col("unit") == "D", 1.0) / frequency_multiple("freq"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in as many tasks as the session shuffles to, one a core at least. The number is given, since a row is few bytes and much work: neither splits of files nor
    adaptive execution, which go by bytes, would part such rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def specs(spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
    """subset, freq, kind, length, low, high, count: what is to be made. wanted (freq, count) says how many series of each frequency there are to be, by default as many as in the grid. Periods lie tightly or widely about the season; machine loads where a season has 24 steps, intermittent
    demand of days and longer; a frequency's series are shared evenly. The other kinds have subsets of their own, as many series as a tight one."""
    g = seasons(spark)
    if wanted is not None:
        g = g.drop("count").join(wanted.select("freq", "count"), "freq")
    # How far a tight period lies about the season, how far a wide one, and the season from which on there are machine loads.
    near, below, above, day = 1.15, 4, 8, 24
    tight = (F.greatest(F.lit(2.0), F.col("season") / near), F.col("season") * near)
    wide = (F.greatest(F.lit(2.0), F.col("season") / below), F.least(F.col("season") * above, F.col("length") / 2))
    rows = [("tight", "template", tight, F.lit(True)), ("wide", "template", wide, F.lit(True)), ("ops", "ops", tight, F.col("season") >= day), ("intermittent", "intermittent", tight, F.col("unit").isin("D", "W", "M", "Q"))]
    shared = F.lit(2) + (F.col("season") >= day).cast("int") + F.col("unit").isin("D", "W", "M", "Q").cast("int")
    at = (F.col("season"), F.col("season"))
    more = [("arima", "arima", at, F.lit(True)), ("regime", "regimes", at, F.lit(True)), ("calendar", "calendar", (F.col("day"), F.col("day")), F.col("day").isNotNull() & (F.col("day") <= 1440)), ("growth", "growth", at, F.col("unit").isin("D", "W", "M", "Q", "A"))]
    kinds = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), lo.cast("double").alias("low"), hi.cast("double").alias("high"), here.alias("here")) for name, kind, (lo, hi), here in rows + more))
    out = g.withColumn("x", F.explode(kinds)).where("x.here")
    return out.select(F.concat_ws("_", F.lit("synth"), "x.name", "freq").alias("subset"), "freq", "x.kind", "length", "x.low", "x.high", F.floor(F.col("count") / shared).alias("count"))


def make(kind: str, n: int, low: float, high: float, seed: int) -> np.ndarray:
    """One series with a period between low and high, drawn again until it is finite and not huge."""
    for turn in range(100):
        rng = np.random.default_rng([seed, turn])
        x = GENERATORS[kind](n, low if high <= low else float(np.exp(rng.uniform(np.log(low), np.log(high)))), rng).astype(np.float32)
        if np.isfinite(x).all() and abs(x).max() < LARGEST:
            return x
    raise ValueError(f"{kind} gives no usable series for seed {seed}")


def generate(what: DataFrame, seed: int = 0, most: int | None = None) -> DataFrame:
    """subset, series_id, kind, values: the series of specs()'s rows (most at most of each). A series depends on seed, subset and id alone, however they are dealt out."""

    @F.pandas_udf("array<float>")
    def run(kind: pd.Series, n: pd.Series, low: pd.Series, high: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([make(*x) for x in zip(kind, n, low, high, key)])

    count = F.col("count") if most is None else F.least(F.col("count"), F.lit(most))
    d = dealt(what.withColumn("series_id", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))), "subset", "series_id")
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "subset", "series_id")), 1, 15), 16, 10).cast("long")
    return d.select("subset", "series_id", "kind", run("kind", "length", "low", "high", key).alias("values"))


def uniform(key: Column, purpose: str, i: Column | None = None) -> Column:
    """A number in (0, 1) that depends on key, purpose and counter alone: the same in any engine that has md5."""
    text = F.concat(key.cast("string"), F.lit(f":{purpose}"), *([F.lit(":"), i.cast("string")] if i is not None else []))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(key: Column, purpose: str, i: Column | None = None) -> Column:
    """A normal number, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(key, f"{purpose}1", i))) * F.cos(2 * math.pi * uniform(key, f"{purpose}2", i))


def templates(what: DataFrame, key: str = "seed", length: str = "length", period: str = "period", values: str = "values") -> DataFrame:
    """what with values: cycles through random knots, made by expressions alone from counted random numbers, so that a row's series depends on its key only and any engine can repeat it.

    A cycle has 3 to 12 knots at random phases, joined by steps or lines, and unit variance; at times there is a slower second one, a trend, a shift and a floor at zero; noise, scale
    and level come last. length (int) and period (double, at least 1) are columns; a length below 1 gives an empty array. Rows are dealt out by their key."""
    n, p = F.col(length).cast("int"), F.greatest(F.col(period).cast("double"), F.lit(1.0))
    k = F.col(key)
    names = ("knots", "phase", "line", "second", "size", "second phase", "trend", "shift", "when", "noise", "floor", "scale", "level")
    draws = F.struct(k.alias("key"), n.alias("n"), p.alias("p"), *(uniform(k, x).alias(x) for x in names), normal(k, "slope").alias("slope"), normal(k, "jump").alias("jump"))

    def shape(d: Column) -> Column:
        """Knots are spread over the phase, one at random in each of equal parts; the last one comes again before the first, and the first after the last."""
        m = (F.lit(3) + F.floor(10 * d["knots"])).cast("int")
        spots = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(((i + uniform(d["key"], "at", i)) / m).alias("at"), normal(d["key"], "knot", i).alias("v")))
        first, last = lambda s: F.get(s, F.lit(0)), lambda s: F.element_at(s, -1)
        moved = lambda x, by: F.array(F.struct((x["at"] + by).alias("at"), x["v"].alias("v")))
        ring = let(spots, lambda s: F.concat(moved(last(s), -1), s, moved(first(s), 1)))

        def value(s: Column, f: Column) -> Column:
            """Of a phase: what stands at or before it, or a line from there to what comes after."""
            i = F.size(F.filter(s, lambda x: x["at"] <= f))
            between = lambda i: let(F.struct(F.get(s, i - 1).alias("b"), F.get(s, i).alias("a")), lambda x: F.when(d["line"] < 0.5, x["b"]["v"]).otherwise(x["b"]["v"] + (x["a"]["v"] - x["b"]["v"]) * (f - x["b"]["at"]) / (x["a"]["at"] - x["b"]["at"])))
            return let(i, between)

        phase = lambda t: let(t / d["p"] + d["phase"], lambda x: x - F.floor(x))
        return let(ring, lambda s: F.transform(F.sequence(F.lit(0), d["n"] - 1), lambda t: let(phase(t), lambda f: value(s, f))))

    def scaled(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
        return let(mean, lambda m: let(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x)), lambda s: F.transform(x, lambda v: (v - m) / F.greatest(s, F.lit(1e-8)))))

    def rest(d: Column, v: Column, t: Column) -> Column:
        at = t / d["n"]
        slow = F.when((d["second"] < 0.5) & (d["p"] * 7 <= d["n"] / 3), (0.3 + 0.7 * d["size"]) * F.sin(2 * math.pi * (t / (d["p"] * 7) + d["second phase"]))).otherwise(0.0)
        trend = F.when(d["trend"] < 0.5, d["slope"] * at).otherwise(0.0)
        shift = F.when((d["shift"] < 0.2) & (at > 0.2 + 0.7 * d["when"]), d["jump"]).otherwise(0.0)
        return v + slow + trend + shift + F.exp(math.log(0.003) + d["noise"] * (math.log(0.15) - math.log(0.003))) * normal(d["key"], "error", t)

    def placed(d: Column, x: Column) -> Column:
        return let(F.when(d["floor"] < 0.3, F.array_min(x)).otherwise(0.0), lambda low: F.transform(x, lambda v: (v - low) * F.exp(-1 + 5 * d["scale"]) - 10 + 1010 * d["level"]))

    made = let(draws, lambda d: let(shape(d), lambda x: let(scaled(x), lambda z: let(F.transform(z, lambda v, t: rest(d, v, t)), lambda y: placed(d, y)))))
    return dealt(what, key).withColumn(values, F.when(n > 0, made).otherwise(F.array().cast("array<double>")))
