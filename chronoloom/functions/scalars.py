"""Rounding, null handling and aggregates that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value worked out once. A column that a lambda refers to is otherwise inlined there, and worked out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(c: str | Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def half_even(c: str | Column, digits: int = 0) -> Column:
    """Rounded as numpy rounds: the scaled value, halves to even."""
    return F.rint(col(c) * float(10**digits)) / float(10**digits) if digits else F.rint(col(c))


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(col(c) * float(10**digits)) / float(10**digits)


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """a / b in doubles; NULL where b is 0 or NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def geomean(c: str | Column) -> Column:
    """Geometric mean of the finite values above 0; NULL if there are none."""
    c = finite(c)
    return F.exp(F.avg(F.when(c > 0, F.ln(c))))


def geomean_floored(c: str | Column, floor: float = 1e-6) -> Column:
    return F.exp(F.avg(F.ln(F.greatest(col(c), F.lit(floor)))))


def geomean_clipped(c: str | Column, lo: float = 1e-3, hi: float = 1e3) -> Column:
    return F.exp(F.avg(F.ln(F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi)))))


def lower_median(c: str | Column) -> Column:
    """The lower of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})") if isinstance(c, str) else F.sort_array(F.collect_list(c))[F.floor((F.count(c) - 1) / 2).cast("int")]


def quantile(c: str | Column, p: float) -> Column:
    """Quantile with linear interpolation."""
    return F.percentile(col(c), F.lit(p))


def sample_std(c: str | Column) -> Column:
    """Standard deviation with n - 1; 0 for a single value."""
    return F.when(F.count(col(c)) > 0, F.coalesce(F.stddev_samp(col(c)), F.lit(0.0)))


def softplus(c: str | Column) -> Column:
    """ln(1 + exp(x)), stable for large x."""
    c = col(c)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def sigmoid(c: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))


def mode(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """keys, c, votes: the most frequent value per key, the smaller of equals."""
    counted = df.groupBy(*keys, c).agg(F.count("*").alias("votes"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(c).alias(c))).alias("b"))
    return best.select(*keys, F.col(f"b.{c}").alias(c), (-F.col("b.v")).alias("votes"))
