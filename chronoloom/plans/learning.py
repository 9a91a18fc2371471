"""Fitted forecasters, the rate selector, and models kept as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import artefact, fit, learned
from .base import arrays, hour_arrays, place, query
from .base import cuts as hour_cuts

_LAGS = "SELECT label AS subset, embedding[CAST(t AS INT)]::DOUBLE AS a, embedding[CAST(t - 1 AS INT)]::DOUBLE AS b, embedding[CAST(t + 1 AS INT)]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(2, 64)) AS t)"


def _kept(spark: SparkSession):
    """Writes a table that is read many times, and reads it back."""

    def written(df: DataFrame) -> DataFrame:
        path = place(spark, "fit")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return written


def _lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phi (a value and the one before it), y (the next one): all steps of all series."""
    at = F.explode(F.sequence(F.lit(2), F.lit(63)))
    d = arrays(spark, sf_dir).select("values", at.alias("t"))
    return d.select(F.array(F.get("values", F.col("t") - 1), F.get("values", F.col("t") - 2)).alias("phi"), F.get("values", "t").alias("y"))


@query(f"""
WITH x AS ({_LAGS}), g AS (SELECT count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy, sum(a * a) + 5 AS aa, sum(a * b) AS ab, sum(b * b) + 5 AS bb, sum(a * y) AS ay, sum(b * y) AS bw FROM x),
c AS (SELECT *, aa - sa * sa / n AS p, ab - sa * sb / n AS q, bb - sb * sb / n AS r, ay - sa * sy / n AS u, bw - sb * sy / n AS v FROM g),
w AS (SELECT *, (u * r - v * q) / (p * r - q * q) AS wa, (v * p - u * q) / (p * r - q * q) AS wb FROM c)
SELECT round((wa) * 1000000) / 1000000 AS a, round(wb * 1000000) / 1000000 AS b, round((sy - wa * sa - wb * sb) / n * 1000000) / 1000000 AS c FROM w""")
def ridge_start(spark, sf_dir):
    """Coefficients of the next value on the last two, with a penalty, over all series: one pass of partial sums."""
    w, c = fit.ridge(_lags(spark, sf_dir), 2, 5.0)
    return spark.createDataFrame([(*map(float, w), c)], "a double, b double, c double").select(*(rounded(x).alias(x) for x in "abc"))


@query()
def refit_losses(spark, sf_dir):
    """A last layer of nine quantiles on the same features, by L-BFGS from the ridge start: mean pinball losses, evaluation by evaluation."""
    _, _, losses = fit.refit(_kept(spark)(_lags(spark, sf_dir)), 2, learned.LEVELS, 1e-3, 12)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "evaluation int, loss double")


def _vec_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, fold, context (48), target (16)."""
    return arrays(spark, sf_dir).select("series", (F.col("series") % 2).alias("fold"), F.slice("values", 1, 48).alias("context"), F.slice("values", 49, 16).alias("target"))


@query()
def learned_forecasts(spark, sf_dir):
    """Forecasters fitted on the earlier cuts of the hourly series, one that reads single steps and one that reads patches of eight, kept as a model and read again; quantiles of the last cut."""
    c = hour_cuts(spark, sf_dir)
    model, path = learned.frozen(), place(spark, "model")
    for patch in (1, 8):
        model, _ = learned.fit(c.where("origin > 0"), model, patch, _kept(spark), steps=10)
    artefact.save_model(spark, path, model)
    read = artefact.load_model(spark, path, {k: v.shape for k, v in model.items()})
    out = learned.forecast(c.where("origin = 0").withColumn("patch", F.explode(F.array(F.lit(1), F.lit(8)))), read, 48, "patch")
    return out.select("series", "patch", F.posexplode("quantiles").alias("step", "q")).select("series", "patch", "step", F.transform("q", lambda v: F.round(v, 4)).alias("q"))


def _season(x: np.ndarray, h: int) -> np.ndarray:
    """The last 24 steps again."""
    return np.resize(x[-24:], h)


@query("SELECT series, step - 48 AS i, round(value * 1000000) / 1000000 + 0.0 AS value, 1.0::DOUBLE AS k FROM (SELECT vec_id AS series, unnest(range(48, 64)) AS step, unnest(list_transform(range(16), lambda i: embedding[CAST(25 + i AS INT)]::DOUBLE)) AS value FROM embeddings)")
def rate_selector(spark, sf_dir):
    """The selector's law: with weights of zero the rate is 1 and the forecast is the inner one's own, bit for bit."""
    out = learned.select_rate(_vec_cuts(spark, sf_dir), _season, 16, np.zeros(3))
    return out.select("series", F.posexplode("forecast").alias("i", "value"), "k").select("series", F.col("i").cast("long").alias("i"), rounded("value").alias("value"), "k")


@query()
def rate_selector_fit(spark, sf_dir):
    """Hourly series read every hour, two and three hours (the season is then 24, 12 and 8 steps): a selector fitted on the earlier cuts; losses of the last cut as it reads them, and at rate 1."""
    base = hour_arrays(spark, sf_dir).withColumn("every", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    read = base.withColumn("values", F.filter("values", lambda v, i: i % F.col("every") == 0))
    cut = lambda o: read.select("series", "every", F.slice("values", F.lit(1), F.size("values") - 24 * (o + 1)).alias("context"), F.slice("values", F.size("values") - 24 * (o + 1) + 1, F.lit(24)).alias("target"))
    past = cut(1).unionByName(cut(2)).unionByName(cut(3))
    weights, _ = learned.fit_selector(_kept(spark)(learned.loss_curves(past, _season).select("seen", "losses")))
    out = learned.select_rate(cut(0), _season, 24, weights)
    loss = lambda f: F.aggregate(F.zip_with(f, "target", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    @F.pandas_udf("array<double>")
    def bare(contexts: pd.Series) -> pd.Series:
        return pd.Series([_season(learned._filled(c), 24).tolist() for c in contexts])

    return out.withColumn("bare", bare("context")).select("series", "every", F.round("k", 4).alias("k"), F.round(loss("forecast"), 4).alias("loss"), F.round(loss("bare"), 4).alias("bare"))


@query("SELECT 'w' || CAST(vec_id AS VARCHAR) AS name, unnest(range(64)) AS at, round(unnest(embedding)::DOUBLE * 1000000) / 1000000 + 0.0 AS value FROM embeddings")
def model_round_trip(spark, sf_dir):
    """Arrays kept as a versioned model, each with its shape and digest, and read again once all agree."""
    path = place(spark, "model")
    v = arrays(spark, sf_dir).select(F.concat(F.lit("w"), F.col("series").cast("string")).alias("name"), F.array(F.lit(8), F.lit(8)).alias("shape"), "values")
    artefact.save_arrays(v, path)
    return artefact.load_arrays(spark, path).select("name", F.posexplode("values").alias("at", "value")).select("name", F.col("at").cast("long").alias("at"), rounded("value").alias("value"))
