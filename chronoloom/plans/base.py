"""The registry, and the test tables read as series."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: A rounded number in SQL. DuckDB rounds to -0.0 what is a little below zero, Spark to 0.0; adding 0.0 makes them one.
_UNSIGNED = re.compile(r"\) / (10{2,})(?=\s*(?:AS\b|,|\)|ORDER\b|FROM\b|$))")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows. $name in the SQL stands for one of INPUTS."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            needed, text = [], sql.strip()
            for name in INPUTS:
                if f"${name}" in text:
                    text = text.replace(f"${name}", name)
                    needed += [n for n in (*_BELOW.get(name, ()), name) if n not in needed]
            with_ = ", ".join(f"{n} AS ({INPUTS[n].strip()})" for n in needed)
            if text.upper().startswith("WITH "):
                text = f"WITH {with_}, {text[5:]}" if with_ else text
            elif with_:
                text = f"WITH {with_} {text}"
            ORACLES[f.__name__] = _UNSIGNED.sub(r") / \1 + 0.0", text)
        return f

    return put


#: The inputs below in SQL.
INPUTS = {
    "vec": "SELECT vec_id AS series, label AS subset, unnest(range(64)) AS step, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings",
    "gappy": "SELECT series, subset, step, CASE WHEN (series * 7 + step * 3) % 11 = 0 OR step < series % 5 OR step >= 64 - series % 4 THEN NULL ELSE value END AS value FROM vec",
    "shifted": "SELECT series, subset, step, value * 10 + 50 + series % 7 AS value FROM vec",
    "observed_hours": "SELECT event_type AS series, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS step, round(avg(value) * 1000) / 1000 AS value FROM events GROUP BY 1, 2",
    "hourly": "SELECT s.series, g.step, h.value FROM (SELECT DISTINCT series FROM observed_hours) s CROSS JOIN (SELECT unnest(range(720)) AS step) g LEFT JOIN observed_hours h ON h.series = s.series AND h.step = g.step",
    "hour_arrays": "SELECT series, list(value ORDER BY step) AS vals FROM hourly GROUP BY series",
    "days": "SELECT l_returnflag || l_linestatus AS series, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS step, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2",
    "cuts": "SELECT h.series, o.origin, list(h.value ORDER BY h.step) FILTER (WHERE h.step < 720 - (o.origin + 1) * 48) AS context, list(h.value ORDER BY h.step) FILTER (WHERE h.step >= 720 - (o.origin + 1) * 48 AND h.step < 720 - o.origin * 48) AS target FROM hourly h CROSS JOIN (SELECT CAST(unnest(range(4)) AS INT) AS origin) o GROUP BY 1, 2",
    "cut_steps": "SELECT h.series, o.origin, h.step - (720 - (o.origin + 1) * 48) AS i, h.value AS y, n.value AS naive FROM hourly h CROSS JOIN (SELECT CAST(unnest(range(4)) AS INT) AS origin) o JOIN hourly n ON n.series = h.series AND n.step = 720 - (o.origin + 1) * 48 - 24 + (h.step - (720 - (o.origin + 1) * 48)) % 24 WHERE h.step >= 720 - (o.origin + 1) * 48 AND h.step < 720 - o.origin * 48",
    "fans": "SELECT series, origin, i, y, naive, level, naive + (level - 0.5) * 8 AS q FROM cut_steps CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS level)",
    "configs": "SELECT 'ds' || CAST(p_partkey % 97 AS VARCHAR) || '/' || p_brand || '/' || CASE p_size % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END || CAST(p_partkey AS VARCHAR) AS config, p_partkey, CAST(p_size * 12 AS INT) AS prediction_length, CAST(p_partkey % 13 AS INT) AS num_variates, p_type AS domain, CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '?' END AS cousin FROM part",
    "own": "SELECT config, (p_partkey % 17 + 3) / 10.0::DOUBLE AS crps, (p_partkey % 23 + 4) / 20.0::DOUBLE AS mase FROM configs",
    "rival": "SELECT config, (p_partkey % 11 + 5) / 10.0::DOUBLE AS crps, (p_partkey % 19 + 6) / 20.0::DOUBLE AS mase FROM configs WHERE p_partkey % 10 <> 0",
}
_BELOW = {
    "gappy": ("vec",), "shifted": ("vec",), "hourly": ("observed_hours",), "hour_arrays": ("observed_hours", "hourly"), "cuts": ("observed_hours", "hourly"), "cut_steps": ("observed_hours", "hourly"),
    "fans": ("observed_hours", "hourly", "cut_steps"), "own": ("configs",), "rival": ("configs",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(spark: SparkSession, name: str) -> str:
    """A folder of its own for what a query writes: in spark.checkpoint.dir if it is set, else a temporary one in local mode, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="chronoloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, subset, values: the embeddings as series of 64 steps."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series"), F.col("label").alias("subset"), F.col("embedding").cast("array<double>").alias("values"))


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).select("series", "subset", F.posexplode("values").alias("step", "value")).withColumn("step", F.col("step").cast("long"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with missing values."""
    gone = ((F.col("series") * 7 + F.col("step") * 3) % 11 == 0) | (F.col("step") < F.col("series") % 5) | (F.col("step") >= 64 - F.col("series") % 4)
    return vec(spark, sf_dir).withColumn("value", F.when(~gone, F.col("value")))


def gappy_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as arrays, without a shuffle."""
    s = F.col("series")
    return arrays(spark, sf_dir).withColumn("values", F.transform("values", lambda v, i: F.when(~(((s * 7 + i * 3) % 11 == 0) | (i < s % 5) | (i >= 64 - s % 4)), v)))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with a level of their own."""
    return vec(spark, sf_dir).withColumn("value", F.col("value") * 10 + 50 + F.col("series") % 7)


def observed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (event type), step (hour), value (mean to 3 digits) where there were events."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").alias("step"), "value")
    return e.groupBy("series", "step").agg(rounded(F.avg("value"), 3).alias("value"))


def hour_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, values: 720 hours, NULL where nothing was observed. One aggregation per series; the calendar needs no join."""
    seen = observed_hours(spark, sf_dir).groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct(F.col("step").cast("long").alias("s"), "value"))).alias("m"))
    return seen.select("series", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long")), lambda s: F.try_element_at("m", s)).alias("values"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hour_arrays(spark, sf_dir).select("series", F.posexplode("values").alias("step", "value")).withColumn("step", F.col("step").cast("long"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (flag and status), step (day from 1995 on), value (quantity)."""
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("series"), F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("step"), "l_quantity")
    return li.groupBy("series", "step").agg(F.sum("l_quantity").alias("value"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, origin, context, target: the last four cuts of the hourly series, 48 steps each."""
    from ..operators.match import cuts as cut

    return cut(hour_arrays(spark, sf_dir), 4, 48, 24)


def cut_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, origin, i, y, naive: the cuts' targets with the seasonal naive, long."""
    from ..operators.forecast import seasonal_naive

    c = cuts(spark, sf_dir).withColumn("naive", seasonal_naive("context", 48, 24))
    return c.select("series", "origin", F.posexplode(F.arrays_zip(F.col("target").alias("y"), F.col("naive").alias("q"))).alias("i", "x")).select("series", "origin", "i", F.col("x.y").alias("y"), F.col("x.q").alias("naive"))


def fans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naive with a fan of nine levels about it."""
    level = F.explode(F.array(*(F.lit(x / 10) for x in range(1, 10)))).alias("level")
    return cut_steps(spark, sf_dir).select("*", level).withColumn("q", F.col("naive") + (F.col("level") - 0.5) * 8)


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of a leaderboard, made from parts."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    term = F.when(F.col("p_size") % 3 == 0, "short").when(F.col("p_size") % 3 == 1, "medium").otherwise("long")
    config = F.concat(F.lit("ds"), (k % 97).cast("string"), F.lit("/"), F.col("p_brand"), F.lit("/"), term, k.cast("string"))
    return p.select(config.alias("config"), "p_partkey", (F.col("p_size") * 12).cast("int").alias("prediction_length"), (k % 13).cast("int").alias("num_variates"), F.col("p_type").alias("domain"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("?").alias("cousin"))


def own(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return configs(spark, sf_dir).select("config", ((k % 17 + 3) / 10).alias("crps"), ((k % 23 + 4) / 20).alias("mase"))


def rival(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return configs(spark, sf_dir).where(k % 10 != 0).select("config", ((k % 11 + 5) / 10).alias("crps"), ((k % 19 + 6) / 20).alias("mase"))
