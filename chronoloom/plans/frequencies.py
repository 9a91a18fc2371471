"""Frequencies, seasons, buckets and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frequency as fr
from ..functions.scalars import rounded
from .base import configs, query, table

_FREQS = ["10S", "5T", "15min", "30T", "H", "6h", "D", "2D", "B", "W-SUN", "MS", "M", "m", "QE-DEC", "A-DEC", "ys", "x1", "T"]
_SQL_FREQS = "[" + ", ".join(f"'{f}'" for f in _FREQS) + "]"
_SQL_UNIT = "CASE lower(regexp_extract(freq, '^[0-9]*([A-Za-z]+)', 1)) WHEN 's' THEN 'S' WHEN 't' THEN 'T' WHEN 'min' THEN 'T' WHEN 'h' THEN 'H' WHEN 'd' THEN 'D' WHEN 'b' THEN 'D' WHEN 'w' THEN 'W' WHEN 'ms' THEN 'M' WHEN 'm' THEN 'M' WHEN 'qe' THEN 'Q' WHEN 'a' THEN 'A' WHEN 'ys' THEN 'A' END"
_SQL_PARSED = f"SELECT p_partkey, freq, CASE WHEN regexp_full_match(freq, '[0-9]*[A-Za-z]+(-[A-Za-z]+)?') THEN {_SQL_UNIT} END AS unit, coalesce(TRY_CAST(regexp_extract(freq, '^([0-9]*)', 1) AS INT), 1) AS n FROM (SELECT p_partkey, {_SQL_FREQS}[CAST(p_partkey % {len(_FREQS)} + 1 AS INT)] AS freq FROM part)"
_SQL_SEASON = "CASE unit WHEN 'A' THEN 4.0 WHEN 'D' THEN (CASE WHEN weekly THEN 7.0 ELSE 365.0 END) / n WHEN 'S' THEN 3600.0 / n WHEN 'T' THEN 1440.0 / n WHEN 'H' THEN 24.0 / n WHEN 'W' THEN (365.0 / 7.0) / n WHEN 'M' THEN 12.0 / n WHEN 'Q' THEN 4.0 / n END"


def _freqs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _FREQS)), (F.col("p_partkey") % len(_FREQS) + 1).cast("int")).alias("freq"))


@query(f"SELECT p_partkey, unit, CASE WHEN unit IS NOT NULL THEN n END AS n FROM ({_SQL_PARSED})")
def parse_freq(spark, sf_dir):
    return _freqs(spark, sf_dir).select("p_partkey", fr.parse_frequency("freq").alias("f")).select("p_partkey", "f.unit", "f.n")


@query(f"SELECT p_partkey, round(CAST({_SQL_SEASON} AS DOUBLE) * 1000000) / 1000000 AS season FROM (SELECT *, p_partkey % 2 = 0 AS weekly FROM ({_SQL_PARSED}))")
def season_len(spark, sf_dir):
    return _freqs(spark, sf_dir).select("p_partkey", rounded(fr.season_length("freq", F.col("p_partkey") % 2 == 0)).alias("season"))


@query("SELECT p_partkey, least(greatest(24.0::DOUBLE / p_size, 0.9), 8.0) AS w FROM part")
def delta_scale(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fr.delta_scale("p_size", 0.9, 8.0).alias("w"))


@query(f"SELECT p_partkey, CASE WHEN unit = 'T' THEN (CASE WHEN n <= 5 THEN '5T' ELSE '15T' END) ELSE unit END AS rate FROM ({_SQL_PARSED})")
def rate_class(spark, sf_dir):
    return _freqs(spark, sf_dir).select("p_partkey", fr.rate_class("freq").alias("rate"))


_NAMES = ["m5", "nn5_daily", "era5_1999", "synth_tight_H", "weather_s12", "hydro_dec3", "taxi_30min", "load_2021"]
_SQL_NAMES = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


def _names(spark, sf_dir):
    return _freqs(spark, sf_dir).withColumn("name", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int")))


@query(f"SELECT p_partkey, coalesce(round(24.0 / CAST({_SQL_SEASON} AS DOUBLE) * 1000000) / 1000000, 0.0) AS scale FROM (SELECT *, regexp_matches({_SQL_NAMES}[CAST(p_partkey % {len(_NAMES)} + 1 AS INT)], '^(m5|nn5|taxi|synth)') AS weekly FROM ({_SQL_PARSED}))")
def subset_scale(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", rounded(fr.subset_scale("name", "freq")).alias("scale"))


@query(f"SELECT p_partkey, regexp_replace(regexp_replace({_SQL_NAMES}[CAST(p_partkey % {len(_NAMES)} + 1 AS INT)], '_(18|19|20)[0-9][0-9]$', ''), '(_s[0-9]+|_dec[0-9]+)$', '') AS family FROM part")
def family(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", fr.family("name").alias("family"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'kelmarsh' WHEN 1 THEN 'era5' ELSE 'abc' END AS family FROM part")
def item_family(spark, sf_dir):
    k = F.col("p_partkey") % 3
    names = F.when(k == 0, F.array(F.lit("kelmarsh_power"), F.lit("kelmarsh_wind"), F.lit("kelmarsh_rpm"))).when(k == 1, F.array(F.lit("era5_1999"), F.lit("era5_1999"))).otherwise(F.array(F.lit("abc"), F.lit("xyz")))
    return table(spark, sf_dir, "part").select("p_partkey", fr.item_family(names).alias("family"))


_CONFIGS = ["m4_weekly/W/short", "covid_deaths/D/short", "solar/D/long", "bizitobs_l2c/5T/short", "restaurant/D/short", "ett1/15T/medium", "hospital/M/short"]
_SEASONS = [365.0 / 7.0, 7.0, 365.0, 288.0 * 7, 7.0, 96.0, 12.0]


@query(f"SELECT p_partkey, round(CAST({[round(s, 9) for s in _SEASONS]} AS DOUBLE[])[CAST(p_partkey % 7 + 1 AS INT)] * 1000000) / 1000000 AS season FROM part")
def config_season(spark, sf_dir):
    config = F.element_at(F.array(*map(F.lit, _CONFIGS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", rounded(fr.config_season(config)).alias("season"))


@query("SELECT config, CASE WHEN prediction_length <= 64 THEN '<=64' WHEN prediction_length <= 256 THEN '<=256' WHEN prediction_length <= 480 THEN '<=480' ELSE '>480' END AS horizon, CASE WHEN num_variates <= 1 THEN '1' WHEN num_variates <= 10 THEN '2-10' ELSE '>10' END AS variates FROM $configs")
def buckets(spark, sf_dir):
    return configs(spark, sf_dir).select("config", fr.horizon_bucket("prediction_length").alias("horizon"), fr.variates_bucket("num_variates").alias("variates"))


@query("SELECT config, regexp_replace(split_part(config, '/', 3), '[0-9]+', '') AS term, split_part(config, '/', 2) AS freq, domain, cousin FROM $configs")
def group_keys(spark, sf_dir):
    return configs(spark, sf_dir).select("config", *fr.group_keys()).select("config", F.regexp_replace("term", "[0-9]+", "").alias("term"), "freq", "domain", "cousin")


@query(f"SELECT p_partkey, greatest(1, CAST(CASE unit WHEN 'S' THEN 360 WHEN 'T' THEN 288 WHEN 'H' THEN 48 WHEN 'D' THEN 30 WHEN 'W' THEN 8 WHEN 'M' THEN 18 WHEN 'Q' THEN 8 WHEN 'A' THEN 4 END // n AS INT)) AS h, greatest(1, CAST(CASE unit WHEN 'S' THEN 360 WHEN 'T' THEN 288 WHEN 'H' THEN 24 WHEN 'D' THEN 7 WHEN 'W' THEN 52 WHEN 'M' THEN 12 WHEN 'Q' THEN 4 WHEN 'A' THEN 1 END // n AS INT)) AS m FROM ({_SQL_PARSED}) WHERE unit IS NOT NULL")
def cut_lengths(spark, sf_dir):
    f = _freqs(spark, sf_dir).where(fr.frequency_unit("freq").isNotNull())
    h, m = fr.cut_lengths("freq")
    return f.select("p_partkey", h.alias("h"), m.alias("m"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE least(greatest(24.0::DOUBLE * (p_partkey % 4 + 1) / p_size, 0.1), 8.0) END AS w FROM part")
def tied_scale(spark, sf_dir):
    season = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).otherwise(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", fr.tied_scale(season, F.col("p_partkey") % 4 + 1, 0.1, 8.0).alias("w"))
