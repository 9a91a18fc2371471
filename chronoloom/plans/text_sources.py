"""Text formats, parsed from lines that the test tables make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import numeric
from ..sources import text
from .base import query, table


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numeric(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS geo, p_brand AS unit, p.period, CASE WHEN p_partkey % 4 = 0 AND p.period = '2020-02' THEN NULL ELSE p_size + p.j END::DOUBLE AS number FROM part CROSS JOIN (SELECT unnest(['2020-01', '2020-02', '2020-03']) AS period, unnest([0, 1, 2]) AS j) p")
def sdmx_table(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand")
    cells = [F.concat((F.col("p_size") + j).cast("string"), F.lit(flag)) for j, flag in enumerate((" p", "", " e"))]
    cells[1] = F.when(F.col("p_partkey") % 4 == 0, ": c").otherwise(cells[1])
    lines = p.select(F.concat_ws("\t", key, *cells).alias("value")).union(spark.createDataFrame([("geo,unit\\TIME_PERIOD\t2020-01 \t2020-02 \t2020-03 ",)], "value string"))
    out = text.sdmx_tsv(lines)
    return out.select(F.col("key")["geo"].alias("geo"), F.col("key")["unit"].alias("unit"), "period", "number")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'K' || CAST(p_size AS VARCHAR) ELSE 'mix k1:0.25 k' || CAST(p_size + 1 AS VARCHAR) || ':0.75' END AS rates FROM part")
def run_rates(spark, sf_dir):
    k = F.col("p_partkey") % 3 == 0
    rates = F.when(~k, F.create_map(F.lit(1), F.lit(0.25), F.col("p_size") + 1, F.lit(0.75)))
    return table(spark, sf_dir, "part").select("p_partkey", text.rates_text(rates, F.concat(F.lit("K"), F.col("p_size").cast("string"))).alias("rates"))


@query("SELECT c_custkey, CAST(j AS INT) AS hour, (c_acctbal + j)::DOUBLE AS value FROM customer CROSS JOIN (SELECT unnest(range(4)) AS j)")
def hour_columns(spark, sf_dir):
    wide = table(spark, sf_dir, "customer").select("c_custkey", *((F.col("c_acctbal") + i).alias(f"h{i}") for i in range(4)))
    return text.hourly_columns(wide, ["c_custkey"], [f"h{i}" for i in range(4)])
