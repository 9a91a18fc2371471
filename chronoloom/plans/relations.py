"""Joins, sets and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import match
from ..operators.metrics import spearman
from ..operators.order import running
from .base import arrays, configs, gappy_arrays, own, place, query, rival, table, vec


@query("SELECT o_orderkey, c_custkey FROM orders JOIN (SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(*) > 0) ON k = o_custkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal IN (SELECT c_acctbal FROM customer GROUP BY 1 HAVING count(*) = 1)")
def match_unique_hash(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("key"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey").select("o_orderkey", "key")
    return match.match_unique(o, c).select("o_orderkey", "c_custkey")


@query("SELECT a.series, b.series AS copy FROM (SELECT DISTINCT series FROM $vec) a JOIN (SELECT DISTINCT series FROM vec) b ON a.series = b.series")
def match_values(spark, sf_dir):
    a = match.fingerprint(arrays(spark, sf_dir).select("series", "values")).select("series", "key")
    b = match.fingerprint(arrays(spark, sf_dir).select(F.col("series").alias("copy"), "values")).select("copy", "key")
    return match.match_unique(a, b).select("series", "copy")


@query("SELECT a.l_suppkey, b.l_returnflag, count(*) AS shared FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O') a JOIN (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem WHERE l_linestatus = 'F') b ON a.l_partkey = b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 3")
def semi_threshold(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "key")
    return match.sharing(li.where("l_linestatus = 'O'"), li.where("l_linestatus = 'F'"), ["l_suppkey"], ["l_returnflag"])


@query("SELECT series AS series_id, max(CASE WHEN step = 0 THEN value END) AS a0, max(CASE WHEN step = 0 THEN -value END) AS b0, 64 AS n FROM $vec GROUP BY series")
def zip_join(spark, sf_dir):
    a = arrays(spark, sf_dir).select(F.col("series").alias("series_id"), "values")
    out = match.zip_channels({"a": a, "b": a.withColumn("values", F.transform("values", lambda v: -v))})
    return out.select("series_id", F.get("a", F.lit(0)).alias("a0"), F.get("b", F.lit(0)).alias("b0"), F.size("a").alias("n"))


@query("SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def meta_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    c = match.with_metadata(table(spark, sf_dir, "customer"), n, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name", "r_name")
    return match.with_metadata(table(spark, sf_dir, "orders"), c, "o_custkey").select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT o.config, o.crps AS a_crps, o.mase AS a_mase, r.crps AS b_crps, r.mase AS b_mase FROM $own o JOIN $rival r ON r.config = o.config")
def run_intersect(spark, sf_dir):
    return match.common({"a": own(spark, sf_dir), "b": rival(spark, sf_dir)}, "config")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def anti_drop(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return match.drop_listed(table(spark, sf_dir, "orders"), gone, ["o_custkey"]).select("o_orderkey")


def _items(spark, sf_dir):
    """Items of neighbouring series, shifted against each other."""
    a = arrays(spark, sf_dir)
    return a.select(F.floor(F.col("series") / 3).cast("long").alias("item_id"), (F.col("series") % 3).cast("int").alias("member_pos"), F.col("subset").cast("string").alias("subset"), F.col("series").alias("series_id"), (F.col("series") % 5 * 2).alias("shift"))


@query("SELECT series // 3 AS item_id, max(series % 5 * 2) AS start, min(series % 5 * 2 + 64) AS \"end\" FROM (SELECT DISTINCT series FROM $vec) GROUP BY 1")
def item_span(spark, sf_dir):
    lengths = arrays(spark, sf_dir).select(F.col("subset").cast("string").alias("subset"), F.col("series").alias("series_id"), F.size("values").cast("long").alias("length"))
    return match.item_span(_items(spark, sf_dir), lengths)


@query("""
WITH m AS (SELECT series // 3 AS item_id, CAST(series % 3 AS INT) AS member_pos, step + series % 5 * 2 AS step, value FROM $vec),
s AS (SELECT item_id, min(step) AS lo, max(step) AS hi FROM m GROUP BY 1), p AS (SELECT DISTINCT item_id, member_pos FROM m),
a AS (SELECT p.item_id, member_pos, unnest(range(lo, hi + 1)) AS step FROM p JOIN s ON s.item_id = p.item_id)
SELECT a.item_id, a.member_pos, a.step, m.value FROM a LEFT JOIN m ON m.item_id = a.item_id AND m.member_pos = a.member_pos AND m.step = a.step""")
def item_aligned(spark, sf_dir):
    points = vec(spark, sf_dir).select(F.col("subset").cast("string").alias("subset"), F.col("series").alias("series_id"), "step", "value")
    return match.aligned(_items(spark, sf_dir), points)


@query("SELECT item_id, series AS series_id FROM (SELECT series // 3 AS item_id, series, count(*) OVER (PARTITION BY series // 3) AS n FROM (SELECT DISTINCT series, subset FROM $vec) WHERE subset < 6) WHERE n >= 2")
def loaded_items(spark, sf_dir):
    return match.loaded_items(_items(spark, sf_dir), arrays(spark, sf_dir).where("subset < 6").select(F.col("subset").cast("string").alias("subset"))).select("item_id", "series_id")


@query("SELECT series, CAST(i AS INT) AS i, value FROM $vec CROSS JOIN (SELECT unnest(range(30)) AS i) WHERE step = 64 - 12 + i % 12")
def seasonal_lag(spark, sf_dir):
    return match.seasonal_lag(vec(spark, sf_dir), ["series"], 12, 30).select("series", "i", "value")


@query("SELECT DISTINCT p_brand AS dataset, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN (CASE WHEN p_brand = 'Brand#1' AND EXISTS (SELECT 1 FROM part WHERE contains(p_name, 'red')) THEN 'yes' ELSE 'no' END) ELSE '?' END AS cousin FROM part")
def theta_cousin(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cousins = spark.createDataFrame([("Brand#1", "red"), ("Brand#2", None)], "dataset string, cousin string")
    return match.has_cousin(p.select(F.col("p_brand").alias("dataset")).distinct(), cousins, p.select(F.col("p_name").alias("stem")).distinct())


@query("SELECT c_mktsegment, CASE WHEN count(*) FILTER (WHERE c_acctbal > 0) > 0 THEN round(exp(avg(ln(CASE WHEN c_acctbal > 0 THEN c_acctbal END))) * 1000000) / 1000000 END AS geo, round(exp(avg(ln(greatest(c_acctbal, 0.000001)))) * 1000000) / 1000000 AS floored, round(exp(avg(ln(least(greatest(c_acctbal / 1000, 0.001), 1000)))) * 1000000) / 1000000 AS clipped FROM customer GROUP BY 1")
def geomeans(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy("c_mktsegment").agg(sc.rounded(sc.geomean("c_acctbal")).alias("geo"), sc.rounded(sc.geomean_floored("c_acctbal")).alias("floored"), sc.rounded(sc.geomean_clipped(F.col("c_acctbal") / 1000)).alias("clipped"))


@query("SELECT l_suppkey, quantile_disc(l_quantity, 0.5) AS lower, median(l_quantity) AS middle, round(quantile_cont(l_extendedprice, 0.1) * 1000000) / 1000000 AS q10, round(coalesce(stddev_samp(l_quantity), 0) * 1000000) / 1000000 AS std FROM lineitem GROUP BY 1")
def medians(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(sc.lower_median("l_quantity").alias("lower"), F.median("l_quantity").alias("middle"), sc.rounded(sc.quantile("l_extendedprice", 0.1)).alias("q10"), sc.rounded(sc.sample_std("l_quantity")).alias("std"))


@query("SELECT subset, round(avg(value) * 1000000) / 1000000 AS mean, round(sum(value) * 1000000) / 1000000 AS total, round(stddev_pop(value) * 1000000) / 1000000 AS dev, round(median(value) * 1000000) / 1000000 AS middle FROM $gappy GROUP BY 1")
def nan_skipping(spark, sf_dir):
    v = gappy_arrays(spark, sf_dir).select("subset", F.explode("values").alias("value"))
    return v.groupBy("subset").agg(*(sc.rounded(f("value")).alias(n) for f, n in ((F.avg, "mean"), (F.sum, "total"), (F.stddev_pop, "dev"), (F.median, "middle"))))


@query("SELECT o_custkey, o_orderpriority, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1")
def mode_vote(spark, sf_dir):
    return sc.mode(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("WITH r AS (SELECT c_nationkey, c_custkey % 40 AS x, c_acctbal AS y FROM customer), a AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY x) + (count(*) OVER (PARTITION BY c_nationkey, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY c_nationkey ORDER BY y) + (count(*) OVER (PARTITION BY c_nationkey, y) - 1) / 2.0 AS ry FROM r) SELECT c_nationkey, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry) * 1000000) / 1000000 END AS rho FROM a GROUP BY 1")
def rank_correlation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 40).alias("x"), F.col("c_acctbal").alias("y"))
    return spearman(c, ["c_nationkey"], "x", "y").select("c_nationkey", sc.rounded("rho").alias("rho"))


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def first_of_key(spark, sf_dir):
    from ..operators.overlap import first_of_equals

    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("key"))
    return first_of_equals(p, "p_partkey").join(table(spark, sf_dir, "part"), "p_partkey").select("p_brand", "p_partkey")


@query("SELECT p_type, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_size ORDER BY (CASE WHEN p_brand LIKE 'Brand#1%' THEN 2 ELSE 0 END) + (CASE WHEN p_name LIKE 'red%' THEN 0 ELSE 1 END), p_partkey) AS r FROM part) WHERE r = 1")
def best_rank(spark, sf_dir):
    from ..sources.text import best_copies

    p = table(spark, sf_dir, "part").withColumn("unit", F.when(F.col("p_brand").startswith("Brand#1"), "PCH").otherwise("X")).withColumn("s_adj", F.when(F.col("p_name").startswith("red"), "NSA").otherwise("SA"))
    return best_copies(p, ["p_type", "p_size"], "p_partkey").select("p_type", "p_size", "p_partkey")


@query("SELECT p_size, CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INT) AS place FROM (SELECT DISTINCT p_size FROM part)")
def unique_inverse(spark, sf_dir):
    places = running(table(spark, sf_dir, "part").select("p_size").distinct(), F.col("p_size"), {"place": F.lit(1)})
    return places.select("p_size", (F.col("place") - 1).cast("int").alias("place"))


@query("SELECT l_returnflag, l_linenumber, quantile_cont(l_quantity, 0.01) AS p1, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1, 2")
def percentiles(spark, sf_dir):
    p = F.percentile("l_quantity", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(p.alias("p"))
    return out.select("l_returnflag", "l_linenumber", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p1", "p50", "p99"))))


@query("SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    f, op, p = (o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FOP")
    return f.intersect(op).subtract(p)


@query("SELECT config FROM $own UNION SELECT config FROM $rival")
def union_names(spark, sf_dir):
    return own(spark, sf_dir).select("config").unionByName(rival(spark, sf_dir).select("config")).distinct()


@query("SELECT domain, count(*) AS n, count(DISTINCT config) AS configs FROM $configs GROUP BY 1")
def config_counts(spark, sf_dir):
    return configs(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("config").alias("configs"))


@query("SELECT d, CAST(sum(obs) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS obs FROM orders GROUP BY 1)")
def batch_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("obs"))
    return running(d, F.unix_date("d"), {"upto": F.col("obs")}).select("d", "upto")


@query("SELECT domain, CAST(sum(n) AS BIGINT) AS n FROM (SELECT domain, count(*) AS n FROM $configs WHERE num_variates > 3 GROUP BY 1 UNION ALL SELECT domain, count(*) FROM configs WHERE num_variates <= 3 GROUP BY 1) GROUP BY 1")
def union_all(spark, sf_dir):
    c = configs(spark, sf_dir)
    return c.where("num_variates > 3").unionByName(c.where("num_variates <= 3")).groupBy("domain").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3] AS top FROM orders GROUP BY 1")
def top_per_group(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("top"))


@query("""
SELECT l_returnflag, p.p, round(CASE p.p WHEN 0.01 THEN quantile_cont(l_extendedprice, 0.01) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.9999) END * 1000000) / 1000000 AS q
FROM lineitem CROSS JOIN (SELECT unnest([0.01, 0.5, 0.9999]::DOUBLE[]) AS p) p GROUP BY 1, 2""")
def quantiles_of_hot_keys(spark, sf_dir):
    """Exact quantiles of three large groups, without a task that holds one."""
    from ..functions.quantiles import exact_quantiles

    out = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.01, 0.5, 0.9999), _kept(spark))
    return out.withColumn("q", sc.rounded("q"))


@query("SELECT 0.5::DOUBLE AS p, quantile_disc(l_quantity, 0.5) AS q FROM lineitem")
def lower_median_of_all(spark, sf_dir):
    """The lower median of a whole table, whose values repeat."""
    from ..functions.quantiles import exact_quantiles

    return exact_quantiles(table(spark, sf_dir, "lineitem"), [], "l_quantity", (0.5,), _kept(spark), lower=True)


def _kept(spark):
    """Writes a table that is read several times, and reads it back."""

    def written(df):
        path = place(spark, "brackets")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return written
