"""Leaderboard reports over configurations made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import board
from .base import configs, own, query, rival, table

_R = "round({} * 1000000) / 1000000"
_TERM = "regexp_replace(split_part(o.config, '/', 3), '[0-9]+', '')"
_KEYS = f"""SELECT o.config, {_TERM} AS term, CASE WHEN prediction_length <= 64 THEN '<=64' WHEN prediction_length <= 256 THEN '<=256' WHEN prediction_length <= 480 THEN '<=480' ELSE '>480' END AS horizon,
       split_part(o.config, '/', 2) AS freq, CASE WHEN num_variates <= 1 THEN '1' WHEN num_variates <= 10 THEN '2-10' ELSE '>10' END AS variates, cousin, domain, o.crps, o.mase, r.crps AS rc
FROM $own o JOIN $configs c ON c.config = o.config LEFT JOIN $rival r ON r.config = o.config"""


def _described(spark, sf_dir):
    return board.describe(configs(spark, sf_dir)).withColumn("term", F.regexp_replace("term", "[0-9]+", ""))


_REPORT = f"""
WITH k AS ({_KEYS}),
l AS (SELECT 'term' AS "by", term AS grp, * FROM k UNION ALL SELECT 'horizon', horizon, * FROM k UNION ALL SELECT 'freq', freq, * FROM k UNION ALL SELECT 'variates', variates, * FROM k UNION ALL SELECT 'cousin', cousin, * FROM k UNION ALL SELECT 'domain', domain, * FROM k UNION ALL SELECT 'all', 'ALL', * FROM k)
SELECT "by", grp, count(*) AS n, {_R.format('exp(avg(ln(crps)))')} AS crps, {_R.format('exp(avg(ln(mase)))')} AS mase, {_R.format('exp(avg(ln(crps / rc)))')} AS vs_rival, count(*) FILTER (WHERE crps < rc) AS wins, count(rc) AS "both" FROM l GROUP BY 1, 2"""


@query(_REPORT)
def leaderboard_grouping_sets(spark, sf_dir):
    out = board.report(own(spark, sf_dir), rival(spark, sf_dir), _described(spark, sf_dir))
    return out.select("by", "grp", "n", *(rounded(c).alias(c) for c in ("crps", "mase", "vs_rival")), "wins", "both")


@query(f"""
SELECT "by", grp, n, row_number() OVER (ORDER BY list_position(['term', 'horizon', 'freq', 'variates', 'cousin', 'domain', 'all'], "by"), CASE WHEN "by" = 'term' THEN list_position(['short', 'medium', 'long'], grp) ELSE 0 END, n DESC, grp) AS place FROM ({_REPORT})""")
def leaderboard_in_order(spark, sf_dir):
    """The report's rows with the places at which they are printed."""
    return board.in_print_order(leaderboard_grouping_sets(spark, sf_dir)).select("by", "grp", "n", F.col("place").cast("long").alias("place"))


@query(f"SELECT o.config, {_R.format('o.crps / r.crps')} AS crps, {_R.format('o.mase / r.mase')} AS mase FROM $own o JOIN $rival r ON r.config = o.config")
def naive_ratio(spark, sf_dir):
    renamed = [x(spark, sf_dir).withColumnsRenamed({"crps": "CRPS", "mase": "MASE"}) for x in (own, rival)]
    return board.ratios(*renamed).select("config", rounded("crps").alias("crps"), rounded("mase").alias("mase"))


@query(f"SELECT o.config, {_R.format('o.crps / r.crps')} AS ratio, o.crps AS ours, r.crps AS theirs FROM $own o JOIN $rival r ON r.config = o.config ORDER BY o.crps / r.crps DESC, o.config LIMIT 10")
def worst_k(spark, sf_dir):
    return board.worst(own(spark, sf_dir), rival(spark, sf_dir)).withColumn("ratio", rounded("ratio"))


@query(f"SELECT o.config, {_R.format('o.mase / r.mase')} AS mase_rel, {_R.format('o.crps / r.crps')} AS crps_rel, {_R.format('(o.mase / r.mase) / (o.crps / r.crps)')} AS ratio FROM $own o JOIN $rival r ON r.config = o.config ORDER BY (o.mase / r.mase) / (o.crps / r.crps) DESC, o.config LIMIT 10")
def decoupling(spark, sf_dir):
    out = board.decoupled(own(spark, sf_dir), rival(spark, sf_dir))
    return out.select("config", *(rounded(c).alias(c) for c in ("mase_rel", "crps_rel", "ratio")))


@query(f"SELECT count(*) FILTER (WHERE mase >= 0.95) AS near, {_R.format('exp(avg(ln(mase)))')} AS actual, {_R.format('exp(avg(ln(least(mase, 1.0))))')} AS oracle FROM $own")
def oracle_bound(spark, sf_dir):
    return board.oracle_bound(own(spark, sf_dir)).select("near", rounded("actual").alias("actual"), rounded("oracle").alias("oracle"))


@query(f"WITH j AS (SELECT o.config, o.crps / r.crps AS q FROM $own o JOIN $rival r ON r.config = o.config) SELECT 'smallest' AS side, config, {_R.format('q')} AS ratio FROM (SELECT * FROM j ORDER BY q, config LIMIT 12) UNION ALL SELECT 'largest', config, {_R.format('q')} FROM (SELECT * FROM j ORDER BY q DESC, config LIMIT 12)")
def ab_table(spark, sf_dir):
    return board.ab_table(own(spark, sf_dir), rival(spark, sf_dir)).withColumn("ratio", rounded("ratio"))


@query(f"SELECT 'crps' AS metric, count(*) AS configs, {_R.format('max(abs(o.crps / r.crps - 1))')} AS worst, max(abs(o.crps / r.crps - 1)) <= 0.000001 AS ok FROM $own o JOIN $rival r ON r.config = o.config UNION ALL SELECT 'mase', count(*), 0.0, true FROM own o JOIN rival r ON r.config = o.config")
def regression_check(spark, sf_dir):
    o = own(spark, sf_dir)
    r = rival(spark, sf_dir).drop("mase").join(o.select("config", "mase"), "config")
    return board.regression(o, r, ["crps", "mase"]).withColumn("worst", rounded("worst"))


@query(f"SELECT cousin AS grp, count(*) AS n, {_R.format('avg((p_partkey % 17) / 100.0::DOUBLE)')} AS q10, {_R.format('avg((p_partkey % 13 + 80) / 100.0::DOUBLE)')} AS q90, {_R.format('(avg((p_partkey % 13 + 80) / 100.0::DOUBLE) - avg((p_partkey % 17) / 100.0::DOUBLE))')} AS interval, {_R.format('avg(CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 10) / 10.0::DOUBLE END)')} AS coarse FROM $configs WHERE p_partkey % 9 <> 0 GROUP BY 1")
def coverage(spark, sf_dir):
    k = F.col("p_partkey")
    runs = configs(spark, sf_dir).select("cousin", F.when(k % 9 != 0, (k % 17) / 100).alias("q10"), ((k % 13 + 80) / 100).alias("q90"), F.when(k % 2 == 0, (k % 10) / 10).alias("frac_k_gt1"))
    out = board.coverage_report(runs, F.col("cousin"))
    return out.select("grp", "n", *(rounded(c).alias(c) for c in ("q10", "q90", "interval", "coarse")))


@query("SELECT c_custkey AS dataset, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS msis, c_mktsegment AS domain, c_nationkey AS num_variates, 'own' AS model FROM customer")
def submission(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("dataset"), F.when(F.col("c_custkey") % 14 == 0, float("nan")).when(F.col("c_custkey") % 7 == 0, float("inf")).otherwise(F.col("c_acctbal")).alias("msis"))
    meta = c.select(F.col("c_custkey").alias("dataset"), F.col("c_mktsegment").alias("domain"), F.col("c_nationkey").alias("num_variates"))
    return board.submission(rows, meta, "own", ["msis"])


_FALL = "0.5 * (1 + cos(pi() * (step - warmup) / (total - warmup))) * (1 - 0.001) + 0.001"
_DROP = "1 - (1 - 0.001) * (step - (total - total // 5)) / (total // 5)"


@query(f"SELECT step, {_R.format(f'CASE WHEN step < warmup THEN (step + 1) / warmup ELSE {_FALL} END')} AS cosine, {_R.format(f'CASE WHEN step < warmup THEN (step + 1) / warmup WHEN step < total - total // 5 THEN 1.0 ELSE {_DROP} END')} AS wsd FROM (SELECT o_orderkey AS step, count(*) OVER () // 10 AS warmup, count(*) OVER () AS total FROM orders)")
def lr_schedule(spark, sf_dir):
    """The factor at every step of a run as long as the orders, a tenth of it warm-up."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"))
    total = s.count()
    return s.select("step", rounded(board.schedule(F.col("step"), total // 10, total)).alias("cosine"), rounded(board.schedule(F.col("step"), total // 10, total, "wsd")).alias("wsd"))


@query("SELECT o.config, o.crps < r.crps AS win FROM $own o JOIN $rival r ON r.config = o.config")
def wins(spark, sf_dir):
    return own(spark, sf_dir).join(rival(spark, sf_dir).select("config", F.col("crps").alias("r")), "config").select("config", (F.col("crps") < F.col("r")).alias("win"))
