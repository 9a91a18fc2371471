"""The recipes of the public sources, over raw tables that the test tables stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..sources import recipes as rp
from .base import arrays, query, table

_R = "round({} * 1000000) / 1000000"
_HOUR = "date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts))"
_MIN = "date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts))"


def _events(spark, sf_dir):
    """events with their whole hours, minutes and seconds since the first day."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds.cast("long").alias("sec"))
    return e.withColumn("minute", F.floor(F.col("sec") / 60).cast("long")).withColumn("hour", F.floor(F.col("sec") / 3600).cast("long"))


def _on_grid(once: str, keys: str, zero: bool = False, every: int = 1, value: str = "value") -> str:
    """SQL: rows of once (keys, step, value; a step once) on a grid without gaps."""
    lo = "0" if zero else "min(step)"
    on = " AND ".join(f"g.{k.strip()} = o.{k.strip()}" for k in keys.split(","))
    return f"WITH o AS ({once}), s AS (SELECT {keys}, {lo} AS lo, max(step) AS hi FROM o GROUP BY {keys}), g AS (SELECT {keys}, unnest(range(lo, hi + 1, {every})) AS step FROM s) SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, g.step, {value} FROM g LEFT JOIN o ON {on} AND g.step = o.step"


def _six(df):
    return df.withColumn("value", rounded("value"))


@query("""
WITH d AS (SELECT c_custkey, c_nationkey % 3 + 1 AS day FROM customer WHERE CAST('0x' || substr(md5(c_name), 1, 2) AS INT) % 18 = 0),
g AS (SELECT c_custkey, unnest(range(2 * 1440)) AS step FROM d WHERE day <= 2)
SELECT g.c_custkey, g.step, CASE WHEN g.step // 1440 + 1 = d.day THEN (g.c_custkey + g.step % 1440 + 1) % 7 END::DOUBLE AS value FROM g JOIN d ON d.c_custkey = g.c_custkey""")
def recipe_minute_counts(spark, sf_dir):
    """Rows of a function and day with a column a minute, of a stable sample; days after the second don't count, a missing day stays missing."""
    k = F.col("c_custkey")
    wide = table(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("hash"), (F.col("c_nationkey") % 3 + 1).alias("day"), *(((k + m) % 7).alias(str(m)) for m in range(1, 1441)))
    return rp.minute_counts_by_day(wide, ["c_custkey"], "day", 2, "hash").select("c_custkey", "step", "value")


@query("""
WITH p AS (SELECT p_brand, p_partkey AS step, x.series, CASE x.series WHEN 'p_size' THEN p_size WHEN 'p_retailprice' THEN p_retailprice ELSE p_partkey % 4 END::DOUBLE AS value FROM part CROSS JOIN (SELECT unnest(['p_size', 'p_retailprice', 'few']) AS series) x),
v AS (SELECT p_brand, series FROM p GROUP BY 1, 2 HAVING count(DISTINCT value) > 4),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('0:' || series), series) AS n FROM v)
SELECT p.p_brand, p.series, p.step, p.value FROM p JOIN c ON c.p_brand = p.p_brand AND c.series = p.series WHERE n <= 1""")
def recipe_varied_columns(spark, sf_dir):
    d = table(spark, sf_dir, "part").withColumn("few", F.col("p_partkey") % 4)
    return rp.varied_columns(d, "p_brand", "p_partkey", ["p_size", "p_retailprice", "few"], 4, 1).select("p_brand", "series", "step", "value")


@query("""
WITH n AS (SELECT p_brand, max(p_partkey) + 1 AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
r AS (SELECT p_brand, p_partkey AS step, p_size FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT part.p_brand, p_partkey + coalesce(n, 0), p_size FROM part LEFT JOIN n ON n.p_brand = part.p_brand WHERE p_partkey % 2 = 1)
SELECT p_brand, 'p_size' AS series, step, p_size::DOUBLE AS value FROM r""")
def recipe_train_then_test(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return rp.train_then_test(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_brand", "p_partkey", ["p_size"])


@query(f"SELECT 'rig' AS series, vec_id * 8 + b.b AS step, {_R.format('list_avg(list_transform(embedding[CAST(b.b * 8 + 1 AS INT):CAST(b.b * 8 + 8 AS INT)], lambda x: CAST(x AS DOUBLE)))')} AS value FROM embeddings CROSS JOIN (SELECT unnest(range(8)) AS b) b")
def recipe_cycles(spark, sf_dir):
    return _six(rp.cycles(arrays(spark, sf_dir), "series", "values", 8))


@query("SELECT x.series, s_suppkey AS step, CASE x.series WHEN 's_acctbal' THEN s_acctbal ELSE s_nationkey END::DOUBLE AS value FROM supplier CROSS JOIN (SELECT unnest(['s_acctbal', 's_nationkey']) AS series) x")
def recipe_columns(spark, sf_dir):
    return rp.columns_to_series(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"])


@query(_on_grid("SELECT o_orderpriority, o_orderstatus, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS step, max(o_totalprice) AS value FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2, 3", "o_orderpriority, o_orderstatus"))
def recipe_dimensions(spark, sf_dir):
    """Official statistics: allowed values (of a column that isn't there: ignored), a series per combination of dimensions on a monthly grid."""
    return rp.by_dimensions(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderdate", "o_totalprice", "M", {"o_orderstatus": ["O", "F"], "nothing": ["x"]})


@query(_on_grid("SELECT o_orderstatus, CAST(year(o_orderdate) * 53 + o_orderkey % 52 AS BIGINT) AS step, max(o_totalprice) AS value FROM orders GROUP BY 1, 2", "o_orderstatus"))
def recipe_year_week(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 52).alias("week"), "o_totalprice")
    return rp.year_week(o, ["o_orderstatus"], "year", "week", "o_totalprice")


@query("""
WITH l AS (SELECT s_nationkey, s_name, y.y AS step, CASE WHEN (s_suppkey + y.y) % 5 = 0 AND s_suppkey % 2 = 0 THEN NULL ELSE s_acctbal + y.y END AS value FROM supplier CROSS JOIN (SELECT unnest(range(6)) AS y) y WHERE s_name NOT LIKE '%3'),
k AS (SELECT s_nationkey, s_name FROM l GROUP BY 1, 2 HAVING count(value) >= 6),
c AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || s_nationkey || '/' || s_name), s_nationkey || '/' || s_name) AS n FROM k)
SELECT l.* FROM l JOIN c ON c.s_nationkey = l.s_nationkey AND c.s_name = l.s_name WHERE n <= 40""")
def recipe_indicators(spark, sf_dir):
    """Indicators without some prefix, year columns to steps, enough values, a seeded sample of series."""
    s, years = table(spark, sf_dir, "supplier"), [f"y{i}" for i in range(6)]
    wide = s.select("s_nationkey", "s_name", F.reverse("s_name").alias("mirrored"), *(F.when(((F.col("s_suppkey") + i) % 5 != 0) | (F.col("s_suppkey") % 2 != 0), F.col("s_acctbal") + i).alias(y) for i, y in enumerate(years)))
    out = rp.indicators(wide, ["s_nationkey", "s_name"], "mirrored", years, ("3",), 6)
    chosen = rp.indicators(wide.where(~F.col("mirrored").startswith("3")).drop("mirrored"), ["s_nationkey"], "s_name", years, (), 6, 40)
    return chosen.join(out.select("s_name").distinct(), "s_name", "left_semi").select("s_nationkey", "s_name", "step", "value")


@query(f"""
WITH e AS (SELECT user_id, {_MIN} // 15 AS step, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events WHERE user_id NOT IN (SELECT n_nationkey FROM nation)),
c AS (SELECT user_id, row_number() OVER (ORDER BY md5('0:' || CAST(user_id AS VARCHAR)), user_id) AS n FROM (SELECT DISTINCT user_id FROM e)),
o AS (SELECT e.user_id, step, avg(value) AS value FROM e JOIN c ON c.user_id = e.user_id AND n <= 20 GROUP BY 1, 2),
s AS (SELECT user_id, min(step) AS lo, max(step) AS hi FROM o GROUP BY 1), g AS (SELECT user_id, unnest(range(lo, hi + 1)) AS step FROM s)
SELECT g.user_id, g.step, {_R.format('value')} AS value FROM g LEFT JOIN o ON o.user_id = g.user_id AND o.step = g.step""")
def recipe_gauges(spark, sf_dir):
    """Stations that aren't taken yet, a seeded sample of them, a sentinel out, means of 15 minutes."""
    e = _events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 9 == 0, -9999.0).otherwise(F.col("value")))
    taken = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"))
    return _six(rp.gauges(e, "user_id", "sec", "value", 900, 20, taken, (-9999.0,)))


@query(_on_grid(f"SELECT CAST(user_id AS VARCHAR) || event_type AS series, {_HOUR} AS step, min(value) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2", "series"))
def recipe_monitors(spark, sf_dir):
    return rp.monitors(_events(spark, sf_dir), ["user_id", "event_type"], "hour", "value", "error")


@query(_on_grid(f"SELECT user_id, x.series, {_MIN} // 10 AS step, min(CASE x.series WHEN 'value' THEN value ELSE event_id % 100 END)::DOUBLE AS value FROM events CROSS JOIN (SELECT unnest(['value', 'rest']) AS series) x GROUP BY 1, 2, 3", "user_id, series"))
def recipe_turbines(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("rest", F.col("event_id") % 100)
    return rp.turbines(e, "user_id", "minute", ["value", "rest"])


@query("""
WITH e AS (SELECT o_custkey % 40 AS k, (o_orderkey // 40) * (CASE o_custkey % 4 WHEN 0 THEN 60 WHEN 1 THEN 300 WHEN 2 THEN 420 ELSE 900 END) AS seconds, o_totalprice AS value FROM orders),
u AS (SELECT k, seconds, max(value) AS value FROM e GROUP BY 1, 2),
d AS (SELECT k, CAST(round_even(median(g) / 60, 0) AS BIGINT) AS minutes FROM (SELECT k, seconds - lag(seconds) OVER (PARTITION BY k ORDER BY seconds) AS g FROM u) WHERE g IS NOT NULL GROUP BY 1),
o AS (SELECT u.k, minutes, seconds // (60 * minutes) AS step, max(value) AS value FROM u JOIN d ON d.k = u.k WHERE minutes IN (1, 5, 15) GROUP BY 1, 2, 3),
s AS (SELECT k, minutes, min(step) AS lo, max(step) AS hi FROM o GROUP BY 1, 2), g AS (SELECT k, minutes, unnest(range(lo, hi + 1)) AS step FROM s)
SELECT g.k, g.minutes, g.step, value FROM g LEFT JOIN o ON o.k = g.k AND o.step = g.step""")
def recipe_inferred_step(spark, sf_dir):
    """Systems by their median step; those of another than 1, 5 or 15 minutes go."""
    k, o = F.col("o_custkey") % 40, table(spark, sf_dir, "orders")
    every = F.when(F.col("o_custkey") % 4 == 0, 60).when(F.col("o_custkey") % 4 == 1, 300).when(F.col("o_custkey") % 4 == 2, 420).otherwise(900)
    e = o.groupBy(k.alias("k"), (F.floor(F.col("o_orderkey") / 40) * every).alias("seconds")).agg(F.max("o_totalprice").alias("value"))
    return rp.inferred_step(e, ["k"], "seconds", "value")


@query("""
WITH t AS (SELECT c_mktsegment AS series, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'M' ELSE 'D' END AS freq, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders JOIN customer ON c_custkey = o_custkey),
o AS (SELECT series, freq, CAST(CASE freq WHEN 'A' THEN year(d) WHEN 'M' THEN year(d) * 12 + month(d) ELSE date_diff('day', DATE '1970-01-01', d) + 719163 END AS BIGINT) AS step, max(value) AS value FROM t GROUP BY 1, 2, 3),
s AS (SELECT series, freq, min(step) AS lo, max(step) AS hi FROM o GROUP BY 1, 2), g AS (SELECT series, freq, unnest(range(lo, hi + 1)) AS step FROM s)
SELECT g.series, g.freq, g.step, value FROM g LEFT JOIN o ON o.series = g.series AND o.freq = g.freq AND o.step = g.step""")
def recipe_observations(spark, sf_dir):
    """Energy series: yearly, monthly and daily dates as text, on the grid of their frequency."""
    k = F.col("o_orderkey") % 3
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    date = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    rows = o.select(F.col("c_mktsegment").alias("series"), F.when(k == 0, "A").when(k == 1, "M").otherwise("D").alias("freq"), date.alias("date"), F.when(F.col("o_orderkey") % 7 == 0, "w").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    return rp.observations(rows, "series", "freq", "date", "value")


@query("""
WITH t AS (SELECT o_custkey % 12 AS k, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 7 AS step, CASE WHEN o_orderkey % (2 + o_custkey % 4) = 0 THEN NULL ELSE o_totalprice END AS value FROM orders),
o AS (SELECT k, step, max(value) AS value FROM t WHERE k IN (SELECT k FROM t GROUP BY 1 HAVING avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) > 0.6) GROUP BY 1, 2),
s AS (SELECT k, min(step) AS lo, max(step) AS hi FROM o GROUP BY 1), g AS (SELECT k, unnest(range(lo, hi + 1)) AS step FROM s)
SELECT g.k, g.step, value FROM g LEFT JOIN o ON o.k = g.k AND o.step = g.step""")
def recipe_mostly_numeric(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_custkey") % 12).alias("k"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("days"), F.when(F.col("o_orderkey") % (2 + F.col("o_custkey") % 4) == 0, "suppressed").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    return rp.mostly_numeric(rows, ["k"], "days", "value", 0.6)


@query("""
WITH t AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS day, count(*)::DOUBLE AS views FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
b AS (SELECT user_id, day // 7 AS step, CASE WHEN count(views) >= 7 THEN sum(views) END AS value FROM t GROUP BY 1, 2),
s AS (SELECT user_id, min(step) AS lo, max(step) AS hi FROM b GROUP BY 1), g AS (SELECT user_id, unnest(range(lo + 1, hi)) AS step FROM s)
SELECT CAST(g.user_id AS VARCHAR) AS title, g.step, value FROM g LEFT JOIN b ON b.user_id = g.user_id AND b.step = g.step""")
def recipe_page_views(spark, sf_dir):
    """Weekly sums of seven observed days without the first and the last week; titles with a namespace and repeated days are passed over."""
    e = _events(spark, sf_dir).where("event_type <> 'error'").withColumn("day", F.floor(F.col("hour") / 24).cast("long"))
    views = e.groupBy(F.col("user_id").cast("string").alias("title"), "day").agg(F.count("*").alias("views"))
    twice = views.unionByName(views).unionByName(views.select(F.concat(F.lit("Talk:"), "title").alias("title"), "day", "views"))
    return rp.page_views(twice, "title", "day", "views")


@query("""
WITH d AS (SELECT o_custkey % 10 AS site, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, min(o_totalprice) AS p FROM orders GROUP BY 1, 2),
o AS (SELECT site, day * 4 + i.i AS step, p + i.i AS value FROM d CROSS JOIN (SELECT unnest(range(4)) AS i) i),
s AS (SELECT site, min(step) AS lo, max(step) AS hi FROM o GROUP BY 1), g AS (SELECT site, unnest(range(lo, hi + 1)) AS step FROM s)
SELECT g.site, g.step, value FROM g LEFT JOIN o ON o.site = g.site AND o.step = g.step""")
def recipe_hours_of_days(spark, sf_dir):
    """Rows of a day with a column an interval; of repeated days the first."""
    o = table(spark, sf_dir, "orders")
    wide = o.select((F.col("o_custkey") % 10).alias("site"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("day"), *((F.col("o_totalprice") + i).alias(f"i{i}") for i in range(4)))
    return rp.hours_of_days(wide, ["site"], "day", [f"i{i}" for i in range(4)])


@query(_on_grid(f"SELECT user_id, x.series, {_HOUR} AS step, max(CASE x.series WHEN 'value' THEN value ELSE event_id % 100 END)::DOUBLE AS value FROM events CROSS JOIN (SELECT unnest(['value', 'rest']) AS series) x GROUP BY 1, 2, 3", "user_id, series", True))
def recipe_by_ordinal(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("rest", F.col("event_id") % 100)
    return rp.by_ordinal(e, "user_id", "hour", ["value", "rest"])


@query(_on_grid(f"SELECT event_type, {_MIN} // 30 AS step, avg(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END) AS value FROM events GROUP BY 1, 2", "event_type", value=_R.format("value") + " AS value"))
def recipe_good_means(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("flag", (F.col("event_id") % 4 == 0).cast("int"))
    return _six(rp.good_means(e, ["event_type"], "sec", "value", "flag", 1800))


@query(f"""
WITH t AS (SELECT user_id, epoch_us(ts) AS us, value FROM events WHERE event_id % 3 <> 0),
o AS (SELECT user_id, (us - min(us) OVER (PARTITION BY user_id)) // 3600000000 AS step, value FROM t), m AS (SELECT user_id, step, max(value) AS value FROM o GROUP BY 1, 2),
s AS (SELECT user_id, max(step) AS hi FROM m GROUP BY 1), g AS (SELECT user_id, unnest(range(0, hi + 1)) AS step FROM s)
SELECT g.user_id, g.step, value FROM g LEFT JOIN m ON m.user_id = g.user_id AND m.step = g.step""")
def recipe_power(spark, sf_dir):
    """Rows that aren't flagged, in steps from each series' first time."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select("user_id", micros.alias("us"), "value", (F.col("event_id") % 3 == 0).alias("bad"))
    return rp.power_traces(e, ["user_id"], "us", "value", "bad", 3_600_000_000)


@query(f"""
WITH c AS (SELECT event_type, {_HOUR} AS step, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT event_type, max(step) AS hi FROM c GROUP BY 1 HAVING sum(n) >= 100),
g AS (SELECT event_type, unnest(range(hi + 1)) AS step FROM b) SELECT g.event_type, g.step, coalesce(n, 0)::DOUBLE AS value FROM g LEFT JOIN c ON c.event_type = g.event_type AND c.step = g.step""")
def recipe_invocations(spark, sf_dir):
    return rp.invocations(_events(spark, sf_dir), ["event_type"], "hour", 100)


@query(f"""
WITH p AS (SELECT label AS machine, vec_id % 2 AS operation, vec_id AS run, s.s // 16 AS block, embedding[CAST(s.s + 1 AS INT)]::DOUBLE AS v FROM embeddings CROSS JOIN (SELECT unnest(range(60)) AS s) s),
b AS (SELECT machine, operation, run, block, sqrt(avg(v * v)) AS value FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) = 16)
SELECT machine, operation, row_number() OVER (PARTITION BY machine, operation ORDER BY run, block) - 1 AS step, {_R.format('value')} AS value FROM b""")
def recipe_vibration(spark, sf_dir):
    """Root mean squares of blocks of 16 samples (a shorter tail goes), runs of a machine and operation end to end."""
    a = arrays(spark, sf_dir).select(F.col("subset").alias("machine"), (F.col("series") % 2).alias("operation"), F.col("series").alias("run"), F.posexplode(F.slice("values", 1, 60)).alias("sample", "value"))
    return _six(rp.vibration(a, "machine", "operation", "run", "sample", "value", 16))


@query(_on_grid(f"SELECT user_id, x.series, {_HOUR} AS step, avg(CASE x.series WHEN 'value' THEN value / 10 ELSE event_id % 100 END) AS value FROM events CROSS JOIN (SELECT unnest(['value', 'rest']) AS series) x GROUP BY 1, 2, 3", "user_id, series", value=_R.format("value") + " AS value"))
def recipe_scaled_hours(spark, sf_dir):
    """Hourly means of scaled columns per station."""
    e = table(spark, sf_dir, "events").select("user_id", "value", (F.col("event_id") % 100).alias("rest"), F.expr("TIMESTAMP '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts))").alias("t"))
    return _six(rp.scaled_hours(e, "user_id", "t", {"value": 10.0, "rest": 1.0}))
