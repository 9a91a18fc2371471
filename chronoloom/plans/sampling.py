"""Training windows: draws, bounds, roles, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import sample
from .base import arrays, hour_arrays, query, table

_R = "round({} * 1000000) / 1000000"


def _u(id_: str, purpose: str, seed: int = 0) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:{purpose}:' || CAST({id_} AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0)"


@query(f"SELECT n_regionkey, n_nationkey, {_R.format('pow(obs, 0.3) / sum(pow(obs, 0.3)) OVER (PARTITION BY n_regionkey)')} AS p FROM (SELECT n_regionkey, n_nationkey, CAST(count(*) AS DOUBLE) AS obs FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)")
def temperature_shares(spark, sf_dir):
    obs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("obs"))
    return sample.shares(obs, ["n_regionkey"], "obs").select("n_regionkey", "n_nationkey", rounded("p").alias("p"))


@query(f"WITH t AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS target, count(*) FILTER (WHERE o_orderstatus = 'P') / (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')::DOUBLE AS item FROM orders GROUP BY 1) SELECT o_orderpriority, {_R.format('greatest(target - 0.25 * item, 0) / sum(greatest(target - 0.25 * item, 0)) OVER ()')} AS p FROM t")
def rate_compensation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n, np_ = o.count(), o.where("o_orderstatus = 'P'").count()
    t = o.groupBy("o_orderpriority").agg((F.count("*") / n).alias("target"), (F.count_if(F.col("o_orderstatus") == "P") / np_).alias("item"))
    return sample.compensated(t, 0.25).select("o_orderpriority", rounded("p").alias("p"))


#: Subsets that stand for the labels of the embeddings: name, frequency.
_SUBSETS = [("nn5_daily", "D"), ("traffic_s1", "H"), ("traffic_s2", "H"), ("grid_2019", "15T"), ("synth_a", "H"), ("synth_b", "15T"), ("econ", "M"), ("grid_2020", "15T"), ("m5_stores", "W"), ("synth_c", "D")]
_PATCH, _HORIZON, _CONTEXT = 4, 8, 24


def _corpus(spark, sf_dir):
    """Series of 20 to 64 steps in these subsets (subset, series_id, n, values), and their manifest."""
    names = spark.createDataFrame([(i, *x) for i, x in enumerate(_SUBSETS)], "label long, name string, freq string")
    a = arrays(spark, sf_dir).withColumn("n", (20 + F.col("series") % 45).cast("int"))
    series = a.join(F.broadcast(names), F.col("subset") == F.col("label")).select(F.col("name").alias("subset"), "freq", F.col("series").cast("long").alias("series_id"), "n", F.slice("values", F.lit(1), F.col("n")).alias("values"))
    manifest = series.groupBy("subset", "freq").agg(F.sum("n").alias("n_obs"), F.max("n").alias("max_length"))
    return series.drop("freq"), manifest


#: The same in SQL: scale is 24 over the season, rw the weight of the rate class.
_CORPUS = """
names AS (SELECT * FROM (VALUES (0, 'nn5_daily', 'D', false, 'nn5_daily', 24.0::DOUBLE / 7, 3.9::DOUBLE), (1, 'traffic_s1', 'H', false, 'traffic', 1.0, 5.5), (2, 'traffic_s2', 'H', false, 'traffic', 1.0, 5.5),
  (3, 'grid_2019', '15T', false, 'grid', 0.25, 4.5), (4, 'synth_a', 'H', true, 'synth_a', 1.0, 5.5), (5, 'synth_b', '15T', true, 'synth_b', 0.25, 4.5), (6, 'econ', 'M', false, 'econ', 2.0, 2.2),
  (7, 'grid_2020', '15T', false, 'grid', 0.25, 4.5), (8, 'm5_stores', 'W', false, 'm5_stores', 24.0::DOUBLE / (365.0::DOUBLE / 7.0::DOUBLE), 2.8), (9, 'synth_c', 'D', true, 'synth_c', 24.0::DOUBLE / 7, 3.9)) t(label, subset, rate, synthetic, family, scale, rw)),
tser AS (SELECT n.subset, e.vec_id AS series_id, CAST(20 + e.vec_id % 45 AS INT) AS n, list_transform(e.embedding[1:CAST(20 + e.vec_id % 45 AS INT)], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings e JOIN names n ON n.label = e.label),
man AS (SELECT n.subset, rate, synthetic, family, scale, rw, sum(s.n) AS n_obs, max(s.n) AS max_length FROM tser s JOIN names n ON n.subset = s.subset GROUP BY ALL),
rp AS (SELECT rate, rw / sum(rw) OVER () AS rate_p FROM (SELECT rate, any_value(rw) AS rw FROM man GROUP BY 1)),
pools AS (SELECT rate, synthetic, CASE WHEN count(*) OVER (PARTITION BY rate) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS pool_p FROM (SELECT DISTINCT rate, synthetic FROM man)),
fams AS (SELECT rate, synthetic, family, pow(obs, 0.3) / sum(pow(obs, 0.3)) OVER (PARTITION BY rate, synthetic) AS family_p, 1.0::DOUBLE / cnt AS subset_p FROM (SELECT rate, synthetic, family, sum(n_obs)::DOUBLE AS obs, count(*) AS cnt FROM man GROUP BY 1, 2, 3)),
leaf AS (SELECT * FROM man JOIN rp USING (rate) JOIN pools USING (rate, synthetic) JOIN fams USING (rate, synthetic, family)),
lad0 AS (SELECT *, sum(p) OVER (ORDER BY spot ROWS UNBOUNDED PRECEDING) / sum(p) OVER () AS hi0 FROM (SELECT *, rate_p * pool_p * family_p * subset_p AS p, rate || '/' || CAST(synthetic AS VARCHAR) || '/' || family || '/' || subset AS spot FROM leaf WHERE max_length >= 8)),
lad AS (SELECT *, coalesce(lag(hi0) OVER (ORDER BY spot), 0.0) AS lo, CASE WHEN lead(hi0) OVER (ORDER BY spot) IS NULL THEN 1.0 ELSE hi0 END AS hi FROM lad0)"""


def _drawn_subsets(name: str, n: int, group: int, seed: int = 0) -> str:
    """CTE name: draw, rate, synthetic, family, subset, scale, k of n draws."""
    return f"""
{name}_u AS (SELECT draw, {_u('draw // ' + str(group), 'leaf', seed)} AS ul, {_u('draw // ' + str(group), 'decimate', seed)} AS ud, [2, 3, 4, 6, 8, 12][CAST(floor({_u('draw // ' + str(group), 'factor', seed)} * 6) + 1 AS INT)] AS kf FROM (SELECT unnest(range({n})) AS draw)),
{name} AS (SELECT draw, rate, synthetic, family, subset, scale, CASE WHEN ud < 0.5 AND max_length // kf >= 8 AND scale * kf <= 8 THEN kf ELSE 1 END AS k FROM {name}_u JOIN lad ON ul >= lo AND ul < hi)"""


def _drawn_windows(name: str, src: str, id_: str, purpose: str, horizon: str, seed: int = 0) -> str:
    """CTE name: src's rows (subset, k) with series_id, n, h, context and target."""
    u = lambda x: _u(id_, x, seed)
    return f"""
{name}_w AS (SELECT s.subset, k.k, s.series_id, s.n, s.n // k.k >= 8 AS ok FROM tser s JOIN (SELECT DISTINCT subset, k FROM {src}) k ON k.subset = s.subset),
{name}_t AS (SELECT subset, k, coalesce(sum(n) FILTER (WHERE ok), 0) AS good, sum(n) AS alln FROM {name}_w GROUP BY 1, 2),
{name}_c AS (SELECT w.subset, w.k, series_id, n, sum(n) OVER (PARTITION BY w.subset, w.k ORDER BY series_id ROWS UNBOUNDED PRECEDING) AS upto FROM {name}_w w JOIN {name}_t t ON t.subset = w.subset AND t.k = w.k WHERE ok OR good = 0),
{name}_a AS (SELECT s.*, floor({u(purpose)} * CASE WHEN good > 0 THEN good ELSE alln END) AS spot FROM {src} s JOIN {name}_t t ON t.subset = s.subset AND t.k = s.k),
{name}_s AS (SELECT a.*, c.series_id, c.n, c.n // a.k AS steps, {horizon} AS hz FROM {name}_a a JOIN {name}_c c ON c.subset = a.subset AND c.k = a.k AND a.spot >= c.upto - c.n AND a.spot < c.upto),
{name}_h AS (SELECT *, CASE WHEN steps < 2 * hz THEN least(hz, greatest(1, steps // 4)) ELSE hz END AS hh FROM {name}_s),
{name}_m AS (SELECT *, steps - hh AS most, least(steps - hh, 4)::DOUBLE AS lo0 FROM {name}_h),
{name}_x AS (SELECT *, least(CASE WHEN {u('full')} < 0.5 THEN 24 ELSE CAST(floor(exp(ln(lo0) + {u('context')} * (ln(greatest(24.0, lo0 + 1)) - ln(lo0)))) AS INT) END, most) AS ctx FROM {name}_m),
{name}_o AS (SELECT *, ctx + CAST(floor({u('origin')} * (most - ctx + 1)) AS INT) AS origin FROM {name}_x),
{name}_r AS (SELECT o.*, s.v[CAST(greatest(0, o.n - (steps - origin + ctx) * o.k) + 1 AS INT):CAST(o.n - (steps - origin - hh) * o.k AS INT)] AS raw FROM {name}_o o JOIN tser s ON s.subset = o.subset AND s.series_id = o.series_id),
{name}_y AS (SELECT *, list_transform(range(len(raw) // k), lambda j: list_avg(raw[CAST(len(raw) - (len(raw) // k - j) * k + 1 AS INT):CAST(len(raw) - (len(raw) // k - j - 1) * k AS INT)])) AS y FROM {name}_r),
{name} AS (SELECT *, CAST(hh AS INT) AS h, y[1:CAST(len(y) - hh AS INT)] AS context, y[CAST(len(y) - hh + 1 AS INT):CAST(len(y) AS INT)] AS target FROM {name}_y)"""


_LIST = "list_transform({}, lambda x: round(x * 1000000) / 1000000)"


def _list(c: str):
    return F.transform(c, lambda x: rounded(x)).alias(c)


def _base(spark, sf_dir, n: int, group: int = 4):
    series, manifest = _corpus(spark, sf_dir)
    return series, manifest, sample.draw_windows(manifest, n, patch=_PATCH, group=group)


def _windows(spark, sf_dir, n: int, group: int = 4):
    series, manifest, d = _base(spark, sf_dir, n, group)
    return series, manifest, sample.drawn_windows(d, series, _HORIZON, _CONTEXT, _PATCH)


@query(f"WITH {_CORPUS}, {_drawn_subsets('d', 4000, 4)}, {_drawn_windows('w', 'd', 'draw', 'series', '8')} SELECT draw, rate, synthetic, family, subset, series_id, CAST(k AS INT) AS k, round(scale * k * 1000000) / 1000000 AS w FROM w")
def window_draws(spark, sf_dir):
    """The hierarchical draw: rate class, pool, family, subset, decimation factor and series."""
    series, _, d = _base(spark, sf_dir, 4000)
    d = sample.draw_series(d, series, _PATCH)
    return d.select("draw", "rate", "synthetic", "family", "subset", "series_id", F.col("k").cast("int").alias("k"), rounded("w").alias("w"))


@query(f"""
WITH s AS (SELECT o_orderkey AS draw, CAST(100 + o_orderkey % 900 AS INT) AS n, CAST(o_orderkey % 3 + 1 AS INT) AS k FROM orders),
a AS (SELECT *, n // k AS steps FROM s), h AS (SELECT *, CASE WHEN steps < 96 THEN least(48, greatest(1, steps // 4)) ELSE 48 END AS h FROM a),
c AS (SELECT *, steps - h AS most, least(steps - h, 16)::DOUBLE AS lo0 FROM h),
d AS (SELECT *, least(CASE WHEN {_u('draw', 'full')} < 0.5 THEN 256 ELSE CAST(floor(exp(ln(lo0) + {_u('draw', 'context')} * (ln(greatest(256.0, lo0 + 1)) - ln(lo0)))) AS INT) END, most) AS ctx FROM c),
o AS (SELECT *, ctx + CAST(floor({_u('draw', 'origin')} * (most - ctx + 1)) AS INT) AS origin FROM d)
SELECT draw, CAST(h AS INT) AS h, CAST(ctx AS INT) AS ctx, CAST(origin AS INT) AS origin, CAST(greatest(0, n - (steps - origin + ctx) * k) AS INT) AS lo, CAST(n - (steps - origin - h) * k AS INT) AS hi FROM o""")
def window_bounds(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw"), (100 + F.col("o_orderkey") % 900).cast("int").alias("n"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("k"))
    return sample.bounds(s, 48, 256, 16).select("draw", "h", "ctx", "origin", "lo", "hi")


@query(f"WITH {_CORPUS}, {_drawn_subsets('d', 2000, 4)}, {_drawn_windows('w', 'd', 'draw', 'series', '8')} SELECT draw, h, {_LIST.format('context')} AS context, {_LIST.format('target')} AS target FROM w")
def window_extract(spark, sf_dir):
    """The windows of such draws, in block means."""
    return _windows(spark, sf_dir, 2000)[2].select("draw", "h", _list("context"), _list("target"))


@query(f"SELECT n_regionkey, n_nationkey, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY {_u(chr(40) + 'CAST(n_regionkey AS VARCHAR) || chr(47) || CAST(n_nationkey AS VARCHAR)' + chr(41), 'target')}, n_nationkey) = 1 OR {_u(chr(40) + 'CAST(n_regionkey AS VARCHAR) || chr(47) || CAST(n_nationkey AS VARCHAR)' + chr(41), 'role')} < 0.5 THEN 0 WHEN {_u(chr(40) + 'CAST(n_regionkey AS VARCHAR) || chr(47) || CAST(n_nationkey AS VARCHAR)' + chr(41), 'role')} < 0.75 THEN 1 ELSE 2 END AS role FROM nation")
def role_draw(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    return sample.roles(n, "n_regionkey", "n_nationkey")


@query("""
WITH c AS (SELECT series, list(value ORDER BY step) AS v FROM $vec GROUP BY 1),
p AS (SELECT a.series, a.step, a.value AS base, b.value AS c0, lag_.value AS c1 FROM vec a JOIN vec b ON b.series = a.series AND b.step = 63 - a.step JOIN vec lag_ ON lag_.series = a.series AND lag_.step = a.step),
s AS (SELECT series, avg(base) AS bm, stddev_pop(base) AS bs, avg(c0) AS m0, stddev_pop(c0) AS s0, avg(c1) AS m1, stddev_pop(c1) AS s1 FROM p WHERE step < 48 GROUP BY 1),
z AS (SELECT p.series, step, base, bs, (c0 - m0) / s0 AS z0, (c1 - m1) / s1 AS z1, first_value((c0 - m0) / s0) OVER (PARTITION BY p.series ORDER BY step) AS f0, lag((c0 - m0) / s0, 3) OVER (PARTITION BY p.series ORDER BY step) AS l0 FROM p JOIN s ON s.series = p.series)
SELECT series, step, round((base + bs * (0.8 * (exp(4 * coalesce(l0, f0)) - 1) / (exp(4 * coalesce(l0, f0)) + 1) + 0.5 * CASE WHEN z1 > 0 THEN 1.0 ELSE 0.0 END)) * 1000000) / 1000000 AS y FROM z""")
def covariate_target(spark, sf_dir):
    a = arrays(spark, sf_dir).select("series", F.col("values").alias("base"), F.array(F.reverse("values"), F.col("values")).alias("covariates"))
    out = sample.covariate_target(a, [1, 2], [3, 0], [0.8, 0.5], 48)
    # An outer explode: of an inner one the optimiser would derive a filter on y and work y out twice, below all the columns it is made from.
    return out.select("series", F.posexplode_outer("y").alias("step", "y")).select("series", F.col("step").cast("long").alias("step"), rounded("y").alias("y"))


@query("SELECT series, CAST(s AS INT) AS start, list(value ORDER BY step) FILTER (WHERE step < s + 24) AS context, list(value ORDER BY step) FILTER (WHERE step >= s + 24) AS target FROM $vec JOIN (SELECT unnest(range(0, 33, 10)) AS s) ON step >= s AND step < s + 32 GROUP BY 1, 2")
def stride_windows(spark, sf_dir):
    return sample.stride_windows(arrays(spark, sf_dir).select("series", "values"), 24, 8, 10)


@query("SELECT series, CAST(s AS INT) AS start, list(value ORDER BY step) FILTER (WHERE step < s + 24) AS context, list(value ORDER BY step) FILTER (WHERE step >= s + 24) AS target FROM $vec JOIN (SELECT unnest(range(0, 33, 10)) AS s) ON step >= s AND step < s + 32 GROUP BY 1, 2")
def windows_of(spark, sf_dir):
    """The same by the table function, in SQL."""
    sample.register_functions(spark)
    return spark.sql("SELECT series, w.* FROM {a} a, LATERAL windows_of(a.values, 24, 8, 10) w", a=arrays(spark, sf_dir).select("series", "values"))


@query("SELECT c_custkey, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'validation' ELSE 'test' END AS part FROM (SELECT c_custkey, percent_rank() OVER (ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS p FROM customer)")
def series_split(spark, sf_dir):
    return sample.split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("""
WITH RECURSIVE f AS (SELECT p_partkey, CAST(floor(p_size * 1.5::DOUBLE) AS BIGINT) AS most, floor(p_size * 1.5::DOUBLE) / 100.0::DOUBLE AS quota, p_partkey % 5 + 1 AS per FROM part),
r AS (SELECT p_partkey, most, quota, per, 0 AS b, 0.0::DOUBLE AS left_, 0::BIGINT AS drawn, 0::BIGINT AS take FROM f
UNION ALL SELECT p_partkey, most, quota, per, b + 1, left_ + quota - t, drawn + t, t FROM (SELECT *, CAST(greatest(least(per, floor(left_ + quota), most - drawn), 0) AS BIGINT) AS t FROM r WHERE b < 40))
SELECT p_partkey, CAST(sum(take) AS BIGINT) AS taken, list(take ORDER BY b) FILTER (WHERE b > 0) AS takes FROM r GROUP BY 1""")
def batch_replay(spark, sf_dir):
    f = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") % 5 + 1).alias("per_batch"))
    out = sample.replay(f, 40, 100, 1.5)
    return out.select("p_partkey", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"), "takes")


@query()
def batch_replay_capped(spark, sf_dir):
    """The capped replay, for the brands of each manufacturer's first letter as families."""
    f = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("family")).agg(F.sum("p_size").alias("size"), (F.count("*") % 4 + 2).alias("per_batch")).withColumn("corpus", F.lit("parts"))
    return sample.replay_batches(f, ["corpus"], 60, 100, 1.0, 40)


@query(f"""
WITH {_CORPUS}, {_drawn_subsets('g', 40, 1)},
d AS (SELECT b.draw, b.draw // 12 AS batch, b.draw % 12 AS b, g.rate, g.synthetic, g.subset, g.scale, g.k, CAST(floor(exp(ln(4) + {_u('b.draw // 12', 'horizon')} * (ln(16) - ln(4)))) AS INT) AS horizon FROM (SELECT unnest(range(120)) AS draw) b JOIN g ON g.draw = b.draw // 12 * 4 + b.draw % 12 // 3),
{_drawn_windows('w', 'd', 'draw', 'series', 'a.horizon')},
s AS (SELECT *, CASE WHEN {_u('draw', 'flip')} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM w)
SELECT CAST(batch AS INT) AS batch, CAST(b AS INT) AS b, subset, series_id, round(scale * k * 1000000) / 1000000 AS w, horizon, sign,
  list_transform(range(24), lambda i: CASE WHEN i >= 24 - len(context) THEN round(sign * context[CAST(i - (24 - len(context)) + 1 AS INT)] * 1000000) / 1000000 END) AS x,
  list_transform(range(horizon), lambda i: CASE WHEN i < len(target) THEN round(sign * target[CAST(i + 1 AS INT)] * 1000000) / 1000000 END) AS y FROM s""")
def batch_assembly(spark, sf_dir):
    """Batches of 12 windows in 4 groups: padded contexts and targets, flipped, with their scales."""
    series, manifest = _corpus(spark, sf_dir)
    out = sample.batches(manifest, series, 10, 12, 4, _CONTEXT, _PATCH, 16)
    return out.select("batch", "b", "subset", "series_id", rounded("w").alias("w"), "horizon", "sign", _list("x"), _list("y"))


@query(f"SELECT p_partkey, CAST(floor(exp(ln(32) + {_u('p_partkey', 'horizon')} * (ln(720) - ln(32)))) AS INT) AS h FROM part")
def horizon_draw(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sample.horizon_of_batch("p_partkey", 32, 720).alias("h"))


def _normal(id_: str, purpose: str) -> str:
    return f"(sqrt(-2.0 * ln(1 - {_u(id_, purpose + ':r')})) * cos(2 * pi() * {_u(id_, purpose + ':a')}))"


@query(f"""
WITH {_CORPUS}, {_drawn_subsets('d', 400, 4)}, {_drawn_windows('w', 'd', 'draw', 'series', '8')},
one AS (SELECT draw, subset, k, h AS hb, len(context) AS nc, j, CAST(draw AS VARCHAR) || '/' || CAST(j AS VARCHAR) AS id FROM w CROSS JOIN (SELECT unnest(range(1, 4)) AS j)),
real_ AS (SELECT * FROM one WHERE {_u('id', 'real')} < 0.6), {_drawn_windows('v', 'real_', 'id', 'covariate', 'a.hb')},
ax AS (SELECT one.*, unnest(range(nc + hb)) AS t FROM one),
pul AS (SELECT id, u, CASE WHEN {_u("id || ':' || CAST(u AS VARCHAR)", 'begin')} < 0.005 + 0.045 * {_u('id', 'rate')} THEN 1 + floor({_u("id || ':' || CAST(u AS VARCHAR)", 'last')} * 5) ELSE 0 END AS lasts FROM (SELECT id, t AS u FROM ax WHERE {_u('id', 'real')} >= 0.6)),
raw AS (
  SELECT ax.id, ax.t, CASE WHEN t < ax.nc THEN v.context[CAST(t - ax.nc + len(v.context) + 1 AS INT)] ELSE v.target[CAST(t - ax.nc + 1 AS INT)] END AS x FROM ax JOIN v ON v.id = ax.id WHERE (t < ax.nc AND t - ax.nc + len(v.context) >= 0) OR (t >= ax.nc AND t - ax.nc < len(v.target))
  UNION ALL SELECT ax.id, ax.t, max(CASE WHEN pul.lasts > ax.t - pul.u THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS x FROM ax JOIN pul ON pul.id = ax.id AND pul.u <= ax.t AND pul.u >= ax.t - 4 GROUP BY 1, 2),
st AS (SELECT raw.id, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1.0 END AS s FROM raw JOIN one ON one.id = raw.id WHERE t < nc GROUP BY 1),
z AS (SELECT ax.id, ax.t, raw.x, coalesce((raw.x - coalesce(m, 0)) / coalesce(s, 1), 0) AS z FROM ax LEFT JOIN raw ON raw.id = ax.id AND raw.t = ax.t LEFT JOIN st ON st.id = ax.id),
spec AS (SELECT *, CAST(floor({_u('id', 'kind')} * 4) AS INT) AS kind, CAST(floor({_u('id', 'lag')} * (least(hb, 24) + 1)) AS INT) AS lag_, (0.5 + 1.5 * {_u('draw', 'spread')}) * {_normal('id', 'weight')} AS a FROM one),
b0 AS (SELECT draw, unnest(range(len(context) + h)) AS t, unnest(list_concat(context, target)) AS b, len(context) AS nc FROM w),
bs AS (SELECT draw, avg(b) AS m, CASE WHEN stddev_pop(b) > 0 THEN stddev_pop(b) ELSE 1.0 END AS s FROM b0 WHERE t < nc GROUP BY 1),
e AS (SELECT spec.draw, ax.t, sum(a * CASE kind WHEN 0 THEN z.z WHEN 1 THEN (exp(4 * z.z) - 1) / (exp(4 * z.z) + 1) WHEN 2 THEN CASE WHEN z.z > 0 THEN 1.0 ELSE 0.0 END ELSE z.z * (b0.b - bs.m) / bs.s END) AS e
  FROM spec JOIN ax ON ax.id = spec.id JOIN z ON z.id = spec.id AND z.t = greatest(ax.t - lag_, 0) JOIN b0 ON b0.draw = spec.draw AND b0.t = ax.t JOIN bs ON bs.draw = spec.draw GROUP BY 1, 2)
SELECT draw, variate, step, CASE WHEN value = 0 THEN 0.0::DOUBLE ELSE value END AS value FROM (SELECT b0.draw, 0 AS variate, b0.t AS step, round((b + s * e) * 100000) / 100000 AS value FROM b0 JOIN bs ON bs.draw = b0.draw JOIN e ON e.draw = b0.draw AND e.t = b0.t
UNION ALL SELECT one.draw, CAST(one.j AS INT), z.t, round(x * 100000) / 100000 FROM z JOIN one ON one.id = z.id)""")
def covariate_items(spark, sf_dir):
    """Items of a target and three covariates that drive it, point by point."""
    series, _, w = _windows(spark, sf_dir, 400)
    out = sample.covariate_items(w, series, 4, _CONTEXT, _PATCH)
    rows = out.select("draw", F.posexplode_outer("values").alias("variate", "v"))
    return rows.select("draw", "variate", F.posexplode_outer("v").alias("step", "value")).select("draw", "variate", F.col("step").cast("long").alias("step"), F.when(rounded("value", 5) == 0, 0.0).otherwise(rounded("value", 5)).alias("value"))


@query(f"""
WITH {_CORPUS}, {_drawn_subsets('d', 1200, 4)}, {_drawn_windows('w', 'd', 'draw', 'series', '8')},
pl0 AS (SELECT *, sum(p) OVER (PARTITION BY rate, synthetic ORDER BY spot ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY rate, synthetic) AS hi0 FROM (SELECT *, family_p * subset_p AS p, family || '/' || subset AS spot FROM leaf)),
pl AS (SELECT rate, synthetic, subset, scale, max_length, coalesce(lag(hi0) OVER (PARTITION BY rate, synthetic ORDER BY spot), 0.0) AS lo, CASE WHEN lead(hi0) OVER (PARTITION BY rate, synthetic ORDER BY spot) IS NULL THEN 1.0 ELSE hi0 END AS hi FROM pl0),
asked AS (SELECT draw, j, rate, synthetic, scale, k, CAST(draw AS VARCHAR) || '/' || CAST(j AS VARCHAR) AS id FROM w CROSS JOIN (SELECT unnest([1, 2]) AS j) WHERE {_u('draw', 'mix')} < 0.7 AND j <= 1 + floor({_u('draw', 'partners')} * 2)),
found AS (SELECT a.draw, a.j, a.id, a.k, pl.subset FROM asked a JOIN pl ON pl.rate = a.rate AND pl.synthetic = a.synthetic AND {_u('a.id', 'partner')} >= pl.lo AND {_u('a.id', 'partner')} < pl.hi WHERE pl.scale = a.scale AND pl.max_length // a.k >= 8),
{_drawn_windows('v', 'found', 'id', 'partner series', '8')},
parts AS (SELECT draw, 0 AS j, CAST(draw AS VARCHAR) AS id, context, target FROM w UNION ALL SELECT draw, j, id, context, target FROM v),
g AS (SELECT *, -ln(1 - {_u('id', 'exponential')}) + 0.5 * pow({_normal('id', 'square')}, 2) AS a, min(len(context)) OVER q AS nc, min(len(target)) OVER q AS nt, count(*) OVER q AS n FROM parts WINDOW q AS (PARTITION BY draw)),
sc AS (SELECT *, a / sum(a) OVER (PARTITION BY draw) AS share, list_avg(list_transform(context[CAST(len(context) - nc + 1 AS INT):CAST(len(context) AS INT)], lambda x: abs(x))) AS size FROM g),
mixed AS (SELECT draw, n, nc, nt, i, sum(CASE WHEN n = 1 THEN 1.0 ELSE share / CASE WHEN size > 0 THEN size ELSE 1 END END * CASE WHEN i < nc THEN context[CAST(len(context) - nc + i + 1 AS INT)] ELSE target[CAST(i - nc + 1 AS INT)] END) AS y FROM (SELECT *, unnest(range(nc + nt)) AS i FROM sc) GROUP BY ALL)
SELECT draw, CAST(n AS INT) AS parts, list(round(y * 1000000) / 1000000 ORDER BY i) FILTER (WHERE i < nc) AS context, list(round(y * 1000000) / 1000000 ORDER BY i) FILTER (WHERE i >= nc) AS target FROM mixed GROUP BY draw, n, nc, nt""")
def window_mix(spark, sf_dir):
    """Windows of which 70 % are mixed with one or two of their rate, pool and scale."""
    series, manifest, w = _windows(spark, sf_dir, 1200)
    return sample.mix_windows(w, manifest, series, _HORIZON, _CONTEXT, _PATCH, 0.7).select("draw", "parts", _list("context"), _list("target"))


@query(f"""
WITH m AS (SELECT vec_id // 3 AS item_id, CAST(vec_id % 3 AS INT) AS member_pos, vec_id % 5 * 2 AS shift, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sp AS (SELECT item_id, max(shift) AS st, CAST(min(shift) + 64 - max(shift) AS INT) AS n, 1.0::DOUBLE + item_id % 5 AS scale FROM m GROUP BY 1),
k AS (SELECT *, CASE WHEN n // 2 >= 16 AND scale * 2 <= 8 THEN 2 ELSE 1 END AS k FROM sp), q AS (SELECT *, n // k AS steps FROM k),
h AS (SELECT *, CASE WHEN steps < 16 THEN least(8, greatest(1, steps // 4)) ELSE 8 END AS h FROM q), c0 AS (SELECT *, steps - h AS most, least(steps - h, 8)::DOUBLE AS lo0 FROM h),
c1 AS (SELECT *, least(CASE WHEN {_u('item_id', 'full')} < 0.5 THEN 32 ELSE CAST(floor(exp(ln(lo0) + {_u('item_id', 'context')} * (ln(greatest(32.0, lo0 + 1)) - ln(lo0)))) AS INT) END, most) AS ctx FROM c0),
c2 AS (SELECT *, ctx + CAST(floor({_u('item_id', 'origin')} * (most - ctx + 1)) AS INT) AS origin FROM c1),
c3 AS (SELECT *, greatest(0, n - (steps - origin + ctx) * k) AS lo, n - (steps - origin - h) * k AS hi FROM c2),
raw AS (SELECT c3.item_id, member_pos, k, h, scale, v[CAST(st + lo - shift + 1 AS INT):CAST(st + hi - shift AS INT)] AS r FROM c3 JOIN m ON m.item_id = c3.item_id),
y AS (SELECT *, list_transform(range(len(r) // k), lambda j: list_avg(r[CAST(len(r) - (len(r) // k - j) * k + 1 AS INT):CAST(len(r) - (len(r) // k - j - 1) * k AS INT)])) AS y FROM raw),
slots AS (SELECT DISTINCT item_id, s.slot, k, h, scale, len(y) AS len_ FROM y CROSS JOIN (SELECT CAST(unnest(range(4)) AS INT) AS slot) s),
nth AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY member_pos) - 1 AS slot FROM y),
j AS (SELECT slots.item_id, slots.slot, member_pos, slots.k, slots.h, slots.scale, coalesce(y, list_transform(range(len_), lambda i: CAST(NULL AS DOUBLE))) AS y FROM slots LEFT JOIN nth ON nth.item_id = slots.item_id AND nth.slot = slots.slot)
SELECT item_id, slot, member_pos, member_pos IS NOT NULL AS valid, k, scale * k AS w, h, {_LIST.format('y[1:CAST(len(y) - h AS INT)]')} AS context, {_LIST.format('y[CAST(len(y) - h + 1 AS INT):CAST(len(y) AS INT)]')} AS target FROM j""")
def item_windows(spark, sf_dir):
    """Windows of three neighbouring series on their common axis, in four slots."""
    from ..operators import items

    a = arrays(spark, sf_dir).withColumn("subset", F.col("subset").cast("string"))
    members = a.select(F.floor(F.col("series") / 3).cast("long").alias("item_id"), (F.col("series") % 3).cast("int").alias("member_pos"), "subset", F.col("series").alias("series_id"), (F.col("series") % 5 * 2).alias("shift"))
    points = a.select("subset", F.col("series").alias("series_id"), F.posexplode("values").alias("step", "value")).withColumn("step", F.col("step").cast("long"))
    lengths = a.select("subset", F.col("series").alias("series_id"), F.size("values").cast("long").alias("length"))
    scales = members.select("item_id").distinct().withColumn("scale", 1.0 + F.col("item_id") % 5)
    w = items.item_windows(members, points, lengths, 2, 8, 32, 8, 4, scales=scales)
    return w.select("item_id", "slot", "member_pos", "valid", "k", "w", "h", _list("context"), _list("target"))
