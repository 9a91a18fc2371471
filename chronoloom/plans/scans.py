"""Scans of source formats. Files and lines are made from the test tables in the format, then read by the source's own reader."""

from __future__ import annotations

import io
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import frequency as fr
from ..functions.scalars import rounded
from ..operators import items as it
from ..sources import binary, corpus, ranges, text
from .base import arrays, place, query, table


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def scan_csv(spark, sf_dir):
    """Compressed delimited text, written and read again; ? stands for missing."""
    path = place(spark, "csv")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 == 0, "?").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    c.write.option("header", True).option("sep", ";").option("compression", "gzip").csv(path)
    return text.csv(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE", ";")


def _packed(part: pa.Table):
    """An archive of a table's members, in order of customers."""
    part, out = part.sort_by([("member", "ascending"), ("c_custkey", "ascending")]), io.BytesIO()
    name, texts = part.column("file")[0].as_py(), {}
    for member, line in zip(part.column("member").to_pylist(), part.column("line").to_pylist()):
        texts.setdefault(member, []).append(line)
    texts = {m: ("\n".join(lines) + "\n").encode() for m, lines in texts.items()}
    if name.endswith(".zip"):
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for m, t in texts.items():
                z.writestr(m, t)
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as z:
            for m, t in texts.items():
                info = tarfile.TarInfo(m)
                info.size = len(t)
                z.addfile(info, io.BytesIO(t))
    yield name, out.getvalue()


def _below(c: str, levels: int = 1):
    """The last levels of a path."""
    return F.substring_index(c, "/", -levels).alias("file")


_ARCHIVES = """
SELECT 'region' || CAST(n_regionkey AS VARCHAR) || '-' || CAST(c_custkey // 1000 AS VARCHAR) || CASE WHEN n_regionkey % 2 = 0 THEN '.zip' ELSE '.tar.gz' END AS file, n_name || '.txt' AS member,
  CAST(row_number() OVER (PARTITION BY n_nationkey, c_custkey // 1000 ORDER BY c_custkey) - 1 AS BIGINT) AS line_no, c_name || ',' || c_mktsegment AS line
FROM customer JOIN nation ON n_nationkey = c_nationkey"""


@query(_ARCHIVES)
def scan_archives(spark, sf_dir):
    """Members of zip and tar.gz archives on disk, unpacked as streams, line by line."""
    path = place(spark, "archives")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("n_regionkey") % 2 == 0, ".zip").otherwise(".tar.gz")
    file = F.concat(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("-"), F.floor(F.col("c_custkey") / 1000).cast("string"), kind)
    ranges.write_files(c.select(file.alias("file"), F.concat("n_name", F.lit(".txt")).alias("member"), "c_custkey", F.concat_ws(",", "c_name", "c_mktsegment").alias("line")), path, ["file"], _packed)
    return binary.archived_lines(spark, path).select(_below("path"), "member", "line_no", "line")


@query("SELECT 'T' || CAST(s_suppkey AS VARCHAR) AS turbine, s_acctbal AS power FROM supplier")
def scan_preamble(spark, sf_dir):
    """CSV below a preamble whose length differs by file."""
    s = table(spark, sf_dir, "supplier").withColumn("path", F.concat(F.lit("f"), (F.col("s_suppkey") % 3).cast("string")))
    body = s.select("path", (F.col("s_suppkey") + 100).alias("line_no"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string"), F.lit(","), F.col("s_acctbal").cast("string")).alias("value"))
    heads = spark.createDataFrame([(f"f{i}", n, v) for i in range(3) for n, v in [*((j, "about, 1") for j in range(i)), (50, "# Date and time,Power"), (51, "# a comment")]], "path string, line_no long, value string")
    return text.preamble_rows(body.unionByName(heads), "# Date and time", "turbine STRING, power DOUBLE")


@query("SELECT c_name AS series, 'M' AS freq, strftime(CAST(o_orderdate AS DATE), '%Y%m') AS date, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders JOIN customer ON c_custkey = o_custkey")
def scan_ndjson(spark, sf_dir):
    """One JSON object a line; values are text, some of which isn't a number."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pair = F.array(F.date_format("o_orderdate", "yyyyMM"), F.when(F.col("o_orderkey") % 5 == 0, "w").otherwise(F.col("o_totalprice").cast("string")))
    lines = o.groupBy("c_name").agg(F.collect_list(pair).alias("data")).select(F.to_json(F.struct(F.col("c_name").alias("series_id"), F.lit("M").alias("f"), "data")).alias("value"))
    return text.ndjson_rows(lines)


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS station, CAST(o_orderdate AS TIMESTAMP) + INTERVAL (o_orderkey % 24) HOUR AS ts, (o_orderkey % 400 - 100) / 10.0::DOUBLE AS temperature, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 90) / 10.0::DOUBLE END AS dew,
  (10000 + o_orderkey % 300) / 10.0::DOUBLE AS pressure, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 360)::DOUBLE END AS wind_dir, (o_orderkey % 200) / 10.0::DOUBLE AS wind FROM orders""")
def scan_isd(spark, sf_dir):
    """Weather stations' whitespace text, a file a station."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    number = lambda c: c.cast("string")
    fields = [F.date_format(d, "yyyy MM dd"), F.lpad(number(k % 24), 2, "0"), F.lpad(number(k % 400 - 100), 6, " "), F.when(k % 5 == 0, "-9999").otherwise(F.lpad(number(k % 90), 5, " ")), number(10000 + k % 300), F.when(k % 3 == 0, "-9999").otherwise(number(k % 360)), number(k % 200), F.lit("2 -9999 -9999")]
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("isd/"), number(F.col("o_custkey"))).alias("path"), F.concat_ws(" ", *fields).alias("value"))
    return text.isd_rows(lines)


@query("""
SELECT 'buoy' || CAST(o_orderkey % 9 AS VARCHAR) AS path, CAST(o_orderdate AS TIMESTAMP) + INTERVAL (o_orderkey % 24) HOUR + INTERVAL 10 MINUTE AS ts, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 98)::DOUBLE END AS wind_dir,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 60) / 2.0::DOUBLE END AS wind, (o_orderkey % 70) / 2.0::DOUBLE AS gust, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 20) / 4.0::DOUBLE END AS height FROM orders""")
def scan_ndbc(spark, sf_dir):
    """Buoys' text, with headers and units between the rows."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    number = lambda c: c.cast("string")
    fields = [F.date_format(d, "yyyy MM dd"), F.lpad(number(k % 24), 2, "0"), F.lit("10"), F.when(k % 4 == 0, "999").otherwise(number(k % 98)), F.when(k % 5 == 0, "99.0").otherwise(number(k % 60 / 2)), number(k % 70 / 2), F.when(k % 7 == 0, "99.00").otherwise(number(k % 20 / 4))]
    path = F.concat(F.lit("buoy"), number(k % 9)).alias("path")
    rows = table(spark, sf_dir, "orders")
    lines = rows.select(path, F.concat_ws("  ", *fields).alias("value"))
    heads = rows.where(k % 50 == 0).select(path, F.explode(F.array(F.lit("#YY MM DD hh mm WDIR WSPD GST WVHT"), F.lit("#yr mo dy hr mn degT m/s m/s m"), F.lit("YYYY MM DD hh mm WDIR WSPD GST WVHT"))).alias("value"))
    return text.ndbc_rows(lines.unionByName(heads))


@query("SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS site, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 15 MINUTE AS ts, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders WHERE o_orderstatus <> 'P'")
def scan_rdb(spark, sf_dir):
    """Tab-separated text; lines of other agencies, comments and widths are passed over."""
    value = F.when(F.col("o_orderkey") % 6 == 0, "Ice").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws("\t", F.when(F.col("o_orderstatus") == "P", "OTHER").otherwise("USGS"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:15")), F.lit("EST"), value)
    lines = table(spark, sf_dir, "orders").select(line.alias("value"))
    return text.rdb_rows(lines.unionByName(spark.createDataFrame([("# USGS\tcomment",), ("agency_cd\tsite_no\tdatetime\ttz\t00060",), ("5s\t15s\t20d\t6s\t14n",)], "value string")))


@query("SELECT 'file' || CAST(label AS VARCHAR) || '-' || CAST(vec_id // 64 AS VARCHAR) || '.tsf' AS file, 'T' || CAST(vec_id AS VARCHAR) AS series_id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN NULL ELSE CAST(round(x * 1000) AS INT) END) AS vals, 'daily' AS frequency FROM embeddings")
def scan_tsf(spark, sf_dir):
    """Text files on disk with @key lines, @data and series; ? is missing, comments and broken lines are passed over."""
    shown = F.transform("values", lambda x: F.when(x < 0, "?").otherwise(F.round(x * F.lit(1000).cast("float")).cast("int").cast("string")))  # a product of floats, as in SQL
    line = F.concat(F.lit("T"), F.col("series").cast("string"), F.lit(":2020-01-01:"), F.concat_ws(",", shown))
    file = F.concat(F.lit("file"), F.col("subset").cast("string"), F.lit("-"), F.floor(F.col("series") / 64).cast("string"), F.lit(".tsf"))

    def make(part: pa.Table):
        lines = ["# about", "@relation x", "@frequency daily", "@data", *(x for pair in zip(part.column("line").to_pylist(), ["# no"] * len(part)) for x in pair), "broken"]
        yield part.column("file")[0].as_py(), "\n".join(lines).encode()

    path = place(spark, "tsf")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series"), F.col("label").alias("subset"), F.col("embedding").cast("array<float>").alias("values"))
    ranges.write_files(rows.select(file.alias("file"), line.alias("line")), path, ["file"], make)
    return text.tsf(spark, path).select(_below("file"), "series_id", F.transform("values", lambda v: v.cast("int")).alias("vals"), F.col("metadata")["frequency"].alias("frequency"))


@query("SELECT DISTINCT lower(p_brand) AS stem FROM part")
def scan_stems(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit(" points")).alias("value"))
    return text.stem_rows(lines.unionByName(spark.createDataFrame([("# names",), ("  ",)], "value string")))


@query("SELECT c_name AS config, c_acctbal AS \"MASE\", c_acctbal / 2 AS \"CRPS\", CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS domain, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE CAST(c_nationkey AS INT) END AS num_variates FROM customer")
def scan_official(spark, sf_dir):
    """A leaderboard's CSV, written and read again; missing domains and numbers of variates."""
    path = place(spark, "official")
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("dataset"), F.lit("m").alias("model"), F.col("c_acctbal").alias("eval_metrics/MASE[0.5]"), (F.col("c_acctbal") / 2).alias("eval_metrics/mean_weighted_sum_quantile_loss"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("domain"), F.when(k % 4 != 0, F.col("c_nationkey").cast("double")).alias("num_variates"))
    c.write.option("header", True).csv(path)
    return text.official_results(spark, path)


@query("SELECT c_name AS config, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE CAST(c_custkey AS INT) END AS prediction_length, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS \"MASE\", c_acctbal / 4 AS \"CRPS\", CASE WHEN c_custkey % 2 = 0 THEN 0.125::DOUBLE END AS q10, CASE WHEN c_custkey % 2 = 0 THEN 0.875::DOUBLE END AS q90, CASE WHEN c_custkey % 3 = 0 THEN 0.5::DOUBLE END AS frac_k_gt1 FROM customer")
def scan_runs(spark, sf_dir):
    """Results as JSON, of which any part may be missing."""
    path, k = place(spark, "runs"), F.col("c_custkey")
    cover = F.when(k % 2 == 0, F.create_map(F.lit("0.1"), F.lit(0.125), F.lit("0.9"), F.lit(0.875)))
    model = F.struct(F.when(k % 7 != 0, F.col("c_acctbal")).alias("MASE"), (F.col("c_acctbal") / 4).alias("CRPS"), cover.alias("coverage"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("config"), F.when(k % 5 != 0, k.cast("int")).alias("prediction_length"), model.alias("model"), F.struct(F.when(k % 3 == 0, 0.5).alias("frac_k_gt1")).alias("ratein"))
    rows.write.json(path)
    from ..types import RESULT

    return text.run_rows(spark.read.schema(RESULT).json(path))


@query("SELECT 'p' || CAST(p_partkey AS VARCHAR) AS stem, CASE p_partkey % 6 WHEN 0 THEN 24.0 WHEN 1 THEN 7.0 WHEN 2 THEN p_size WHEN 3 THEN 0.0 WHEN 4 THEN -1.0 ELSE NULL END::DOUBLE AS season, p_partkey % 6 = 5 AS bad FROM part")
def scan_frequency_table(spark, sf_dir):
    """Entries of a frequency table in all their forms."""
    k = F.col("p_partkey") % 6
    entry = F.when(k == 0, '"H"').when(k == 1, '{"freq": "D", "weekly": true}').when(k == 2, F.concat(F.lit('{"freq": "H", "season": '), F.col("p_size").cast("string"), F.lit("}"))).when(k == 3, "null").when(k == 4, '{"season": "per_row"}').otherwise('{"freq": "D", "weekly": "often", "season": null}')
    out = fr.frequency_table(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("stem"), entry.alias("entry")))
    return out.select("stem", F.when(F.col("fault").isNull(), F.col("season")).alias("season"), F.col("fault").isNotNull().alias("bad"))


def _arrow_files(spark, sf_dir):
    """Arrow streams on disk: folder u holds series alone; of folder m the files hold pairs of series, but in part00002 single ones."""

    def make(part: pa.Table):
        name, out = part.column("path")[0].as_py(), io.BytesIO()
        single = name.startswith("u/") or name.endswith("part00002.arrow")
        rows = [np.asarray(v, np.float32) for v in part.sort_by("series").column("values").to_pylist()]
        kind = pa.list_(pa.float32()) if single else pa.list_(pa.list_(pa.float32()))
        target = [r.tolist() for r in rows] if single else [[r.tolist(), (-r).tolist()] for r in rows]
        schema = pa.schema([("freq", pa.string()), ("target", kind)])
        with pa.ipc.new_stream(out, schema) as w:
            for lo in range(0, len(target), 7):
                piece = target[lo : lo + 7]
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(["H"] * len(piece)), pa.array(piece, kind)], schema=schema))
        yield name, out.getvalue()

    path = place(spark, "arrow")
    name = F.concat(F.when(F.col("series") % 2 == 0, "u").otherwise("m"), F.lit("/part"), F.lpad(F.floor(F.col("series") / 128).cast("string"), 5, "0"), F.lit(".arrow"))
    ranges.write_files(arrays(spark, sf_dir).select("series", "values", name.alias("path")), path, ["path"], make)
    return binary.arrow_series(spark, path, partitionBytes=1 << 12)  # several tasks a file, small as the files are


_ARROW = """
f AS (SELECT vec_id AS series, CASE WHEN vec_id % 2 = 0 THEN 'u' ELSE 'm' END || '/part' || lpad(CAST(vec_id // 128 AS VARCHAR), 5, '0') || '.arrow' AS file, embedding AS v FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY series) - 1 AS n, file LIKE 'm/%' AND file NOT LIKE '%part00002.arrow' AS nested FROM f),
t AS (SELECT file, n // 7 AS batch, n % 7 AS row, nested, s.variate, unnest(range(64)) AS step, unnest(list_transform(v, lambda x: s.sign * x)) AS value FROM r JOIN (SELECT 0 AS variate, 1.0 AS sign UNION ALL SELECT 1, -1.0) s ON s.variate = 0 OR nested)"""
_VALUE = "round(value::DOUBLE * 100000) / 100000 AS value"


def _steps(rows, *keys):
    return rows.select(*keys, F.posexplode("values").alias("step", "value")).select(*keys, F.col("step").cast("long").alias("step"), rounded(F.col("value").cast("double"), 5).alias("value"))


@query(f"WITH {_ARROW} SELECT file, batch, row, 'H' AS freq, nested, CAST(variate AS INT) AS variate, step, {_VALUE} FROM t")
def scan_arrow(spark, sf_dir):
    """Arrow streams of several batches, with and without variates, by ranges of batches."""
    return _steps(_arrow_files(spark, sf_dir).withColumn("file", _below("path", 2)), "file", "batch", "row", "freq", "nested", "variate")


@query(f"WITH {_ARROW} SELECT file, batch, row, CAST(variate AS INT) AS variate, step, {_VALUE} FROM t WHERE file < 'm/part00002.arrow'")
def scan_arrow_items(spark, sf_dir):
    """Multivariate items: a folder's rows up to the first without variates."""
    return _steps(binary.arrow_items(_arrow_files(spark, sf_dir)).withColumn("file", _below("path", 2)), "file", "batch", "row", "variate")


@query(f"SELECT 'grid' || CAST(label AS VARCHAR) || '-' || CAST(vec_id // 64 AS VARCHAR) || '.npy' AS file, CAST(row_number() OVER (PARTITION BY label, vec_id // 64 ORDER BY vec_id) - 1 AS INT) AS channel, unnest(range(64)) AS step, round(unnest(embedding)::DOUBLE * 100000) / 100000 AS value FROM embeddings")
def scan_npy(spark, sf_dir):
    """Grids of channels by steps on disk, half of them in Fortran order, by ranges of bytes."""

    def make(part: pa.Table):
        name, grid = part.column("file")[0].as_py(), np.stack([np.asarray(v, np.float32) for v in part.sort_by("series").column("values").to_pylist()])
        yield name, ranges.npy_bytes(np.asfortranarray(grid) if name.startswith("grid1") else grid)

    path = place(spark, "npy")
    file = F.concat(F.lit("grid"), F.col("subset").cast("string"), F.lit("-"), F.floor(F.col("series") / 64).cast("string"), F.lit(".npy"))
    ranges.write_files(arrays(spark, sf_dir).select("series", "values", file.alias("file")), path, ["file"], make)
    points = ranges.points(ranges.npy_pieces(spark, path, partitionBytes=1 << 10).withColumn("file", _below("path")), ["file", "channel"])
    return points.select("file", "channel", "step", rounded(F.col("value").cast("double"), 5).alias("value"))


@query(f"SELECT 's' || CAST(label AS VARCHAR) || '-' || CAST(vec_id // 64 AS VARCHAR) AS subset, CAST(n AS BIGINT) AS series_id, unnest(range(len(v))) AS step, round(unnest(v)::DOUBLE * 100000) / 100000 AS value FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label, vec_id // 64 ORDER BY vec_id) - 1 AS n, embedding[1:CAST(vec_id % 65 AS INT)] AS v FROM embeddings)")
def scan_offsets(spark, sf_dir):
    """Subsets on disk as one array of values and one of offsets, some series empty; tasks read ranges of the values, and what is cut is put together again."""
    s = F.col("series")
    subset = F.concat(F.lit("s"), F.col("subset").cast("string"), F.lit("-"), F.floor(s / 64).cast("string"))
    a = arrays(spark, sf_dir).select(subset.alias("subset"), s.alias("series_id"), F.slice("values", F.lit(1), (s % 65).cast("int")).alias("values"))
    path = place(spark, "csr")
    ranges.write_csr(a, path)
    return _steps(binary.csr_series(spark, path, partitionBytes=1 << 8), "subset", "series_id")


@query("SELECT 's' || CAST(label AS VARCHAR) || '-' || CAST(vec_id // 64 AS VARCHAR) AS subset, CAST(row_number() OVER (PARTITION BY label, vec_id // 64 ORDER BY vec_id) - 1 AS BIGINT) AS series_id, vec_id % 65 AS length FROM embeddings WHERE label < 5")
def scan_lengths(spark, sf_dir):
    """Lengths of the series of some subsets: files of other subsets aren't opened, values aren't read."""
    s = F.col("series")
    subset = F.concat(F.lit("s"), F.col("subset").cast("string"), F.lit("-"), F.floor(s / 64).cast("string"))
    a = arrays(spark, sf_dir).select(subset.alias("subset"), s.alias("series_id"), "values", "subset").toDF("subset", "series_id", "values", "label")
    path = place(spark, "csr")
    ranges.write_csr(a.select("subset", "series_id", F.slice("values", F.lit(1), (F.col("series_id") % 65).cast("int")).alias("values")), path)
    wanted = [r[0] for r in a.where("label < 5").select("subset").distinct().collect()]  # names of subsets
    return ranges.csr_lengths(spark, path, only=",".join(wanted))


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 <> 3 AND (p_partkey % 3 <> 0 OR p_partkey % 20 = 0) AND (p_partkey % 3 <> 1 OR p_partkey % 20 < 12)")
def shard_selector(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "sliced").when(k % 3 == 1, "capped").otherwise("plain")
    path = F.concat(F.lit("root/"), name, F.lit("/data-"), F.lpad((k % 20).cast("string"), 5, "0"), F.lit("-of-00020"), F.when(k % 4 == 3, ".json").otherwise(".arrow"))
    return table(spark, sf_dir, "part").withColumn("path", path).where(corpus.wanted_shard(F.col("path"), ("sliced",), ("capped",))).select("p_partkey")


@query("SELECT DISTINCT p_brand AS subset FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45)")
def rerun_guard(spark, sf_dir):
    """Subsets that a rerun still has to do."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("subset"), "p_size")
    return corpus.missing_subsets(p.select("subset").distinct(), p.where("p_size > 45"))


@query("SELECT vec_id // 3 AS item_id, CAST(vec_id % 3 AS INT) AS member_pos, CAST(label AS VARCHAR) AS subset, vec_id AS series_id, CAST(vec_id % 5 * 2 AS BIGINT) AS shift FROM embeddings")
def items_roundtrip(spark, sf_dir):
    """The items table, written and read again."""
    path = place(spark, "items")
    a = arrays(spark, sf_dir)
    rows = a.select(F.floor(F.col("series") / 3).cast("long").alias("item_id"), (F.col("series") % 3).cast("int").alias("member_pos"), F.col("subset").cast("string").alias("subset"), F.col("series").alias("series_id"), (F.col("series") % 5 * 2).cast("long").alias("shift"))
    it.save_items(rows, path)
    return spark.read.parquet(path)
