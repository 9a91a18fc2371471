"""Text formats as relational plans: lines in, typed rows out; what can't be read is missing, not an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import col
from ..operators.clean import numeric, without
from ..types import RESULT


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", missing: str = "?", header: bool = True) -> DataFrame:
    """Delimited text, compressed or not, with a value that stands for missing. A schema spares the pass that would infer one."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, nullValue=missing, mode="PERMISSIVE")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (rising within a file), value: what the readers of lines below go on with."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line_no"), "value")


def preamble_rows(lines: DataFrame, mark: str, schema: str) -> DataFrame:
    """CSV below the line of each file that begins with mark (whose other columns are its header); lines before it and comments are skipped."""
    heads = lines.where(F.col("value").startswith(mark)).groupBy(F.col("path").alias("_p")).agg(F.min("line_no").alias("_h"))
    body = lines.join(heads, (F.col("path") == F.col("_p")) & (F.col("line_no") > F.col("_h"))).where(~F.col("value").startswith("#"))
    return body.select(F.from_csv("value", schema).alias("r")).select("r.*")


def after_preamble(spark: SparkSession, path: str, mark: str, schema: str) -> DataFrame:
    return preamble_rows(lines_of(spark, path), mark, schema)


def ndjson_rows(lines: DataFrame) -> DataFrame:
    """series, freq, date, value of lines that are JSON objects with series_id, f and data: [[date, value], ...]; values may be text."""
    rows = lines.select(F.from_json("value", "series_id STRING, f STRING, data ARRAY<ARRAY<STRING>>").alias("r")).select("r.*")
    return rows.select(F.col("series_id").alias("series"), F.col("f").alias("freq"), F.explode("data").alias("d")).select("series", "freq", F.get("d", F.lit(0)).alias("date"), numeric(F.get("d", F.lit(1))).alias("value"))


def ndjson_series(spark: SparkSession, path: str) -> DataFrame:
    return ndjson_rows(lines_of(spark, path))


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def isd_rows(lines: DataFrame) -> DataFrame:
    """station (the file's name), ts (hour), temperature, dew, pressure, wind_dir, wind: whitespace integers, -9999 is missing, tenths."""
    d = lines.select(F.element_at(F.split("path", "/"), -1).alias("station"), _fields(F.col("value")).alias("f")).where(F.size("f") >= 9)
    at = F.make_timestamp(*(F.get("f", F.lit(i)).try_cast("int") for i in range(4)), F.lit(0), F.lit(0))

    def value(i: int, scale: float) -> Column:
        return without(F.get("f", F.lit(i)).try_cast("double"), -9999.0) / scale

    return d.select("station", at.alias("ts"), value(4, 10).alias("temperature"), value(5, 10).alias("dew"), value(6, 10).alias("pressure"), value(7, 1).alias("wind_dir"), value(8, 10).alias("wind"))


def isd_lite(spark: SparkSession, path: str) -> DataFrame:
    return isd_rows(lines_of(spark, path))


def ndbc_rows(lines: DataFrame) -> DataFrame:
    """path, ts, wind_dir, wind, gust, height of buoy text whose header and unit lines come again and again; 99, 999 and 9999 are missing."""
    d = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("YY")).select("path", _fields(F.col("value")).alias("f")).where(F.size("f") >= 9)
    at = F.make_timestamp(*(F.get("f", F.lit(i)).try_cast("int") for i in range(5)), F.lit(0))
    names = ("wind_dir", "wind", "gust", "height")
    return d.select("path", at.alias("ts"), *(without(F.get("f", F.lit(5 + i)).try_cast("double"), 99.0, 999.0, 9999.0).alias(n) for i, n in enumerate(names)))


def ndbc(spark: SparkSession, path: str) -> DataFrame:
    return ndbc_rows(lines_of(spark, path))


def rdb_rows(lines: DataFrame, agency: str = "USGS") -> DataFrame:
    """site, ts, value of tab-separated text, from the lines of the agency alone."""
    d = lines.where(F.col("value").startswith(f"{agency}\t")).select(F.split("value", "\t").alias("f"))
    return d.select(F.get("f", F.lit(1)).alias("site"), F.try_to_timestamp(F.get("f", F.lit(2)), F.lit("yyyy-MM-dd HH:mm")).alias("ts"), numeric(F.get("f", F.lit(4))).alias("value"))


def rdb(spark: SparkSession, path: str, agency: str = "USGS") -> DataFrame:
    return rdb_rows(lines_of(spark, path), agency)


def sdmx_tsv(lines: DataFrame, value: str = "value") -> DataFrame:
    """key (map of dimensions), period, number of a wide table: the first cell packs the dimensions, cells read "12.3 p" or ": c".

    lines: the table's lines in a column; the header is the line that holds a backslash."""
    heads = lines.where(F.col(value).contains("\\")).select(F.split(value, "\t").alias("h")).limit(1)
    dims = F.split(F.element_at(F.split(F.get("h", F.lit(0)), r"\\"), 1), ",")
    body = lines.where(~F.col(value).contains("\\")).select(F.split(value, "\t").alias("c")).crossJoin(F.broadcast(heads.select(dims.alias("d"), F.slice("h", 2, 1_000_000).alias("t"))))  # one row
    cells = body.select(F.map_from_arrays("d", F.transform(F.split(F.get("c", F.lit(0)), ","), lambda x: F.trim(x))).alias("key"), F.explode(F.arrays_zip(F.transform("t", lambda x: F.trim(x)).alias("period"), F.slice("c", 2, 1_000_000).alias("cell"))).alias("x"))
    return cells.select("key", "x.period", numeric(F.get(F.split(F.trim("x.cell"), " "), F.lit(0))).alias("number"))


def best_copies(rows: DataFrame, rest: list[str], order: str, unit: str = "unit", adjusted: str = "s_adj", derived: str = r"^(I|PCH|RT)") -> DataFrame:
    """One row per remaining key: not a derived unit before a derived one, unadjusted before adjusted, then the first."""
    rank = F.col(unit).rlike(derived).cast("int") * 2 + (F.col(adjusted) != "NSA").cast("int")
    best = rows.withColumn("_rank", rank).withColumn("_n", F.row_number().over(Window.partitionBy(*rest).orderBy("_rank", order)))
    return best.where("_n = 1").drop("_rank", "_n")


def tsf(spark: SparkSession, path: str) -> DataFrame:
    return tsf_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def tsf_rows(files: DataFrame) -> DataFrame:
    """file, metadata (map), series_id, values (floats; what can't be read is NULL) of files (file, value: the whole text) with @key value lines, @data, and
    id:timestamp:v1,v2,... lines."""
    files = files.select("file", F.split("value", r"\r?\n").alias("lines"))
    lines = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    files = files.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", F.lower), "@data")).where("at > 0")
    head = F.filter(F.slice("lines", F.lit(1), (F.col("at") - 1).cast("int")), lambda x: x.startswith("@"))
    meta = F.map_from_entries(F.transform(F.array_distinct(F.transform(head, lambda x: F.regexp_extract(x, r"^@(\S+)", 1))), lambda k: F.struct(k, F.array_join(F.transform(F.filter(head, lambda x: x.startswith(F.concat(F.lit("@"), k, F.lit(" ")))), lambda x: F.regexp_extract(x, r"^@\S+\s+(.*)$", 1)), "; "))))
    rows = files.select("file", meta.alias("metadata"), F.explode(F.slice("lines", (F.col("at") + 1).cast("int"), F.size("lines"))).alias("line"))
    parts = F.split("line", ":", 3)
    rows = rows.select("file", "metadata", parts.alias("p")).where(F.size("p") >= 2)
    return rows.select("file", F.get("p", F.lit(0)).alias("series_id"), F.transform(F.split(F.element_at("p", -1), ","), lambda v: F.trim(v).try_cast("float")).alias("values"), "metadata")


def hourly_columns(df: DataFrame, keys: list[str], columns: list[str], name: str = "hour") -> DataFrame:
    """Wide to long: one row per key and column, name counts the columns from 0."""
    return df.select(*keys, F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias(name, "value"))


def official_rows(d: DataFrame) -> DataFrame:
    """config, MASE, CRPS, domain, num_variates (1 if missing) of a leaderboard's columns, all text."""
    variates = F.col("num_variates").try_cast("double").cast("int") if "num_variates" in d.columns else F.lit(None).cast("int")
    domain = F.coalesce("domain", F.lit("")) if "domain" in d.columns else F.lit("")
    return d.select(F.col("dataset").alias("config"), F.col("`eval_metrics/MASE[0.5]`").cast("double").alias("MASE"), F.col("`eval_metrics/mean_weighted_sum_quantile_loss`").cast("double").alias("CRPS"), domain.alias("domain"), F.coalesce(variates, F.lit(1)).alias("num_variates"))


def official_results(spark: SparkSession, path: str) -> DataFrame:
    return official_rows(spark.read.csv(path, header=True))


def run_rows(d: DataFrame) -> DataFrame:
    """config, h, MASE, CRPS, q10, q90, frac_k_gt1 of a result per configuration (RESULT's columns); any of them may be missing."""
    cover = [F.try_element_at("model.coverage", F.lit(x)) for x in ("0.1", "0.9")]
    return d.select("config", F.coalesce("prediction_length", F.lit(0)).alias("prediction_length"), "model.MASE", "model.CRPS", cover[0].alias("q10"), cover[1].alias("q90"), F.col("ratein.frac_k_gt1").alias("frac_k_gt1"))


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """run_rows() of one JSON file per configuration."""
    return run_rows(spark.read.schema(RESULT).json(path, multiLine=True))


def rates_text(rates: str | Column, single: str | Column) -> Column:
    """"K" of one rate, or "mix k2:0.31 ..." of a map of rates to weights, in order of rates."""
    entries = F.array_sort(F.map_entries(col(rates)))
    text = F.concat(F.lit("mix "), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("k"), e["key"].cast("string"), F.lit(":"), F.format_number(e["value"], 2))), " "))
    return F.when(col(rates).isNotNull() & (F.size(col(rates)) > 0), text).otherwise(col(single).cast("string"))


def stem_rows(lines: DataFrame) -> DataFrame:
    """stem: the first words of a manifest's lines, lower-cased; blank lines and comments are skipped."""
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.lower(F.get(_fields(F.col("value")), F.lit(0))).alias("stem")).distinct()


def stems(spark: SparkSession, path: str) -> DataFrame:
    return stem_rows(lines_of(spark, path))
