"""What each public source goes through on its way to series, as plans over its raw table. Downloads aren't part of the engine: a recipe takes a DataFrame.

Every recipe returns keys, step and value (points), on a grid without gaps in step; keys name the series. Where a source's table is wide, columns become series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clean, grid
from ..operators.match import drop_listed
from .text import hourly_columns


def columns_to_series(df: DataFrame, step: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, series (column name), step, value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("series"), F.col(c).try_cast("double").alias("value")) for c in columns))).alias("x")
    return clean.canonical(df.select(*(keys or []), F.col(step).cast("long").alias("step"), pairs).select(*(keys or []), "x.series", "step", "x.value"))


def minute_counts_by_day(df: DataFrame, keys: list[str], day: str, days: int = 14, hashed: str | None = None, buckets: int = 18) -> DataFrame:
    """Serverless invocations, first vintage: one row per function and day with 1440 minute columns named 1 to 1440; a stable sample by the function's hash; days that are
    missing stay missing."""
    d = df.where(clean.hash_bucket(hashed, buckets)) if hashed else df
    d = d.where(F.col(day).between(1, days))
    long = hourly_columns(d, [*keys, day], [str(m) for m in range(1, 1441)], "minute")
    placed = long.select(*keys, ((F.col(day) - 1) * 1440 + F.col("minute")).cast("long").alias("step"), "value")
    spans = placed.select(*keys).distinct().select(*keys, F.lit(0).alias("_lo"), F.lit(days * 1440 - 1).alias("_hi"))
    return grid.filled(spans, placed, keys)


def varied_columns(df: DataFrame, file: str, step: str, columns: list[str], above: int = 16, most: int = 24, seed: int = 0) -> DataFrame:
    """Traces and incident cases: numeric columns with more than above different values, a seeded sample of most per file."""
    p = clean.many_values(columns_to_series(df, step, columns, [file]), [file, "series"], above)
    chosen = clean.seeded_sample(p.select(file, "series").distinct(), [file], "series", most, seed)
    return p.join(chosen, [file, "series"], "left_semi")


def train_then_test(train: DataFrame, test: DataFrame, machine: str, row: str, columns: list[str]) -> DataFrame:
    """Server metrics: the rows of both parts end to end per machine, columns to series."""
    after = train.groupBy(machine).agg((F.max(row) + 1).alias("_n"))
    later = test.join(after, machine, "left").withColumn(row, F.col(row) + F.coalesce("_n", F.lit(0))).drop("_n")
    return columns_to_series(train.unionByName(later), row, columns, [machine])


def cycles(df: DataFrame, cycle: str, samples: str, per_block: int) -> DataFrame:
    """Hydraulic test rig: a row is a cycle of samples; means of fixed blocks, cycles end to end."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(samples) / per_block).cast("int") - 1), lambda i: F.aggregate(F.slice(samples, i * per_block + 1, per_block), F.lit(0.0), lambda a, x: a + x) / per_block)
    d = df.select(cycle, blocks.alias("b"))
    return d.select(F.col(cycle), F.size("b").alias("_n"), F.posexplode("b").alias("_i", "value")).select(F.lit("rig").alias("series"), (F.col(cycle) * F.col("_n") + F.col("_i")).cast("long").alias("step"), "value")


def by_dimensions(df: DataFrame, dims: list[str], date: str, value: str, unit: str, filters: dict[str, list[str]] | None = None) -> DataFrame:
    """Official statistics: optional IN lists (a column that isn't there is ignored), rows with a value, one series per combination of the remaining dimensions (none of
    them null), period ordinals on a grid."""
    d = df.where(F.col(value).isNotNull())
    for c, allowed in (filters or {}).items():
        if c in df.columns:
            d = d.where(F.col(c).isin(*allowed))
    for c in dims:
        d = d.where(F.col(c).isNotNull())
    return grid.scatter(d.select(*dims, grid.ordinal(date, unit).cast("long").alias("step"), clean.numeric(F.col(value).cast("string")).alias("value")), dims)


def year_week(df: DataFrame, dims: list[str], year: str, week: str, value: str, weeks: int = 53) -> DataFrame:
    """Weekly deaths and notifiable diseases: ordinal year * weeks + week."""
    d = df.where(F.col(value).isNotNull())
    return grid.scatter(d.select(*dims, (F.col(year) * weeks + F.col(week)).cast("long").alias("step"), F.col(value).cast("double").alias("value")), dims)


def indicators(df: DataFrame, keys: list[str], indicator: str, years: list[str], without: tuple[str, ...] = (), least: int = 20, most: int | None = None) -> DataFrame:
    """Development indicators: no indicator with one of the prefixes, year columns to steps, enough values, a seeded sample."""
    d = df
    for p in without:
        d = d.where(~F.col(indicator).startswith(p))
    long = hourly_columns(d, [*keys, indicator], years, "step").withColumn("step", F.col("step").cast("long"))
    long = clean.min_observed(long, [*keys, indicator], least)
    if most:
        ids = long.select(*keys, indicator).distinct().withColumn("_id", F.concat_ws("/", *keys, indicator)).withColumn("_all", F.lit(0))
        long = long.join(clean.seeded_sample(ids, ["_all"], "_id", most).drop("_id", "_all"), [*keys, indicator], "left_semi")
    return long


def gauges(df: DataFrame, site: str, seconds: str, value: str, width: int, sites: int | None = None, taken: DataFrame | None = None, sentinels: tuple[float, ...] = ()) -> DataFrame:
    """Stream, sea and weather stations: sites that aren't taken yet, a seeded sample of them, sentinels out, means of bins of width seconds on a grid from the first."""
    d = drop_listed(df, taken, [site]) if taken is not None else df
    if sites:
        chosen = clean.seeded_sample(d.select(site).distinct().withColumn("_all", F.lit(0)), ["_all"], site, sites).drop("_all")
        d = d.join(chosen, site, "left_semi")
    d = d.withColumn(value, clean.without(value, *sentinels)) if sentinels else d
    out = grid.tumbling_mean(d.select(site, F.col(seconds).alias("step"), F.col(value).alias("value")), [site], width)
    return out.withColumnRenamed("bin", "step")


def monitors(df: DataFrame, parts: list[str], hours: str, value: str, not_parameter: str | None = None) -> DataFrame:
    """Air monitors: key of joined parts, an hourly grid, the first of equal hours; wind direction left out."""
    d = df.where(F.col(parts[-1]) != not_parameter) if not_parameter else df
    d = d.select(F.concat(*(F.col(c).cast("string") for c in parts)).alias("series"), F.col(hours).alias("step"), clean.numeric(F.col(value).cast("string")).alias("value"))
    return grid.reindex(d, ["series"], 1)


def turbines(df: DataFrame, turbine: str, minutes: str, channels: list[str]) -> DataFrame:
    """Wind farms: channels to series per turbine, years end to end on a grid of ten minutes."""
    d = columns_to_series(df.withColumn("_s", F.floor(F.col(minutes) / 10)), "_s", channels, [turbine])
    return grid.reindex(d, [turbine, "series"], 1)


def inferred_step(df: DataFrame, keys: list[str], seconds: str, value: str, allowed: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """Solar plants and smart meters: the median step in minutes; systems with another than the allowed ones go; a grid of that step."""
    d = df.select(*keys, F.col(seconds).alias("seconds"), F.col(value).alias("value"))
    steps = grid.infer_step(d, keys).where(F.col("minutes").isin(*allowed))
    d = d.join(steps, keys).select(*keys, "minutes", F.floor(F.col("seconds") / (60 * F.col("minutes"))).cast("long").alias("step"), "value")
    return grid.scatter(d, [*keys, "minutes"])


def observations(df: DataFrame, series: str, freq: str, date: str, value: str) -> DataFrame:
    """Energy series: exploded [date, value] pairs with yyyy, yyyyMM or yyyyMMdd dates, by the series' frequency."""
    at = F.when(F.length(date) == 4, F.make_date(F.col(date).cast("int"), F.lit(1), F.lit(1))).when(F.length(date) == 6, F.to_date(date, "yyyyMM")).otherwise(F.to_date(date, "yyyyMMdd"))
    d = df.withColumn("_d", at)
    step = F.when(F.col(freq) == "A", grid.ordinal("_d", "A")).when(F.col(freq) == "M", grid.ordinal("_d", "M")).when(F.col(freq) == "Q", grid.ordinal("_d", "Q")).when(F.col(freq) == "W", grid.ordinal("_d", "W")).otherwise(grid.ordinal("_d", "D"))
    return grid.scatter(d.select(series, freq, step.cast("long").alias("step"), clean.numeric(F.col(value).cast("string")).alias("value")), [series, freq])


def mostly_numeric(df: DataFrame, keys: list[str], days: str, value: str, share: float = 0.5) -> DataFrame:
    """Causes of death: series that are numbers in more than share of their rows, weekly grid."""
    d = df.select(*keys, F.floor(F.col(days) / 7).cast("long").alias("step"), clean.numeric(F.col(value).cast("string")).alias("value"))
    return grid.scatter(clean.complete(d, keys, share), keys)


def page_views(df: DataFrame, title: str, days: str, views: str) -> DataFrame:
    """Titles as a set without namespaces; weekly sums of seven observed days, without the first and the last week."""
    d = df.where(~F.col(title).contains(":")).select(title, F.col(days).alias("step"), F.col(views).cast("double").alias("value")).dropDuplicates([title, "step"])
    return grid.tumbling_sum(d, [title], 7, 7).withColumnRenamed("bin", "step")


def hours_of_days(df: DataFrame, keys: list[str], day: str, columns: list[str]) -> DataFrame:
    """Traffic counts: a row per day with an interval a column, the first row of a day, days end to end."""
    once = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, day).orderBy(*columns))).where("_n = 1")
    long = hourly_columns(once, [*keys, day], columns, "_i")
    return grid.scatter(long.select(*keys, (F.col(day) * len(columns) + F.col("_i")).cast("long").alias("step"), "value"), keys)


def by_ordinal(df: DataFrame, key: str, ordinal: str, metrics: list[str]) -> DataFrame:
    """Network metrics: values scattered by their time's number, from 0."""
    return grid.scatter(columns_to_series(df, ordinal, metrics, [key]), [key, "series"], zero_based=True)


def good_means(df: DataFrame, keys: list[str], seconds: str, value: str, flag: str | None = None, width: int = 10) -> DataFrame:
    """Loggers: means of width seconds over the values whose flag is 0."""
    v = clean.flagged(value, flag) if flag else F.col(value)
    return grid.tumbling_mean(df.select(*keys, F.col(seconds).alias("step"), v.alias("value")), keys, width).withColumnRenamed("bin", "step")


def power_traces(df: DataFrame, keys: list[str], micros: str, value: str, bad: str, width: int = 300_000_000) -> DataFrame:
    """Data centre power: rows that aren't flagged, steps of five minutes from each series' first time."""
    d = df.where(~F.col(bad)).withColumn("_t0", F.min(micros).over(Window.partitionBy(*keys)))
    return grid.scatter(d.select(*keys, F.floor((F.col(micros) - F.col("_t0")) / width).cast("long").alias("step"), F.col(value).alias("value")), keys)


def invocations(df: DataFrame, keys: list[str], minute: str, least: int = 200) -> DataFrame:
    """Serverless invocations, second vintage: events per minute with zeros between, of functions with enough events."""
    return grid.bin_counts(df.select(*keys, F.col(minute).cast("long").alias("step")), keys, least).withColumn("n", F.col("n").cast("double")).withColumnRenamed("n", "value")


def vibration(df: DataFrame, machine: str, operation: str, run: str, sample: str, value: str, width: int = 2000) -> DataFrame:
    """Machine tools: root mean square of blocks of width samples, runs of one machine and operation end to end."""
    blocks = grid.block_rms(df.select(machine, operation, run, F.col(sample).alias("step"), F.col(value).alias("value")), [machine, operation, run], width)
    n = F.row_number().over(Window.partitionBy(machine, operation).orderBy(run, "block"))
    return blocks.withColumn("step", n.cast("long") - 1).select(machine, operation, "step", "value")


def scaled_hours(df: DataFrame, station: str, ts: str, columns: dict[str, float]) -> DataFrame:
    """Weather stations: hourly means of columns (already without sentinels) over their scales."""
    hours = F.floor(F.unix_timestamp(ts) / 3600).cast("long")
    d = columns_to_series(df.select(station, hours.alias("_h"), *((F.col(c) / s).alias(c) for c, s in columns.items())), "_h", list(columns), [station])
    return grid.tumbling_mean(d, [station, "series"], 1).withColumnRenamed("bin", "step")


#: Recipe of each source, by family of sources.
CATALOGUE = {
    "azure_functions": minute_counts_by_day, "exathlon": varied_columns, "rcaeval": varied_columns, "smd": train_then_test, "uci_hydraulic": cycles, "uci_household": columns_to_series,
    "uci_steel": columns_to_series, "borealis_6s": columns_to_series, "eurostat_series": by_dimensions, "eurostat_monthly": by_dimensions, "eurostat_national": by_dimensions, "statcan": by_dimensions,
    "eurostat_weekly": year_week, "worldbank_wdi": indicators, "wdi": indicators, "noaa_water": gauges, "usgs_streamflow": gauges, "usgs": gauges, "usgs_more": gauges, "epa": monitors, "epa_more": monitors,
    "wind": turbines, "pvdaq": inferred_step, "eia": observations, "eia930": observations, "cdc": mostly_numeric, "cdc_nndss": year_week, "wikipedia": page_views, "webtris": hours_of_days, "nsw": hours_of_days,
    "cesnet": by_ordinal, "darck": good_means, "rae": good_means, "n2o": good_means, "google_power": power_traces, "azure_functions_2021": invocations, "bosch": vibration, "isd": scaled_hours,
    "isd_more": scaled_hours, "ndbc": gauges,
}
