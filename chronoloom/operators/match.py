"""Joins between collections of series, and multivariate items."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, values: str = "values") -> DataFrame:
    """df with key: a digest of the exact float values, NULLs alike."""
    return df.withColumn("key", F.sha2(F.to_json(F.transform(values, lambda v: v.cast("float"))), 256))


def match_unique(raw: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Rows of raw with the one stored row of equal key; a key that several stored rows hold matches nothing."""
    rest = [c for c in stored.columns if c != key]
    once = stored.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r")).where("_n = 1")  # partial sums: a key that many hold is no task of its own
    return raw.join(once.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)), key)


def sharing(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], key: str = "key", least: int = 3) -> DataFrame:
    """keys, by, shared: pairs of a left series and a right group that share at least least distinct keys."""
    a, b = left.select(*keys, key).distinct(), right.select(*by, key).distinct()
    return a.join(b, key).groupBy(*keys, *by).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def zip_channels(channels: dict[str, DataFrame], id_: str = "series_id", values: str = "values") -> DataFrame:
    """id, one array per channel: joined by position; an error if their counts or any lengths differ."""
    out = None
    for name, df in channels.items():
        part = df.select(id_, F.col(values).alias(name))
        out = part if out is None else out.join(part, id_, "full_outer")
    first = next(iter(channels))
    bad = F.lit(False)
    for name in channels:
        bad |= F.col(name).isNull() | (F.size(name) != F.size(first))
    return out.withColumn("_ok", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("the channels differ in count or length")).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """rows with their metadata; a row without any is an error."""
    joined = rows.join(metadata.withColumn("_found", F.lit(True)), key, "left")
    return joined.withColumn("_found", F.coalesce("_found", F.raise_error(F.concat(F.lit("no metadata for "), F.col(key).cast("string"))).cast("boolean"))).where("_found").drop("_found")


def common(runs: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner join of all runs on key; columns get the run's name as prefix."""
    out = None
    for name, df in runs.items():
        part = df.select(key, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key))
        out = part if out is None else out.join(part, key)
    return out


def drop_listed(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(listed.select(*keys).distinct(), keys, "left_anti")


def loaded_items(items: DataFrame, loaded: DataFrame, least: int = 2) -> DataFrame:
    """Members whose subset is loaded, of items that keep at least least of them."""
    kept = items.join(loaded.select("subset").distinct(), "subset", "left_semi")
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy("item_id"))).where(F.col("_n") >= least).drop("_n")


def item_span(items: DataFrame, lengths: DataFrame) -> DataFrame:
    """item_id, start, end: the steps that all members cover; empty if start >= end. lengths: subset, series_id, length."""
    return items.join(lengths, ["subset", "series_id"]).groupBy("item_id").agg(F.max("shift").alias("start"), F.min(F.col("shift") + F.col("length")).alias("end"))


def aligned(items: DataFrame, points: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """item_id, member_pos, step, value on the item's axis, NULL where a member has none: over spans (item_id, start, end), by default the union of the members'."""
    placed = items.join(points, ["subset", "series_id"]).select("item_id", "member_pos", (F.col("step") + F.col("shift")).alias("step"), "value")
    if spans is None:
        spans = placed.groupBy("item_id").agg(F.min("step").alias("start"), (F.max("step") + 1).alias("end"))
    axis = items.select("item_id", "member_pos").join(spans.where("start < end"), "item_id").select("item_id", "member_pos", F.explode(F.sequence("start", F.col("end") - 1)).alias("step"))
    return axis.join(placed, ["item_id", "member_pos", "step"], "left")


def seasonal_lag(points: DataFrame, keys: list[str], season: int, h: int, step: str = "step", value: str = "value") -> DataFrame:
    """keys, i (0 to h - 1), value: the last season repeated over the horizon; a series shorter than a season repeats what it has."""
    w = Window.partitionBy(*keys).orderBy(F.desc(step))
    last = points.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= season)
    m = F.count("*").over(Window.partitionBy(*keys))
    last = last.withColumn("_m", m).withColumn("_at", F.col("_m") - F.col("_back"))
    turns = F.sequence(F.lit(0), F.floor((F.lit(h - 1) - F.col("_at")) / F.col("_m")).cast("int"))
    return last.where(F.col("_at") < h).select(*keys, F.explode(turns).alias("_t"), "_at", "_m", value).select(*keys, (F.col("_at") + F.col("_t") * F.col("_m")).cast("int").alias("i"), value)


#: Bytes of names up to which found_in() sends an automaton of them to every task, and letters of a name's beginning by which it joins more of them.
AUTOMATON_BYTES, BEGINNING = 16 << 20, 4


def found_in(names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """The distinct names that are part of any of the texts. Names up to AUTOMATON_BYTES become an Aho-Corasick automaton that passes over each text once; more are
    joined by their beginnings with the texts' runs of as many letters, and then compared. The empty name is part of every text; nulls are part of none."""
    wanted = names.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct()
    there = texts.select(F.col(text).alias("_text")).where("_text IS NOT NULL")
    if (wanted.agg(F.sum(F.octet_length("_name") + 8)).first()[0] or 0) > AUTOMATON_BYTES:
        begins = wanted.withColumn("_size", F.least(F.char_length("_name"), F.lit(BEGINNING))).withColumn("_begin", F.expr("left(_name, _size)"))
        run = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("_text"), F.lit(1))), lambda i: F.substring(F.col("_text"), i, F.col("_size"))))
        runs = there.crossJoin(F.broadcast(begins.select("_size").distinct())).select("_text", run.alias("_run")).distinct()  # a row a size, BEGINNING + 1 at most
        return runs.join(begins, (F.col("_run") == F.col("_begin")) & F.col("_text").contains(F.col("_name"))).select(F.col("_name").alias(name)).distinct()
    listed = [r[0] for r in wanted.collect()]  # bounded by the sum above

    def search(batches):
        import ahocorasick

        automaton, seen = ahocorasick.Automaton(), set()
        for w in listed:
            if w:
                automaton.add_word(w, w)
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            for t in b.column(0).to_pylist():
                if len(automaton):
                    seen.update(w for _, w in automaton.iter(t))
                if "" in listed:
                    seen.add("")
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["_name"])

    return there.mapInArrow(search, "_name string").distinct().select(F.col("_name").alias(name))


def has_cousin(datasets: DataFrame, cousins: DataFrame, stems: DataFrame) -> DataFrame:
    """dataset, cousin: yes if any stem contains one of the dataset's cousin names, no if none does, ? if the dataset isn't in cousins.

    cousins: dataset, cousin (NULL for a dataset without any), as many as there are; see found_in() for how they meet the stems."""
    hit = cousins.join(found_in(cousins, stems, "cousin", "stem"), "cousin").select("dataset").distinct().withColumn("_hit", F.lit(True))
    known = cousins.select("dataset").distinct().withColumn("_known", F.lit(True))
    out = datasets.join(known, "dataset", "left").join(hit, "dataset", "left")
    return out.withColumn("cousin", F.when(F.col("_known").isNull(), "?").when(F.col("_hit"), "yes").otherwise("no")).drop("_known", "_hit")


def cuts(series: DataFrame, origins: int, h: int, season: int, values: str = "values") -> DataFrame:
    """series with origin, context, target: the last origins cuts one horizon apart that leave max(season + 1, 8) steps of context."""
    n = F.size(values)
    out = series.withColumn("origin", F.explode(F.sequence(F.lit(0), F.lit(origins - 1)))).where(n >= (F.col("origin") + 1) * h + max(season + 1, 8))
    end = n - (F.col("origin") + 1) * h
    return out.withColumn("context", F.slice(values, F.lit(1), end)).withColumn("target", F.slice(values, end + 1, F.lit(h))).drop(values)
