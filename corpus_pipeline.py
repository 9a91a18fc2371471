"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Null and empty texts, texts without letters and texts between two languages go in the first stage; very long texts are worked on whole in all of them. Null ids,
languages and sources are values like others, extra columns travel along, repeated rows are told in the third stage, and an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import jaccard_join, language_id, line_dedup, mixing, packing
from chronoloom.llm.common import Filter, no_clash, small, spill, sweep, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without letters (null and empty ones among them) and those between two languages go. Repeated rows fare alike."""
    told = language_id.identify(docs)
    return told.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others hold; a document that loses all of them goes. Rows of one id all keep the lines that their id is the largest for;
    lines of rows without an id give way to any. A null text becomes an empty one."""
    kept = line_dedup.dedup_lines(docs)
    kept = kept.where((F.col("n_dropped") == 0) | F.col("text").rlike(mixing.WORD))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id (rows without one come last), then the smallest hash of the text; of rows that are equal
    in both the one with the smallest hash of all columns. Different texts of one id that aren't near duplicates all stay, and so do texts without words."""
    near = spill(jaccard_join.near_groups(docs).where("component IS NOT NULL").groupBy("component", "doc_id", "own").agg(F.count("*").alias("n")), "near")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("own"))
    best = near.groupBy(F.col("component").alias("c")).agg(F.min(order).alias("best"))
    told = near.join(best, F.col("component") == F.col("c")).select(F.xxhash64("doc_id", "own").alias("key"), "doc_id", "own", (order == F.col("best")).alias("stays"), "n")
    told = spill(told.where("NOT stays OR n > 1"), "told")  # what isn't in it stays as it is

    key, own, its_key, its_id, its_own, stays = no_clash(docs, "_key", "_own", "_key_2", "_id_2", "_own_2", "_stays")
    rows = docs.withColumn(own, F.xxhash64("text")).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), own))
    concerned, others = Filter(told, "key").split(rows, key)
    same = (F.col(key) == F.col(its_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(its_own))
    met = concerned.join(small(told.select("key", "doc_id", "own", "stays").toDF(its_key, its_id, its_own, stays)), same, "left")
    out = others.unionByName(met.where(F.col(stays).isNull()).select(*rows.columns)).select(*docs.columns)
    if told.where("stays").limit(1).count():
        whole = F.struct(*docs.columns)
        one = met.where(F.col(stays)).groupBy(key, its_id, own).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(stays))
        out = out.unionByName(one.select(f"{stays}.*"))
    return out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; longer ones have the larger odds of a further copy. Rows that tie are drawn one by one; null sources are a
    source; texts without words take part with size 0."""
    words, weight = no_clash(docs, "words", "weight")
    rows = docs.withColumn(words, mixing.word_count("text"))
    return mixing.repeat(mixing.mix(rows.withColumn(weight, mixing.length_weight(words)), F.col(words), weight=weight), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words go; copies of a text never share a bin, nor do documents of a source. See packing.pack() for nulls, ties and equal rows."""
    return packing.pack(docs, mixing.word_count("text"), F.xxhash64("text"))


STAGES = [("language_id", known_language), ("line_dedup", unique_lines), ("near_duplicates", no_near_duplicates), ("mixing", mixed), ("packing", packed)]

#: Stages 1, 3 and 5 have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the words of the documents go that the stages keep. What a stage has written besides its result is removed with the stage's input."""
    docs = table(spark, sf_dir, "documents")
    before = written(spark)
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), name)
        sweep(spark, before | {n for n in written(spark) if n.startswith(f"chronoloom-{name}-")})
    return STAGES[-1][1](spark, docs, sf_dir)
