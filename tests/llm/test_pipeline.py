import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import mixing, packing, queries
from chronoloom.llm.common import spill, written

from .test_jaccard_join import shingles
from .test_language_id import slow
from .test_line_dedup import brute as line_brute
from .test_packing import check

pipeline = pytest.importorskip("corpus_pipeline")


def one_of_each_group(rows):
    """Places of the rows (id, text) that stay: the smallest id of each component of near duplicates, rows without one last."""
    sets, left = [shingles(t) for _, t in rows], set(range(len(rows)))
    stay = []
    while left:
        group = todo = {left.pop()}
        while todo:
            todo = {b for b in left for a in todo if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
            left -= todo
            group = group | todo
        stay.append(min(group, key=lambda a: (rows[a][0] is None, rows[a][0] or 0)))
    return stay


def columns(df):
    return [c for c, _ in df.dtypes]


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = columns(docs)
    all_ = docs.collect()
    labelled = [(r["text"], r["lang"]) for r in all_ if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["text"] and r["lang"] is not None]
    told = dict(zip([r["doc_id"] for r in all_], slow(labelled, [r["text"] for r in all_])))
    one = spill(pipeline.known_language(spark, docs, sf), "one")
    assert {r["doc_id"] for r in one.collect()} == {i for i, (lang, _, unsure) in told.items() if lang != "und" and not unsure}
    assert one.count() >= 0.98 * docs.count()

    two = spill(pipeline.unique_lines(spark, one, sf), "two")
    want = {i: t for i, t, _, d in line_brute([(r["doc_id"], r["text"]) for r in one.collect()]) if not d or t.split()}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = spill(pipeline.no_near_duplicates(spark, two, sf), "three")
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(rows[a][0] for a in one_of_each_group(rows))

    four = spill(pipeline.mixed(spark, three, sf), "four")
    con = duckdb.connect()
    con.register("documents", three.toPandas())
    copies = {i: n for i, n in con.execute(f"SELECT doc_id, copies FROM ({queries.ORACLES['op8_pareto_mixing']})").fetchall()}
    assert {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}

    for df in (one, two, three, four):
        assert columns(df) == names
    five = pipeline.packed(spark, four, sf).collect()
    check([(r["doc_id"], r["text"]) for r in four.collect()], five, packing.CAPACITY)

    assert sorted(map(str, pipeline.run(spark, sf).collect())) == sorted(map(str, five))


def test_edges(spark, edge, empty):
    for docs in (edge, empty):
        for _, stage in pipeline.STAGES[:-1]:
            docs = spill(stage(spark, docs, ""), "stage")
        out = pipeline.STAGES[-1][1](spark, docs, "")
        assert out.where(F.col("free") < 0).count() == 0


def test_near_duplicates_lose_nothing_else(spark):
    """Different texts of one id stay, copies without an id and repeated rows go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " more", "en", "s", 1), (None, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "de", "s", 1), (None, None, "en", "s", 1), (None, "", "en", "s", 1), (3, "", "en", "s", 1), (3, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key", F.lit("x")).repartition(3)
    out = pipeline.no_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (None, None), (None, ""), (3, ""), (3, "")], key=str)


def test_run_leaves_little_behind(spark, sf):
    before = written(spark)
    assert pipeline.run(spark, sf).count() > 0
    left = {n.split("-")[1] for n in written(spark) - before}
    assert left <= {"mixing", "pieces"}


def test_it_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is pipeline.run
    assert len([n for n in __spark_entry__.queries() if n.startswith("op")]) == 13
