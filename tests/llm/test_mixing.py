import pytest
from pyspark.sql import functions as F

from chronoloom.llm import mixing as M


def water(sizes, share=1.5, most=2.0):
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def test_edges(edge, edge_rows, clash):
    got = M.mix(edge, M.word_count("text")).collect()
    assert len(got) == len(edge_rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = r["source"]
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    assert target == pytest.approx(water(sizes))
    for s in sizes:  # within half of the largest document that could be the last
        assert abs(taken[s] - target[s]) <= 0.5 * max(r["size"] for r in got if r["source"] == s) + 1
    again = M.mix(clash, M.word_count("text")).select("doc_id", "size", "copies").collect()
    assert sorted(map(str, again)) == sorted(map(str, [r for r in M.mix(edge.repartition(7), M.word_count("text")).select("doc_id", "size", "copies").collect()]))


def test_empty_and_wordless(empty, spark):
    assert M.mix(empty, M.word_count("text")).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in M.mix(blank, M.word_count("text")).collect()] == [(0, 0.0, 0)] * 2


def test_taken_words_come_near_the_targets_of_large_sources(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), (1 + F.pmod(F.xxhash64("id"), F.lit(400))).alias("n"))
    out = M.mix(rows, F.col("n")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 200 for r in out)


def test_weights_raise_inclusion(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("n"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    out = {r["w"]: r["c"] for r in M.mix(rows, F.col("n"), share=0.4, weight="w").groupBy("w").agg(F.avg("copies").alias("c")).collect()}
    assert out[3.0] == pytest.approx(0.6, abs=0.06) and out[1.0] == pytest.approx(0.2, abs=0.06)


def test_repeat(edge):
    m = M.mix(edge, M.word_count("text"))
    assert M.repeat(m, edge.columns).count() == m.agg(F.sum("copies")).first()[0]


def test_rows_that_tie_share_no_fate(spark):
    for texts in (["same text of five words"] * 100, [f"text {i} of five words" for i in range(100)]):
        rows = spark.createDataFrame([(None, t, "a") for t in texts] + [(i, "b c d e f", "z") for i in range(400)], "doc_id long, text string, source string").repartition(3)
        out = M.mix(rows, M.word_count("text"), share=0.4)
        for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
            assert abs(r["t"] - r["g"]) <= 2.5


def test_ties_that_fill_a_range_are_cut(spark, monkeypatch):
    monkeypatch.setattr(M, "SORTED_ROWS", 20)
    rows = spark.createDataFrame([(7, "one two three", "a")] * 300 + [(i, "one two", "a") for i in range(300)], "doc_id long, text string, source string").repartition(5)
    for share in (0.3, 0.7, 1.2):
        r = M.mix(rows, M.word_count("text"), share=share).agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("c")).first()
        assert abs(r["t"] - r["g"]) <= 1.5 and r["c"] <= 2


def test_inclusion_follows_the_weights_over_seeds(spark):
    n = 60
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("words"), (1.0 + F.col("id") % 4).alias("w"))
    plan = M.expected_copies(spark.createDataFrame([("a", n * 10, 0.5 * n * 10)], "s string, source_size long, target double"), rows.groupBy(F.col("source").alias("s"), F.round(16 * F.log2("w")).cast("int").alias("k")).agg(F.sum("words").alias("words")), 2.0)
    p = {r["k"]: r["whole"] + r["part"] / 2**M.FINE for r in plan.collect()}
    assert sum(p[round(16 * w)] for w in (0.0, 1.0, 1.5849625, 2.0)) == pytest.approx(2.0, abs=1e-6) and p[32] == pytest.approx(4 * p[0], rel=1e-6)
    taken = {}
    for seed in range(8):
        for r in M.mix(rows, F.col("words"), share=0.5, weight="w", seed=seed).groupBy("w").agg(F.avg("copies").alias("c")).collect():
            taken[r["w"]] = taken.get(r["w"], 0.0) + r["c"] / 8
    for w, c in taken.items():  # 120 draws each: three deviations
        e = p[round(16 * {1.0: 0.0, 2.0: 1.0, 3.0: 1.5849625, 4.0: 2.0}[w])]
        assert abs(c - e) <= 3 * (e * abs(1 - e) / 120) ** 0.5 + 0.02


def test_whole_copies_come_before_the_draw(spark):
    rows = spark.createDataFrame([(i, "a b c d", "a", 16.0 if i < 5 else 1.0) for i in range(50)], "doc_id long, text string, source string, w double")
    out = M.mix(rows, M.word_count("text"), share=1.2, weight="w").collect()
    assert all(r["copies"] == 2 for r in out if r["w"] == 16.0) and {r["copies"] for r in out if r["w"] == 1.0} == {1, 2}


def test_many_sources(spark):
    sizes = {f"s{i:05d}": 1 + i * 7919 % 97 for i in range(3000)}
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, n long")
    got = {r["source"]: r["target"] for r in M.targets(rows, "source", "n", 1.5, 2.0, M.WEIGHTS).collect()}
    assert got == pytest.approx(water(sizes))
