import numpy as np
from pyspark.sql import functions as F

from chronoloom.llm import collision_search as C


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v) for i, v in zip(ids if ids is not None else range(len(x)), [None if r is None else [None if c is None else float(c) for c in r] for r in x])], "vec_id long, embedding array<float>")


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        s = [(-float(np.dot(x[q].astype(float), x[j].astype(float))), ids[j]) for j in range(len(x)) if ids[j] != ids[q]]
        out[ids[q]] = sorted(s)[:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(found.get(q, set()) & {i for _, i in w}) / max(len(w), 1) for q, w in want.items()])


def test_recall_on_spheres_and_on_lengths_of_their_own(spark):
    rng = np.random.default_rng(0)
    unit = rng.standard_normal((3000, 32)).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    longer = (unit * rng.uniform(0.1, 4, (3000, 1))).astype(np.float32)
    clusters = (rng.standard_normal((30, 32))[rng.integers(0, 30, 3000)] + 0.1 * rng.standard_normal((3000, 32))).astype(np.float32)
    for x in (unit, longer, clusters):
        df = vectors(spark, x)
        got = C.nearest(df, F.expr("vec_id % 20 = 0"), 20).collect()
        assert len(got) == 150 * 20
        assert recall(got, brute(x, list(range(3000)), range(0, 3000, 20), 20)) >= 0.9
        for r in got[:200]:
            assert abs(r["score"] - float(np.dot(x[r["query_id"]].astype(float), x[r["vec_id"]].astype(float)))) < 1e-9
        by = {}
        for r in got:
            by.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
        for rows in by.values():
            rows.sort()
            assert [a for a, _, _ in rows] == list(range(1, 21)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_ties_repeats_and_unusable_vectors(spark):
    x = [[1, 0], [1, 0], [1, 0], [0, 1], None, [0, 0], [float("nan"), 1], [None, 1], [], [float("inf"), 0], [1, 2, 3], [-1, 0]]
    df = vectors(spark, x).withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in C.nearest(df, F.expr("vec_id IN (0, 4, 5, 10)"), 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 11, -1.0)]


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[::3] = x[0]
    df = vectors(spark, x)
    got = C.nearest(df, F.expr("vec_id = 0"), 20).orderBy("rank").collect()
    want = brute(x, list(range(900)), [0], 20)[0]
    assert [r["vec_id"] for r in got] == [i for _, i in want]


def test_empty(spark):
    df = vectors(spark, [])
    assert C.nearest(df, F.lit(True), 5).collect() == []


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    monkeypatch.setattr(C, "BLOCK", 100)
    monkeypatch.setattr(C, "QUERIES", 3)
    df = vectors(spark, x)
    got = C.nearest(df, F.expr("vec_id % 20 = 0"), 20).collect()
    assert len(got) == 600 and recall(got, brute(x, list(range(600)), range(0, 600, 20), 20)) >= 0.9


def test_rows_of_one_id_are_rows_of_their_own(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 6)).astype(np.float32)
    ids = [0, 0, *range(2, 40)]
    got = C.nearest(vectors(spark, x, ids), F.col("vec_id") == 0, 10).collect()
    want = []
    for q in (0, 1):
        s = sorted((-float(np.dot(x[q].astype(float), x[j].astype(float))), ids[j]) for j in range(40) if j != q)[:10]
        want += [(r + 1, i, round(-v, 9)) for r, (v, i) in enumerate(s)]
    assert sorted((r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)


def test_null_queries_and_ids(spark):
    df = vectors(spark, [[1, 0], [0, 1], [1, 1]]).withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))
    assert [(r["query_id"], r["vec_id"]) for r in C.nearest(df, F.col("vec_id") == 1, 5).collect()] == [(1, 2)]
    assert C.nearest(df, F.lit(None).cast("boolean"), 5).collect() == []


def test_queries_visit_the_cells_in_reach_only(spark, monkeypatch):
    """Clustered vectors: most blocks are left out, and few entries are counted against all pairs."""
    monkeypatch.setattr(C, "BLOCK", 200)
    rng = np.random.default_rng(5)
    x = 10 * rng.standard_normal((40, 16))[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    met, answer = [], C.spill
    monkeypatch.setattr(C, "spill", lambda df, name: met.append((name, answer(df, name))) or met[-1][1])
    kept = []
    monkeypatch.setattr(C, "forget", lambda *t: kept.extend(t))
    df = vectors(spark, x)
    got = C.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert recall(got, brute(x, list(range(4000)), range(0, 4000, 20), 20)) >= 0.95
    visits, cells = (next(t for n, t in met if n == name) for name in ("visits", "cells"))
    assert visits.count() < 0.35 * 200 * cells.agg(F.sum("subs")).first()[0]


def test_counts_of_wider_windows_add_up():
    """A search that widens finds what one with the final radius finds, and counts no entry twice."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 12))
    longest = float(np.linalg.norm(x, axis=1).max())
    own = np.arange(0, 500, 50)
    j, i, s, counted, verified = C.search(x, np.arange(500), x[own], own, 20, longest)
    assert counted <= C.LINES * 500 * len(own) and verified > 0
    exact = x[own] @ x.T
    exact[np.arange(len(own)), own] = -np.inf
    want = np.sort(exact, 1)[:, -20:]
    hits = [np.isin(np.round(want[q], 9), np.round(s[j == q], 9)).mean() for q in range(len(own))]
    assert np.mean(hits) >= 0.9


def test_more_lengths_than_are_searched_together(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(1 + i % 7)]) for i in range(140)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = C.nearest(df, F.col("vec_id") % 5 == 0, 3).collect()
    monkeypatch.setattr(C, "MOST_LENGTHS", 2)
    assert sorted(C.nearest(df, F.col("vec_id") % 5 == 0, 3).collect()) == sorted(asked) and len(asked) == 28 * 3
