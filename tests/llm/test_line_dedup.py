import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import line_dedup as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x)) is None or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()], key=str)


def test_edges(edge, edge_rows, clash):
    want = brute([(r[0], r[1]) for r in edge_rows])
    assert any(w[3] for w in want)
    assert rows_of(L.dedup_lines(edge)) == want
    out = L.dedup_lines(clash)
    assert rows_of(out) == want and set(out.columns) == set(clash.columns)


def test_empty(empty):
    assert L.dedup_lines(empty).collect() == []


def test_many_shards_and_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 16)
    monkeypatch.setattr(L, "PROBES", 50)  # a shard's probes fill many groups
    rows = [(i, "\n".join(f"common line number {j:05d} of them" for j in range(i % 7 * 20, i % 7 * 20 + 60)) + "\none very common line that all have") for i in range(40)]
    rows += [(None, rows[0][1])] * 3 + [rows[5]] * 2
    assert rows_of(L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
    monkeypatch.setattr(L, "MOST_SHARDS", 4)  # fewer, larger shards
    monkeypatch.setattr(L, "SHARD_KEYS", 256)
    assert rows_of(L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_one_id_on_several_texts(spark):
    line = "a line of more than twenty characters"
    rows = [(1, f"{line}\nx"), (1, f"y\n{line}"), (2, line), (2, f"{line}\n{line}\nz"), (None, line)]
    assert rows_of(L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_a_high_least_number_of_documents(spark):
    line = "a line of more than twenty characters"
    for n in (299, 300, 301):
        rows = [(i, f"{line}\n{i}") for i in range(n)]
        assert rows_of(L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=300)) == (brute(rows) if n >= 300 else sorted([(i, t, 2, 0) for i, t in rows], key=str))


def test_nothing_per_line_comes_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 16)
    rows = [(i, "\n".join(f"common line number {j:05d} of them" for j in range(2000))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent, kind = [], type(spark.sparkContext)
    put = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, x: sent.append(x) or put(self, x))
    for name in ("collect", "toPandas", "toArrow", "first"):
        monkeypatch.setattr(type(df), name, lambda self, *a: pytest.fail("rows come to the driver"))
    out = L.dedup_lines(df)
    monkeypatch.undo()
    assert not sent and rows_of(out) == brute(rows)


def test_filters_never_miss(spark):
    from chronoloom.llm.common import Filter

    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit("x").alias("_w"))
    inside, outside = Filter(keys, "k").split(df, "k")
    got = {r["k"] for r in inside.collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1100 and inside.columns == df.columns
    assert {r["k"] for r in outside.collect()} == set(range(3000)) - got
    inside, outside = Filter(keys.where("k < 0"), "k").split(df, "k")
    assert inside.count() == 0 and outside.count() == 3000


def pair(values):
    h = np.array(sorted(values), object)
    return np.array([x >> 64 for x in h], np.uint64), np.array([x % 2**64 for x in h], np.uint64)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**128 - 1) | st.integers(0, 50) | st.integers(2**70, 2**70 + 50), max_size=300))
def test_perfect_hash(values):
    h1, h2 = pair(values)  # equal halves included
    levels, order = L.build(h1, h2)
    assert sorted(order.tolist()) == list(range(len(h1))) and sum(int(np.bitwise_count(x).sum()) for x in levels) == len(h1)


def test_probe_finds_its_keys_and_no_others():
    rng = np.random.default_rng(0)
    h1, h2 = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    n = np.arange(5000) % 400
    s = L.Shard(*L.Shard.make(h1, h2, n, np.arange(5000), n >= 3))
    rank = s.find(h1, h2)
    assert sorted(rank.tolist()) == list(range(5000)) and (s.counts[rank] == np.minimum(n, 255)).all()
    kept, keeper = s.kept_by(rank)
    assert (kept == (n >= 3)).all() and (keeper[kept] == np.arange(5000)[kept]).all()
    assert (s.find(rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 2**64, 5000, dtype=np.uint64)) == -1).all()


def test_sha_of_query(spark, sf):
    from chronoloom.llm.queries import op9_line_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute([(r[0], r[1]) for r in docs])}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in op9_line_dedup(spark, sf).collect()} == want


def test_copies_of_large_shards_grow_with_the_probes(spark, monkeypatch):
    """Beyond the most shards arrays grow; what is copied stays in proportion to what is asked."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "MOST_SHARDS", 4)
    monkeypatch.setattr(L, "SHARD_KEYS", 256)
    monkeypatch.setattr(L, "PROBES", 64)
    sizes = []
    for n in (4000, 16000):
        lines = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws("\n", *(F.concat(F.lit("a line of document "), ((F.col("id") + i) % (n // 2)).cast("string")) for i in range(4))).alias("text"))
        asked = L.probes(lines, "doc_id", "text", 20).cache()
        shards, count = L.index(asked.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")), asked.count(), 3)
        shards = shards.cache()
        bytes_ = sum(F.octet_length(c) for c in ("bits", "prints", "counts", "often", "keepers"))
        sizes.append(shards.join(L.copied(shards), "shard").agg(F.sum(F.col("copies") * bytes_)).first()[0] / asked.count())
        assert count == 4
    assert sizes[1] < 1.5 * sizes[0]
