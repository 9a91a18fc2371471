from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import mixing, packing


def brute(sizes, sources, clusters, capacity):
    bins = []
    out = []
    for n, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["left"] >= n and s not in b["s"] and c not in b["c"]]
        b = min(fits, key=lambda b: (b["left"], b["i"]), default=None)
        if b is None:
            b = {"left": capacity, "i": len(bins), "s": set(), "c": set()}
            bins.append(b)
        out.append((b["i"], capacity - b["left"]))
        b["left"] -= n
        b["s"].add(s)
        b["c"].add(c)
    return out, [b["left"] for b in bins]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 4), st.integers(0, 12)), max_size=60))
def test_best_fit_is_the_tightest_compatible_bin(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    n, s, c = ([r[k] for r in rows] for k in range(3))
    bins, starts, left = packing.best_fit(n, s, c, 50)
    assert (list(zip(bins, starts)), left) == brute(n, s, c, 50)


def check(rows, got, capacity):
    words = lambda t: len((t or "").split())
    assert sum(r["n_words"] for r in got) == sum(words(r[1]) for r in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for part in bins.values():
        assert sum(r["n_words"] for r in part) + part[0]["free"] == capacity
        sources = [r["source"] for r in part]
        assert len(set(sources)) == len(sources)
        at = 0
        for r in sorted(part, key=lambda r: (r["start"], r["n_words"])):
            assert r["start"] == at
            at += r["n_words"]


def test_edges(edge, edge_rows, clash, empty):
    for df in (edge, clash):
        got = packing.pack(df, mixing.word_count("text"), F.xxhash64("text"), capacity=256, block=20).collect()
        assert {r["doc_id"] for r in got} == {r[0] for r in edge_rows}
        check(edge_rows, got, 256)
    assert packing.pack(empty, mixing.word_count("text"), F.xxhash64("text")).collect() == []


def test_copies_never_share_a_bin(spark):
    rows = [(i, "same words here" if i < 30 else f"own {i}", "s%d" % i) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.word_count("text"), F.xxhash64("text"), capacity=100).collect()
    bins = [r["bin_id"] for r in got if r["doc_id"] < 30]
    assert len(set(bins)) == 30


def test_texts_of_bins(edge):
    unique = edge.where("doc_id IS NOT NULL AND doc_id <> 14")
    got = packing.pack(unique, mixing.word_count("text"), F.xxhash64("text"), capacity=256)
    bins = packing.bin_texts(unique, got).collect()
    assert sum(len(b["text"].split()) for b in bins) == unique.agg(F.sum(mixing.word_count("text"))).first()[0]
    assert all(len(b["text"].split()) == b["n_words"] <= 256 for b in bins)


def test_null_ids_leave_large_ids_alone(spark):
    big = (1 << 60) + 1
    rows = [(big, "a b c", "x"), (None, "d e", "y"), (big + 1, "f", "z")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.word_count("text"), F.xxhash64("text")).collect()
    assert {r["doc_id"] for r in got} == {big, big + 1, None}


def test_equal_rows_are_dealt_to_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "EQUAL", 64)
    rows = [(None, "the same words", None)] * 1000 + [(i, f"own {i}", "a") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, mixing.word_count("text"), F.xxhash64("text"), block=50).collect()
    blocks = defaultdict(int)
    for r in got:
        blocks[r["bin_id"] >> 32] += 1
    assert len(got) == 1010 and len(blocks) > 10 and max(blocks.values()) < 120
    check(rows, got, packing.CAPACITY)
    again = packing.pack(df.repartition(7), mixing.word_count("text"), F.xxhash64("text"), block=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_a_whole_packing_against_brute_force(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 300)), f"s{i % 7}") for i in range(120)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.word_count("text"), F.col("doc_id") % 50, capacity=256, block=1000).collect()
    pieces = sorted([(len(t.split()) % 256, i, s, i % 50) for i, t, s in rows if len(t.split()) % 256], key=lambda x: (-x[0], x[1]))
    full = sum(len(t.split()) // 256 for _, t, _ in rows)
    to, left = brute([p[0] for p in pieces], [p[2] for p in pieces], [p[3] for p in pieces], 256)
    assert len(got) == len(pieces) + full
    placed = {(r["doc_id"], r["start"], r["bin_id"] - full) for r in got if r["n_words"] < 256}
    assert placed == {(p[1], at, b) for p, (b, at) in zip(pieces, to)}
