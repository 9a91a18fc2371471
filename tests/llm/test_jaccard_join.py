import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import jaccard_join as J
from chronoloom.llm.components import components
from chronoloom.llm.textkit import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Rows are documents, whatever their ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b, (_, t) in enumerate(sets[:a]):
            if s and 100 * len(s & t) >= 80 * len(s | t):
                parent[find(a)] = find(b)
    smallest = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            smallest[find(a)] = min(smallest.get(find(a), i), i)
    return sorted([(i, len(s), smallest.get(find(a))) for a, (i, s) in enumerate(sets)], key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_equals_brute_force_on_edges(edge, edge_rows, clash):
    want = brute([(r[0], r[1]) for r in edge_rows])
    assert rows_of(J.near_duplicates(edge)) == want
    assert rows_of(J.near_duplicates(clash)) == want


def test_empty(empty):
    assert J.near_duplicates(empty).collect() == []


def test_equals_brute_force_with_near_copies_and_a_shared_passage(spark, monkeypatch):
    import random

    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    base = [f"b{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(60):  # near copies of one text, edited more and more
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(60, 160):  # texts of their own around a passage
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))]
        rows.append((i, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
    monkeypatch.setattr(J, "HOT_IN_ALL", 10)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert rows_of(got) == brute(rows)


def test_a_copy_without_an_id_does_not_hide_its_group(spark):
    text = " ".join(f"n{i}" for i in range(120))
    rows = [(None, text), (5, text), (7, text), (3, text + " more")]  # the last is of another size, so of another group
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert rows_of(got) == brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {None: 3, 3: 3, 5: 3, 7: 3}


def test_one_id_on_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(120)) for x in "ab")
    rows = [(5, a), (5, b), (2, a + " more"), (3, b + " more"), (5, a), (9, "quite another text of its own")]
    got = J.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (3, 3), (5, 2), (5, 2), (5, 3), (9, 9)]
    keys = {}
    for r in got:
        keys.setdefault(r["component"], []).append(r["component_id"])
    assert sorted(map(sorted, keys.values())) == [[2, 2, 2], [3, 3], [9]]


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    """Near copies around several texts, so that hubs of blocks, hubs of hubs and blocks two by two all come in."""
    import random

    monkeypatch.setattr(J, "HUB_BLOCK", 16)
    monkeypatch.setattr(J, "CROSS_BLOCK", 8)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(160):
        base = passage + [f"b{i % 4}_{j}" for j in range(12 + 9 * (i % 4))]
        for _ in range(rng.randrange(0, 3)):
            base[rng.randrange(len(base))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    monkeypatch.setattr(J, "HOT_IN_ALL", 10**9)  # nothing goes last: lists are as long as can be
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert rows_of(J.near_duplicates(df)) == want
    monkeypatch.setattr(J, "leads", lambda lists, longest, percent: (lists.selectExpr("g AS lead", "g").limit(0), []))  # without hubs all is left to the pairs of groups
    assert rows_of(J.near_duplicates(df)) == want


def test_a_chain_is_one_component(spark):
    words = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(60)]  # neighbours share 92 of 100 words
    got = {r["component_id"] for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=120), st.lists(st.integers(0, 200), min_size=1, max_size=120))
def test_bitmaps_never_rule_out_a_link(a, b):
    mix = lambda x: np.unique(np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    u, v = mix(a), mix(b)
    both = len(np.intersect1d(u, v))
    if 100 * both >= 80 * (len(u) + len(v) - both):
        assert J.may_link(len(u), J.parity(u), len(v), J.parity(v), 80)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), max_size=80), st.integers(1, 9), st.integers(2, 12))
def test_lists_with_several_groups_across_batches(rows, size, held):
    rows = sorted(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + size]], pa.int64()) for i in (0, 1, 1)], ["token", "g", "np"]) for k in range(0, len(rows), size)]
    before, J.HELD = J.HELD, held
    try:
        got = [x for b in J._several(batches) for x in zip(*(c.to_pylist() for c in b.columns))]
    finally:
        J.HELD = before
    distinct = sorted(set(rows))
    n = {t: sum(x == t for x, _ in distinct) for t, _ in distinct}
    assert [(t, g) for t, g, _, _ in got] == [(t, g) for t, g in distinct if n[t] > 1] and all(g == y for _, g, y, _ in got)
    assert all(s == n[t] or s == -1 and n[t] > held for t, _, _, s in got)  # a list that one batch holds is never too long


def test_lists_that_are_too_long_to_hold(spark, monkeypatch):
    monkeypatch.setattr(J, "HELD", 4)
    monkeypatch.setattr(J, "HOT_IN_ALL", 10**9)
    base = [f"b{j}" for j in range(60)]
    rows = [(i, " ".join(base[:30] + [f"e{i}"] + base[30:])) for i in range(40)]
    assert rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == brute(rows)


def test_shingles_are_words_not_bytes():
    a, b, c = shingle_sets([b"a b c d e f", b"a\x0bb\tc d\n e  f ", "é b c d e f".encode()], 5)
    assert (a == b).all() and len(a) == 2 and len(np.intersect1d(a, c)) == 1


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (5, 5), (20, 30), (30, 20), (2, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 20: 20, 30: 20}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rows_whose_keys_collide_keep_their_links(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(J, "row_key", lambda doc_id, own: F.lit(7).cast("long"))  # all rows have one key
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    rows = [(i, texts[i % 3] + " more" * (i // 3)) for i in range(9)] + [(4, texts[1] + " more")] * 2  # rows that repeat
    assert rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_large_groups_are_paired_by_blocks(spark, monkeypatch):
    """Many classes of one prefix and size, some of which link: they meet in blocks, and bitmaps leave few pairs."""
    import random

    monkeypatch.setattr(J, "WITHIN_BLOCK", 8)
    monkeypatch.setattr(J, "leads", lambda lists, longest, percent: (lists.selectExpr("g AS lead", "g").limit(0), []))
    rng = random.Random(4)
    sets = {}
    while len(sets) < 400:  # texts of seven shingles; those with the same first shingle in the order are a group
        w = [f"k{rng.randrange(3)}" for _ in range(11)]
        sets.setdefault(tuple(w), len(sets))
    rows = [(i, " ".join(w)) for w, i in sets.items()]
    assert rows_of(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
