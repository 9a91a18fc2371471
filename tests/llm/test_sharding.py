import zlib

from pyspark.sql import functions as F

from chronoloom.llm import sharding as S


def check(rows, got, shards):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows) == sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_edges(edge, edge_rows, clash, empty):
    check([(r[0], r[1]) for r in edge_rows], S.shard(edge, 5).collect(), 5)
    check([(r[0], r[1]) for r in edge_rows], S.shard(clash, 5).collect(), 5)
    assert S.shard(empty, 5).collect() == []


def test_equal_sizes_with_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLES", 2)  # poor splitters: ranges are subdivided
    rows = [(i, "the same text" * 20 if i % 3 else f"text {i} " * (i % 40)) for i in range(6000)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    sums = check(rows, got, 24)
    total, largest = sum(sums.values()), max(r["size"] for r in got)
    assert len(sums) == 24 and all(abs(v - total / 24) <= largest for v in sums.values())
    hot = sorted(r["shard"] for r in got if r["doc_id"] % 3)
    assert len(set(hot)) <= len(hot) * 268 / (total / 24) + 2  # side by side


def test_order_is_the_exact_one(spark):
    """Brute force: records end to end by (hash of the text, id), cut by the middle byte."""
    rows = [(i, f"t{i % 50}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = sorted([(r["h"], r["doc_id"], len(r["text"]) + 8) for r in df.withColumn("h", F.xxhash64("text")).collect()])
    total, upto, want = sum(r[2] for r in ordered), 0, {}
    for h, i, n in ordered:
        upto += n
        want[i] = min(6, (upto - -(-n // 2)) * 7 // total)
    assert {r["doc_id"]: r["shard"] for r in S.shard(df, 7).collect()} == want


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    S.write_shards(df, S.shard(df, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_write_beside_columns_of_the_same_names(spark, tmp_path):
    rows = [(i, f"text {i}", "x", 7, 8) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long, range int")
    places = S.shard(df, 4)
    S.write_shards(df, places, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["text"], r["shard"], r["slot"], r["range"]) for r in got.collect()} == {(r["doc_id"], f"text {r['doc_id']}", r["shard"], 7, 8) for r in places.collect()}


def test_equal_rows_are_cut_too(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLES", 4)
    rows = [(None, "the same text" * 20)] * 4000 + [(i, f"text {i} " * (i % 40)) for i in range(2000)] + [(2001, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.shard(df, 24).collect()
    sums = check(rows, got, 24)
    total, largest = sum(sums.values()), 100_008
    assert all(v <= total / 24 + largest for v in sums.values())
    sizes = {}
    for r in got:
        sizes[r["range"]] = sizes.get(r["range"], 0) + (r["doc_id"] is None)
    assert max(sizes.values()) <= 400  # of 4000 equal rows


def test_range_of_columns():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = rng.integers(0, 4, (500, 3))
    cuts = sorted({tuple(x) for x in rng.integers(0, 4, (20, 3)).tolist()})
    got = S._range_of(list(keys.T), [np.array(c) for c in zip(*cuts)])
    assert got.tolist() == [sum(c <= tuple(k) for c in cuts) for k in keys.tolist()]
