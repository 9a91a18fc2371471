"""Streams whose rows come out of order, against folds over all rows in order."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from chronoloom.operators import recurrence
from chronoloom.streaming import operators as st
from chronoloom.streaming import stateful as sf

START = datetime(2024, 1, 1)
SCHEMA = "i long, key string, ts timestamp, step long, value double"


def made(seed, minutes=600, jitter=45):
    """Rows (place in the stream, key, ts, step, value) up to jitter minutes out of order; some are missing values, some share their time."""
    rng, rows = random.Random(seed), []
    for t in range(minutes):
        for key in "ab" if t % 3 else "abc":
            if rng.random() < 0.6:
                value = None if rng.random() < 0.1 else round(rng.gauss(5, 2), 6)
                rows.append((t + rng.uniform(0, jitter), key, START + timedelta(minutes=t - t % 2), t, value))
    rows.sort(key=lambda r: r[0])
    return [(i, *r[1:]) for i, r in enumerate(rows)]


def stream(spark, rows, path, batches):
    df = sf.closed(spark.createDataFrame(rows, SCHEMA), "ts", "2 DAYS")
    from pyspark.sql import functions as F

    return st.replay(df.withColumn("i", F.coalesce("i", F.lit(10**9))), f"{path}/in", batches, "i")


def in_order(rows, key):
    return [r for r in sorted(rows, key=lambda r: (r[2], r[3])) if r[1] == key]


@pytest.mark.parametrize("batches", [1, 6])
def test_running_frames(spark, tmp_path, batches):
    rows = made(1)
    out = st.drained(sf.running_frame(stream(spark, rows, tmp_path, batches), "key", late="1 hour"), f"{tmp_path}/out", "append").where("key IS NOT NULL").collect()
    got = {(r["key"], r["step"]): (r["center"], r["scale"]) for r in out}
    assert len(out) == len(rows) == len(got)
    for key in "abc":
        seen = []
        for r in in_order(rows, key):
            seen += [r[4]] if r[4] is not None else []
            mean = np.mean(seen) if seen else 0.0
            assert got[key, r[3]] == pytest.approx((mean, (np.std(seen) if seen else 0.0) + 1e-5 + 1e-6 * abs(mean)), abs=1e-8)


@pytest.mark.parametrize("idle", [None, 600])
def test_filters(spark, tmp_path, idle):
    rows = [r for r in made(2) if not 200 <= r[3] < 230]  # half an hour of silence
    poles = [[-0.5 + 1j, -0.1], [1, 0.5], [0.7, -0.2]]
    out = st.drained(sf.state_space(stream(spark, rows, tmp_path, 5), "key", *poles, dt=0.3, late="1 hour", slot=300, idle=idle), f"{tmp_path}/out", "append").where("key IS NOT NULL").collect()
    got = {(r["key"], r["step"]): r["y"] for r in out}
    assert len(out) == len(rows)
    for key in "abc":
        runs, mine = [], in_order(rows, key)
        for before, r in zip([None, *mine], mine):
            if before is None or idle and (r[2] - before[2]).total_seconds() > idle:
                runs.append([])
            runs[-1].append(r)
        assert len(runs) > 1 if idle else len(runs) == 1
        for run in runs:
            y = recurrence.s4d_steps(np.array([r[4] or 0.0 for r in run]), *(np.array(p, complex) for p in poles), 0.3)[0]
            assert [got[key, r[3]] for r in run] == pytest.approx(y.tolist())


def test_rows_later_than_the_watermark_are_dropped_and_nothing_else(spark, tmp_path):
    rows = [(i, "a", START + timedelta(minutes=i), i, 1.0) for i in range(300)]
    rows.insert(280, (0, "a", START, 999, 5.0))  # nearly five hours late
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    out = st.drained(sf.running_frame(stream(spark, rows, tmp_path, 6), "key", late="30 minutes"), f"{tmp_path}/out", "append").where("key IS NOT NULL").collect()
    assert sorted(r["step"] for r in out) == list(range(300)) and all(r["center"] == 1.0 for r in out)


def test_the_sessions_own_state_store_comes_back(spark):
    before = spark.conf.get(sf._PROVIDER, None)
    with sf.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(sf._PROVIDER)
    assert spark.conf.get(sf._PROVIDER, None) == before


def test_a_stream_without_rows(spark, tmp_path):
    empty = st.replay(sf.closed(spark.createDataFrame([], SCHEMA), "ts", "1 DAY"), f"{tmp_path}/in", 1, "i")
    assert st.drained(sf.running_frame(empty, "key"), f"{tmp_path}/out", "append").count() == 0


@pytest.mark.parametrize("idle", [None, 1200])
def test_many_keys_share_a_bucket_and_its_timers(spark, tmp_path, idle):
    """60 keys in two buckets, whose timers release several slots at once."""
    rng, rows = random.Random(3), []
    for t in range(0, 300, 5):
        for k in range(60):
            if rng.random() < 0.3:
                rows.append((t + rng.uniform(0, 30), f"k{k}", START + timedelta(minutes=t), 60 * t + k, round(rng.gauss(5, 2), 6)))
    rows = [(i, *r[1:]) for i, r in enumerate(sorted(rows, key=lambda r: r[0]))]
    poles = [[-0.5 + 1j, -0.1], [1, 0.5], [0.7, -0.2]]
    out = sf.state_space(stream(spark, rows, tmp_path, 3), "key", *poles, dt=0.3, late="1 hour", slot=600, idle=idle, buckets=2)
    got = {(r["key"], r["step"]): r["y"] for r in st.drained(out, f"{tmp_path}/out", "append").collect()}
    assert len(got) == len(rows)
    for key in {r[1] for r in rows}:
        runs, mine = [], in_order(rows, key)
        for before, r in zip([None, *mine], mine):
            if before is None or idle and (r[2] - before[2]).total_seconds() > idle:
                runs.append([])
            runs[-1].append(r)
        for run in runs:
            y = recurrence.s4d_steps(np.array([r[4] for r in run]), *(np.array(p, complex) for p in poles), 0.3)[0]
            assert [got[key, r[3]] for r in run] == pytest.approx(y.tolist())


@pytest.mark.parametrize("kind", ["frames", "filters"])
def test_a_key_that_is_cut_into_frames_is_in_order(spark, tmp_path, kind):
    """One micro-batch whose rows stand in reverse, in frames of three rows."""
    rows = [(k, t, float(t * t % 7)) for t in reversed(range(20)) for k in "ab"]
    spark.createDataFrame(rows, "key string, step long, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        read = spark.readStream.schema("key string, step long, value double").parquet(f"{tmp_path}/in")
        out = st.running_frame(read, "key") if kind == "frames" else st.state_space(read, "key", [-0.5], [1], [0.7], 0.3)
        got = {(r["key"], r["step"]): r["center" if kind == "frames" else "y"] for r in st.drained(out, f"{tmp_path}/out", "append").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    x = np.array([t * t % 7 for t in range(20)], float)
    want = np.cumsum(x) / np.arange(1, 21) if kind == "frames" else recurrence.s4d_steps(x, *(np.array([v], complex) for v in (-0.5, 1, 0.7)), 0.3)[0]
    for k in "ab":
        assert [got[k, t] for t in range(20)] == pytest.approx(want.tolist())
