"""Readers, writers and streams."""

import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import norm, recurrence
from chronoloom.sources import binary, corpus, text
from chronoloom.streaming import operators as st


def test_tsf(spark, tmp_path):
    (tmp_path / "a.tsf").write_text("# about\n@relation x\n@frequency daily\n@attribute name string\n@attribute start date\n@data\nT1:2020-01-01:1,2,?,4.5\n# no\nT2:2020-01-01:7\nbroken\n")
    rows = text.tsf(spark, str(tmp_path / "a.tsf")).orderBy("series_id").collect()
    assert [(r["series_id"], r["values"]) for r in rows] == [("T1", [1.0, 2.0, None, 4.5]), ("T2", [7.0])]
    assert rows[0]["metadata"]["frequency"] == "daily" and rows[0]["metadata"]["attribute"] == "name string; start date"


def test_station_texts(spark, tmp_path):
    (tmp_path / "010010").write_text("2020 01 01 00   -12 -9999 10130   250    51     2 -9999 -9999\n2020 01 01 06    15    10 -9999   -9999    40 0 0 0\n")
    r = text.isd_lite(spark, str(tmp_path / "010010")).orderBy("ts").collect()
    assert [(x["temperature"], x["dew"], x["pressure"], x["wind_dir"], x["wind"]) for x in r] == [(-1.2, None, 1013.0, 250.0, 5.1), (1.5, 1.0, None, None, 4.0)]
    (tmp_path / "buoy.txt").write_text("#YY MM DD hh mm WDIR WSPD GST WVHT\n#yr mo dy hr mn degT m/s m/s m\n2020 01 01 00 10 120 5.1 6.0 99.00\nYY MM DD hh mm WDIR WSPD GST WVHT\n2020 01 01 01 10 999 99.0 7.0 1.2\n")
    r = text.ndbc(spark, str(tmp_path / "buoy.txt")).orderBy("ts").collect()
    assert [(x["wind_dir"], x["wind"], x["gust"], x["height"]) for x in r] == [(120.0, 5.1, 6.0, None), (None, None, 7.0, 1.2)]
    (tmp_path / "site.rdb").write_text("# c\nagency_cd\tsite_no\tdatetime\ttz\t00060\n5s\t15s\t20d\t6s\t14n\nUSGS\t01\t2020-01-01 00:15\tEST\t12.5\nUSGS\t01\t2020-01-01 00:30\tEST\tIce\n")
    assert [r["value"] for r in text.rdb(spark, str(tmp_path / "site.rdb")).orderBy("ts").collect()] == [12.5, None]


def test_csv_json_and_preamble(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# made by\n# Date and time,Power\n2020-01-01 00:00:00,5.5\n2020-01-01 00:10:00,\n")
    assert [r["p"] for r in text.after_preamble(spark, str(tmp_path / "s.csv"), "# Date and time", "t STRING, p DOUBLE").collect()] == [5.5, None]
    (tmp_path / "c.csv").write_text("a;b\n1;?\n2;3.5\n")
    assert [r["b"] for r in text.csv(spark, str(tmp_path / "c.csv"), "a INT, b DOUBLE", ";").orderBy("a").collect()] == [None, 3.5]
    (tmp_path / "e.json").write_text('{"series_id":"x","f":"M","data":[["202001","5"],["202002",null],["202003","w"]]}\n')
    assert [r["value"] for r in text.ndjson_series(spark, str(tmp_path / "e.json")).orderBy("date").collect()] == [5.0, None, None]


def test_results(spark, tmp_path):
    (tmp_path / "off.csv").write_text("dataset,model,eval_metrics/MASE[0.5],eval_metrics/mean_weighted_sum_quantile_loss,domain,num_variates\na/H/short,m,0.5,0.4,Energy,7.0\nb/D/short,m,0.6,0.3,,\n")
    assert [(r["config"], r["MASE"], r["CRPS"], r["domain"], r["num_variates"]) for r in text.official_results(spark, str(tmp_path / "off.csv")).orderBy("config").collect()] == [("a/H/short", 0.5, 0.4, "Energy", 7), ("b/D/short", 0.6, 0.3, "", 1)]
    (tmp_path / "run").mkdir()
    (tmp_path / "run/a.json").write_text('{"config":"a/H/short","prediction_length":48,"model":{"MASE":0.7,"CRPS":0.4,"coverage":{"0.1":0.12,"0.9":0.88}},"ratein":{"frac_k_gt1":0.5}}')
    (tmp_path / "run/b.json").write_text('{"config":"b/D/short","model":{"MASE":null}}')
    got = {r["config"]: r for r in text.run_results(spark, str(tmp_path / "run")).collect()}
    assert (got["a/H/short"]["q10"], got["a/H/short"]["q90"], got["a/H/short"]["frac_k_gt1"]) == (0.12, 0.88, 0.5)
    assert got["b/D/short"]["MASE"] is None and got["b/D/short"]["prediction_length"] == 0
    (tmp_path / "m.txt").write_text("# x\nSolar_Power 12\n\nabc\n")
    assert {r["stem"] for r in text.stems(spark, str(tmp_path / "m.txt")).collect()} == {"solar_power", "abc"}


def test_binary_formats(spark, tmp_path):
    sink = io.BytesIO()
    schema = pa.schema([("freq", pa.string()), ("target", pa.list_(pa.float32()))])
    with pa.ipc.new_stream(sink, schema) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(["H", "H"]), pa.array([[1, 2], [3]], pa.list_(pa.float32()))], schema=schema))
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(["D"]), pa.array([[4]], pa.list_(pa.float32()))], schema=schema))
    (tmp_path / "x.arrow").write_bytes(sink.getvalue())
    rows = binary.arrow_series(spark, str(tmp_path / "x.arrow")).orderBy("batch", "row").collect()
    assert [(r["freq"], r["variate"], r["values"]) for r in rows] == [("H", 0, [1, 2]), ("H", 0, [3]), ("H", 0, [4])]
    np.save(tmp_path / "g.npy", np.arange(6).reshape(2, 3))
    assert [(r["channel"], r["values"]) for r in binary.npy_grids(spark, str(tmp_path / "g.npy")).orderBy("channel").collect()] == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    (tmp_path / "c").mkdir()
    np.save(tmp_path / "c/s.values.npy", np.arange(7, dtype=np.float32))
    np.save(tmp_path / "c/s.offsets.npy", np.array([0, 3, 3, 7]))
    assert [(r["subset"], r["series_id"], r["values"]) for r in binary.csr_series(spark, str(tmp_path / "c")).orderBy("series_id").collect()] == [("s", 0, [0, 1, 2]), ("s", 1, []), ("s", 2, [3, 4, 5, 6])]


def test_corpus(spark, tmp_path):
    inf, path = float("inf"), str(tmp_path / "corpus")
    s = spark.createDataFrame([("a", 0, [None] + [float(i) for i in range(20)]), ("a", 1, [1.0] * 20), ("a", 2, [float(i) for i in range(9)]), ("b", 0, [inf] + [float(i) for i in range(20)])], "subset string, series_id long, values array<float>")
    assert sorted((r["subset"], r["series_id"], len(r["values"])) for r in corpus.keepable(s).collect()) == [("a", 0, 20), ("b", 0, 20)]
    assert {r["subset"] for r in corpus.keepable(s, drop_infinite=True).collect()} == {"a"}
    assert corpus.keepable(s, drop_constant=False).count() == 3
    corpus.write(corpus.keepable(s), path)
    corpus.write(s.where("subset = 'b'"), path)  # replaces b alone
    assert corpus.read(spark, path).count() == 2 and corpus.read(spark, path, ["a"]).count() == 1
    m = corpus.manifest_of(s.where("subset = 'a'"))
    assert [(r["n_series"], r["n_obs"], r["median_length"]) for r in m.collect()] == [(3, 50, 20)]
    with pytest.raises(ValueError, match="more than one"):
        corpus.merge([m, m])
    t = spark.createDataFrame([("d", i, [float(n)]) for i, n in enumerate((5, 7, 3, 4))], "subset string, series_id long, values array<float>")
    kept = corpus.drop_series(t, t.where("series_id IN (1, 3)")).orderBy("series_id").collect()
    assert [(r["series_id"], r["values"]) for r in kept] == [(0, [5.0]), (1, [3.0])] and t.count() == 4
    names = spark.createDataFrame([("x/kit-00000-of-00002.arrow",), ("x/kit-00013-of-00020.arrow",), ("y/part-00013-of-00020.arrow",), ("z/a-00001-of-00002.arrow",), ("z/a.json",)], "p string")
    assert [r[0] for r in names.where(corpus.wanted_shard(F.col("p"), ("z",), ("x",))).collect()] == ["x/kit-00000-of-00002.arrow", "y/part-00013-of-00020.arrow"]


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_windowed_means_equal_the_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    stream = st.replay(e, str(tmp_path / "in"), 4, "ts")
    got = drained(st.windowed_mean(stream, ["event_type"], "6 hours", late="1 hour"), tmp_path, "w")
    want = e.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    last = got.agg(F.max("start")).first()[0]
    a = {(r["event_type"], r["start"]): (round(r["value"], 9), r["n"]) for r in got.collect()}
    b = {(r["event_type"], r["w"]["start"]): (round(r["v"], 9), r["n"]) for r in want.where(F.col("w.start") <= F.lit(last)).collect()}
    assert a and a == {k: b[k] for k in a} and len(b) - len(a) < 10


def test_sessions_and_late_rows(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 2, 20, 21, 50)] + [("v", "2024-01-01 03:00:00", 1.0), ("u", "2024-01-01 00:01:00", 1.0), ("v", "2024-01-01 06:00:00", 1.0)]
    df = spark.createDataFrame([(i, k, t, v) for i, (k, t, v) in enumerate(rows)], "i int, k string, t string, value double").select("i", "k", F.to_timestamp("t").alias("ts"), "value")
    stream = st.replay(df, str(tmp_path / "in"), 8, "i")
    got = sorted((r["k"], r["n"]) for r in drained(st.sessions(stream, ["k"], "5 minutes"), tmp_path, "s").collect())
    assert got == [("u", 1), ("u", 2), ("u", 2), ("v", 1)]  # the row that came three hours late is lost


def test_running_frame_and_filter_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = {k: rng.normal(5, 2, 40) for k in (1, 2)}
    df = spark.createDataFrame([(k, i, float(v)) for i in range(40) for k, v in ((k, x[k][i]) for k in x)], "series long, step long, value double")
    stream = st.replay(df, str(tmp_path / "in"), 5, "step")
    got = drained(st.running_frame(stream, "series"), tmp_path, "f")
    want = norm.causal_frame(df, ["series"], 1)
    j = got.join(want.select("series", F.col("token").alias("step"), F.col("center").alias("c"), F.col("scale").alias("s")), ["series", "step"]).collect()
    assert len(j) == 80 and all(r["center"] == pytest.approx(r["c"]) and r["scale"] == pytest.approx(r["s"], abs=1e-9) for r in j)
    poles = [[-0.5 + 1j, -0.1], [1, 0.5], [0.7, -0.2]]
    y = drained(st.state_space(stream, "series", *poles, dt=0.3), tmp_path, "y").orderBy("series", "step").collect()
    for k in x:
        assert [r["y"] for r in y if r["series"] == k] == pytest.approx(recurrence.s4d_steps(x[k], *(np.array(p, complex) for p in poles), 0.3)[0].tolist())


def test_appended_batches_are_there_once(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i) for i in range(9)], "k long, v long")
    stream = st.replay(df, str(tmp_path / "in"), 3, "v")
    for _ in range(2):
        q = st.append_once(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["k", "v"]).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_upsert_merges_by_key(spark, tmp_path):
    rows = [(i % 4, i, f"v{i}") for i in range(20)] + [(9, 20, "only"), (1, 5, "late")]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "i long, k long, t long, v string")
    stream = st.replay(df, str(tmp_path / "in"), 4, "i").select("k", "t", "v")
    want = {}
    for k, t, v in rows:
        want[k] = max(want.get(k, (t, v)), (t, v))
    for turn in range(2):  # the second time from the beginning, over the table that is there
        q = st.upsert(stream, str(tmp_path / "out"), str(tmp_path / f"ck{turn}"), ["k"], "t", 3).start()
        q.processAllAvailable()
        q.stop()
        got = st.upserted(spark, str(tmp_path / "out"), stream.schema).collect()
        assert sorted((r["k"], r["t"], r["v"]) for r in got) == sorted((k, *x) for k, x in want.items())
