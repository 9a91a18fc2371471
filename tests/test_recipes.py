"""Recipes of the public sources on tables of a few rows, archives, items."""

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import frequency as fr
from chronoloom.operators import artefact, forecast, items, sample
from chronoloom.sources import binary, recipes


def steps(df, *keys):
    return {tuple(r[k] for k in keys): [(x["step"], x["value"]) for x in sorted(r["p"], key=lambda x: x["step"])] for r in df.groupBy(*keys).agg(F.collect_list(F.struct("step", "value")).alias("p")).collect()}


def test_minute_counts(spark):
    rows = [("00f", d, *(d * 10_000 + m for m in range(1440))) for d in (1, 3)] + [("01f", 1, *([0] * 1440))]
    df = spark.createDataFrame(rows, ["hash", "day", *(str(m) for m in range(1, 1441))])
    got = steps(recipes.minute_counts_by_day(df, ["hash"], "day", 3, "hash"), "hash")
    assert list(got) == [("00f",)] and len(got["00f",]) == 3 * 1440
    assert got["00f",][5] == (5, 10_005.0) and got["00f",][1440] == (1440, None) and got["00f",][2880 + 7] == (2887, 30_007.0)


def test_columns(spark):
    df = spark.createDataFrame([("f", i, float(i), 1.0, "x") for i in range(30)], "file string, t long, a double, b double, c string")
    assert set(steps(recipes.varied_columns(df, "file", "t", ["a", "b"]), "file", "series")) == {("f", "a")}
    parts = recipes.train_then_test(df.where("t < 20"), df.where("t >= 20").withColumn("t", F.col("t") - 20), "file", "t", ["a"])
    assert [v for _, v in steps(parts, "series")["a",]] == [float(i) for i in range(30)]
    c = spark.createDataFrame([(i, [float(10 * i + j) for j in range(6)]) for i in range(2)], "cycle long, v array<double>")
    assert steps(recipes.cycles(c, "cycle", "v", 3), "series")["rig",] == [(0, 1.0), (1, 4.0), (2, 11.0), (3, 14.0)]


def test_statistics(spark):
    df = spark.createDataFrame([("a", "X", "2020-01-01", "1"), ("a", "X", "2020-03-01", "3 "), ("a", None, "2020-02-01", "9"), ("b", "X", "2020-01-01", None), ("a", "Y", "2020-01-01", "5")], "geo string, unit string, d string, v string").withColumn("d", F.to_date("d"))
    got = steps(recipes.by_dimensions(df, ["geo", "unit"], "d", "v", "M", {"unit": ["X"], "absent": ["z"]}), "geo", "unit")
    assert got == {("a", "X"): [(24241, 1.0), (24242, None), (24243, 3.0)]}
    w = spark.createDataFrame([("a", 2020, 53, 1.0), ("a", 2021, 2, 2.0)], "g string, y int, w int, v double")
    assert [v for _, v in steps(recipes.year_week(w, ["g"], "y", "w", "v"), "g")["a",]] == [1.0, None, 2.0]
    i = spark.createDataFrame([("c", "AA.1", 1.0, 2.0, None), ("c", "XX.1", 1.0, 2.0, 3.0), ("d", "AA.1", None, None, 1.0)], "c string, ind string, y0 double, y1 double, y2 double")
    assert set(steps(recipes.indicators(i, ["c"], "ind", ["y0", "y1", "y2"], ("XX",), 2, 5), "c", "ind")) == {("c", "AA.1")}


def test_stations(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 10, 3.0), ("s", 1900, -9999.0), ("s", 2700, 5.0), ("t", 0, 1.0)], "site string, sec long, v double")
    assert steps(recipes.gauges(df, "site", "sec", "v", 900, 1, spark.createDataFrame([("t",)], "site string"), (-9999.0,)), "site") == {("s",): [(0, 2.0), (1, None), (2, None), (3, 5.0)]}
    m = spark.createDataFrame([("1", "2", "88101", 5, "1.5"), ("1", "2", "88101", 5, "9"), ("1", "2", "88101", 7, "x"), ("1", "2", "61104", 5, "9")], "state string, site string, par string, h long, v string")
    got = steps(recipes.monitors(m.limit(1).union(m.where("h = 7 OR par = '61104'")), ["state", "site", "par"], "h", "v", "61104"), "series")
    assert got == {("1288101",): [(5, 1.5), (6, None), (7, None)]}
    p = spark.createDataFrame([("a", 300 * i, float(i)) for i in (0, 1, 2, 4)] + [("b", 420 * i, 1.0) for i in range(4)], "k string, s long, v double")
    assert steps(recipes.inferred_step(p, ["k"], "s", "v"), "k", "minutes") == {("a", 5): [(0, 0.0), (1, 1.0), (2, 2.0), (3, None), (4, 4.0)]}
    h = spark.createDataFrame([("x", "2020-01-01 00:00:00", 15.0), ("x", "2020-01-01 02:00:00", None), ("x", "2020-01-01 02:30:00", 30.0)], "st string, ts string, t double").withColumn("ts", F.to_timestamp("ts"))
    assert [v for _, v in steps(recipes.scaled_hours(h, "st", "ts", {"t": 10.0}), "st", "series")["x", "t"]] == [1.5, None, 3.0]


def test_energy_and_traffic(spark):
    e = spark.createDataFrame([("a", "M", "202001", "1"), ("a", "M", "202003", "w"), ("a", "M", "202004", "4"), ("y", "A", "2019", "7")], "s string, f string, d string, v string")
    assert steps(recipes.observations(e, "s", "f", "d", "v"), "s") == {("a",): [(24241, 1.0), (24242, None), (24243, None), (24244, 4.0)], ("y",): [(2019, 7.0)]}
    t = spark.createDataFrame([("r", 0, 1.0, 2.0), ("r", 0, 9.0, 9.0), ("r", 2, 5.0, None)], "road string, day long, h0 double, h1 double")
    assert [v for _, v in steps(recipes.hours_of_days(t, ["road"], "day", ["h0", "h1"]), "road")["r",]] == [1.0, 2.0, None, None, 5.0, None]
    g = spark.createDataFrame([("c", 1_000, 1.0, False), ("c", 1_000 + 600_000_000, 3.0, False), ("c", 5, 9.0, True)], "k string, t long, v double, bad boolean")
    assert steps(recipes.power_traces(g, ["k"], "t", "v", "bad"), "k") == {("c",): [(0, 1.0), (1, None), (2, 3.0)]}
    i = spark.createDataFrame([("f", 0)] * 3 + [("f", 2)] + [("g", 1)], "k string, m long")
    assert steps(recipes.invocations(i, ["k"], "m", 4), "k") == {("f",): [(0, 3.0), (1, 0.0), (2, 1.0)]}


def test_views_logs_and_machines(spark):
    v = spark.createDataFrame([("A", d, 1) for d in range(28) if d != 16] + [("File:x", d, 1) for d in range(28)], "t string, d long, n long")
    assert steps(recipes.page_views(v, "t", "d", "n"), "t") == {("A",): [(1, 7.0), (2, None)]}
    s = spark.createDataFrame([("a", i, float(i), i % 2) for i in range(20)], "k string, s long, v double, flag int")
    assert steps(recipes.good_means(s, ["k"], "s", "v", "flag"), "k") == {("a",): [(0, 4.0), (1, 14.0)]}
    c = spark.createDataFrame([("n", 2, 1.0, 2.0), ("n", 3, 3.0, 4.0)], "k string, o long, a double, b double")
    assert steps(recipes.by_ordinal(c, "k", "o", ["a", "b"]), "k", "series")["n", "b"] == [(0, None), (1, None), (2, 2.0), (3, 4.0)]
    b = spark.createDataFrame([("m", "op", r, i, 3.0 * (-1) ** i) for r in (0, 1) for i in range(5)], "m string, o string, r int, i long, v double")
    assert steps(recipes.vibration(b, "m", "o", "r", "i", "v", 2), "m", "o") == {("m", "op"): [(0, 3.0), (1, 3.0), (2, 3.0), (3, 3.0)]}
    w = spark.createDataFrame([("T1", 0, 1.0), ("T1", 20, 3.0)], "k string, minutes long, power double")
    assert steps(recipes.turbines(w, "k", "minutes", ["power"]), "k", "series") == {("T1", "power"): [(0, 1.0), (1, None), (2, 3.0)]}
    d = spark.createDataFrame([("a", 0, "1"), ("a", 7, "x"), ("a", 14, "3"), ("b", 0, "x")], "k string, d long, v string")
    assert steps(recipes.mostly_numeric(d, ["k"], "d", "v"), "k") == {("a",): [(0, 1.0), (1, None), (2, 3.0)]}


def test_archives(spark, tmp_path):
    body = b"a,b\n1,2\n"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/x.csv", body)
    with tarfile.open(tmp_path / "y.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y.csv")
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(body))
    (tmp_path / "w.csv.xz").write_bytes(lzma.compress(body))
    (tmp_path / "v.csv.bz2").write_bytes(bz2.compress(body))
    got = {(r["member"], r["line"]) for r in binary.archived_lines(spark, str(tmp_path)).where("line_no = 1").collect()}
    assert got == {(m, "1,2") for m in ("in/x.csv", "y.csv", "z.csv", "w.csv", "v.csv")}


def test_windows_of_items_stay_aligned(spark):
    members = spark.createDataFrame([(i, m, "a", 10 * i + m, 3 * m) for i in range(5) for m in range(3)], "item_id long, member_pos int, subset string, series_id long, shift long")
    points = spark.createDataFrame([("a", 10 * i + m, t, float(t + 3 * m)) for i in range(5) for m in range(3) for t in range(200)], "subset string, series_id long, step long, value double")
    lengths = points.groupBy("subset", "series_id").agg(F.count("*").alias("length"))
    rows = items.item_windows(members, points, lengths, 2, 16, 64, 8).collect()
    assert len(rows) == 5 * 8 and sum(r["valid"] for r in rows) == 15
    assert all(set(r["context"]) == {None} and len(r["target"]) == r["h"] for r in rows if not r["valid"])
    by = {}
    for r in (r for r in rows if r["valid"]):  # a value is its place on the common axis, so all members of an item show the same
        by.setdefault(r["item_id"], set()).add((tuple(r["context"]), tuple(r["target"])))
    assert all(len(v) == 1 for v in by.values())
    c, t = next(iter(by[0]))
    assert np.diff(np.array(c + t)) == pytest.approx(2.0)


def test_past_covariates_horizons_are_never_read(spark):
    rng = np.random.default_rng(0)
    rows = [(1, j, r, rng.normal(size=80).tolist(), rng.normal(size=12).tolist()) for j, r in enumerate((0, 1, 2))]
    schema = "item_id long, member_pos int, role int, context array<double>, target array<double>"

    def run(rows):
        return {r["member_pos"]: np.array(r["quantiles"]) for r in items.forecast_items(spark.createDataFrame(rows, schema), 12, 6).collect()}

    base = run(rows)
    assert list(base) == [0]
    past = [r if r[2] != 1 else (*r[:4], [9.0] * 12) for r in rows]
    own = [r if r[2] != 0 else (*r[:4], [9.0] * 12) for r in rows]
    ahead = [r if r[2] != 2 else (*r[:4], [9.0] * 12) for r in rows]
    assert run(past)[0] == pytest.approx(base[0]) and run(own)[0] == pytest.approx(base[0])
    assert not np.allclose(run(ahead)[0], base[0])


def test_models_and_heads(spark, tmp_path):
    r = np.random.default_rng(1)
    w = {"q": r.normal(size=(8, 8)), "k": r.normal(size=(8, 8)), "v": r.normal(size=(8, 8)), "up": r.normal(size=(8, 16)), "down": r.normal(size=(16, 4 * 9))}
    artefact.save_model(spark, str(tmp_path / "m"), w)
    again = artefact.load_model(spark, str(tmp_path / "m"), set(w))
    fan = forecast.quantile_head(r.normal(size=(10, 8)), r.normal(size=(3, 8)), again, 4)
    assert fan.shape == (12, 9) and (np.diff(fan, axis=1) >= 0).all()
    with pytest.raises(ValueError, match="missing"):
        artefact.load_model(spark, str(tmp_path / "m"), {*w, "bias"})


def test_scalars_and_draws(spark):
    assert fr.log_blocks(0) == [] and fr.log_blocks(100)[0] == 0 and fr.log_blocks(100)[-1] == 99 and len(fr.log_blocks(100)) <= 8
