"""Sources that read byte ranges, against files written by numpy, pyarrow and the standard library."""

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.sources import ranges as R


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 64)  # 16 values
    monkeypatch.setattr(R, "LINES", 3)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): [None if v is None else round(v, 5) for v in r["values"]] for r in df.collect()}


@pytest.mark.parametrize("size", [40, 200, 1 << 20])
@pytest.mark.parametrize("order", ["C", "F"])
def test_npy(spark, tmp_path, size, order):
    x = np.asarray(np.random.default_rng(1).normal(size=(5, 37)), dtype="float64", order=order)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "one.npy", np.arange(9, dtype="int32"))
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    pieces = R.npy_pieces(spark, str(tmp_path), partitionBytes=size)
    if size == 40:
        assert pieces.rdd.getNumPartitions() > 10  # one file, many tasks
    got = rows(R.whole(pieces, ["path", "channel"]), "path", "channel")
    want = {(str(tmp_path / "a.npy"), i): [round(float(np.float32(v)), 5) for v in x[i]] for i in range(5)} | {(str(tmp_path / "one.npy"), 0): list(range(9))}
    assert got == want
    pts = {(r["channel"], r["step"]): round(r["value"], 5) for r in R.points(pieces.where(f"path = '{tmp_path}/a.npy'"), ["channel"]).collect()}
    assert pts == {(i, t): round(float(np.float32(x[i, t])), 5) for i in range(5) for t in range(37)}


@pytest.mark.parametrize("size", [8, 100, 1 << 20])
def test_csr(spark, tmp_path, size):
    lengths = {"a": [0, 3, 0, 0, 50, 1, 0], "b": [0, 0], "c": [17], "d": []}
    want = {}
    for name, ns in lengths.items():
        values = [np.random.default_rng(len(name) + i).normal(size=n).astype("float32") for i, n in enumerate(ns)]
        np.save(tmp_path / f"{name}.values.npy", np.concatenate([np.zeros(0, "float32"), *values]))
        np.save(tmp_path / f"{name}.offsets.npy", np.append(0, np.cumsum(ns)).astype("int64"))
        want |= {(name, i): [round(float(v), 5) for v in x] for i, x in enumerate(values)}
    pieces = R.csr_pieces(spark, str(tmp_path), partitionBytes=size)
    assert rows(R.whole(pieces, ["subset", "series_id"]), "subset", "series_id") == want
    assert {tuple(r) for r in R.csr_lengths(spark, str(tmp_path), partitionBytes=size).collect()} == {(*k, len(v)) for k, v in want.items()}


def test_only_the_files_that_are_asked_for_are_planned(spark, tmp_path):
    for name in "abc":
        np.save(tmp_path / f"{name}.values.npy", np.arange(40, dtype="float32"))
        np.save(tmp_path / f"{name}.offsets.npy", np.array([0, 10, 40]))
    one = R.csr_pieces(spark, str(tmp_path), partitionBytes=1 << 20).where("subset = 'b'")
    assert one.rdd.getNumPartitions() == 1 and {r["subset"] for r in one.collect()} == {"b"}
    two = R.csr_pieces(spark, str(tmp_path), partitionBytes=1 << 20, only="a,c")
    assert two.rdd.getNumPartitions() == 2 and {r["subset"] for r in two.collect()} == {"a", "c"}
    assert {r["subset"] for r in R.csr_pieces(spark, str(tmp_path)).where("subset IN ('a', 'b') AND series_id = 1").collect()} == {"a", "b"}


def test_csr_round_trip(spark, tmp_path):
    series = spark.createDataFrame([("x", 0, [1.0, None, 3.0]), ("x", 1, []), ("y", 0, [2.5] * 100)], "subset string, series_id long, values array<float>")
    assert R.write_csr(series, str(tmp_path / "c")) == 4
    got = rows(R.whole(R.csr_pieces(spark, f"file://{tmp_path}/c", partitionBytes=50), ["subset", "series_id"]), "subset", "series_id")
    assert str(got["x", 0]) == "[1.0, nan, 3.0]" and got["x", 1] == [] and got["y", 0] == [2.5] * 100


def test_damaged_arrays_are_refused(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="plain numbers"):
        R.npy_pieces(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFound|does not exist|missing"):
        R.npy_pieces(spark, str(tmp_path / "missing")).collect()


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_arrow(spark, tmp_path, size):
    want = set()
    for name, nested, n in (("flat", False, 23), ("items", True, 10), ("empty", False, 0)):
        kind = pa.list_(pa.list_(pa.float64())) if nested else pa.list_(pa.float32())
        target = [[[float(i), float(j)] for j in range(i % 4)] if nested else [float(i)] * (i % 5) for i in range(n)]
        schema = pa.schema([("freq", pa.dictionary(pa.int32(), pa.string())), ("target", kind)])
        with pa.OSFile(str(tmp_path / f"{name}.arrow"), "wb") as f, pa.ipc.new_stream(f, schema) as w:
            for lo in range(0, n, 4):
                part = target[lo : lo + 4]
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(["H"] * len(part)).dictionary_encode(), pa.array(part, kind)], schema=schema))
        for i, t in enumerate(target):
            want |= {(f"{tmp_path}/{name}.arrow", i // 4, i % 4, "H", nested, v, tuple(x)) for v, x in enumerate(t if nested else [t])}
    df = R.arrow_rows(spark, str(tmp_path), partitionBytes=size)
    got = [(*r[:6], tuple(r[6])) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    assert df.rdd.getNumPartitions() == (9 if size == 1 else 2)


TEXT = "a,b\r\n1,é\n\nlast without end"


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_archives(spark, tmp_path, size):
    raw, lines = TEXT.encode("utf-8") + b"\n\xff", ["a,b", "1,é", "", "last without end", "�"]
    names = ["m1.txt", "dir/m2.csv", "m3.txt"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.writestr(n, raw)
        z.writestr("none.txt", b"")
    for mode, name in (("w", "t.tar"), ("w:gz", "t.tar.gz"), ("w:xz", "t.tar.xz"), ("w:bz2", "t.tar.bz2"), ("w:gz", "t.tgz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size = len(raw)
                t.addfile(info, io.BytesIO(raw))
    for end, pack in ((".gz", gzip.compress), (".xz", lzma.compress), (".bz2", bz2.compress), ("", bytes)):
        (tmp_path / f"plain.csv{end}").write_bytes(pack(raw))
    df = R.archived_lines(spark, str(tmp_path), partitionBytes=size)
    got = {}
    for r in df.collect():
        got.setdefault((r["path"].rsplit("/", 1)[-1], r["member"]), {})[r["line_no"]] = r["line"]
    assert set(got) == {(a, n) for a in ("z.zip", "t.tar", "t.tar.gz", "t.tar.xz", "t.tar.bz2", "t.tgz") for n in names} | {(f"plain.csv{e}", "plain.csv") for e in (".gz", ".xz", ".bz2", "")}
    assert all([found[i] for i in range(len(found))] == lines for found in got.values())
    if size == 1:
        assert df.where(f"path = '{tmp_path}/z.zip'").rdd.getNumPartitions() == 4


def test_members_are_unpacked_as_a_stream(tmp_path):
    """64 MB of a member pass through a reader that never holds more than a few chunks."""
    import tracemalloc

    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.txt", "w") as m:
        for i in range(1024):
            m.write(b"x" * 65535 + b"\n")
    reader = R.ArchiveReader({"path": str(tmp_path)})
    tracemalloc.start()
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1024 and peak < 8 << 20


def test_many_small_files_are_few_tasks_and_the_driver_opens_none(spark, tmp_path, monkeypatch):
    """600 arrays of several ranges each; a task reads the ranges of many files."""
    want = {}
    for i in range(600):
        x = np.arange(i % 5 * 3, dtype="float32") + i
        np.save(tmp_path / f"s{i}.values.npy", x)
        np.save(tmp_path / f"s{i}.offsets.npy", np.arange(0, len(x) + 1, 3))
        want |= {(f"s{i}", k): x[3 * k : 3 * k + 3].tolist() for k in range(len(x) // 3)}
    reader, opens = R.CsrReader({"path": str(tmp_path), "partitionBytes": "8"}), []
    with monkeypatch.context() as m:
        m.setattr(R.Npy, "read", lambda path: opens.append(path))
        assert len(reader.partitions()) <= 2 * R.APART and not opens
    pieces = R.csr_pieces(spark, str(tmp_path), partitionBytes=8)
    assert rows(R.whole(pieces, ["subset", "series_id"]), "subset", "series_id") == want
    for name in "ab":
        np.save(tmp_path / f"{name}.npy", np.arange(3000.0 * (name == "a") + 10))
    assert R.npy_pieces(spark, f"{tmp_path}/a.npy", partitionBytes=8).rdd.getNumPartitions() <= 2 * R.APART
    assert rows(R.whole(R.npy_pieces(spark, f"{tmp_path}/a.npy", partitionBytes=8), ["channel"]), "channel") == {(0,): list(range(3010))}
