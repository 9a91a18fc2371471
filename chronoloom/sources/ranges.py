"""Binary files read by byte ranges: Spark data sources for .npy arrays, arrays of values with offsets, Arrow streams and archives.

The driver reads headers only and plans partitions of about partitionBytes; a task opens its file at its own range, so one large file is read by many tasks, and
what a task holds at once is bounded by CHUNK. Where there are many ranges, a task reads several; of many files only the large ones are opened by the driver, the others are cut in the task. Paths may be folders or files of any store that pyarrow.fs knows (file:, hdfs:, s3:, gs:) or a local path that all
executors see. The option only (names with commas between) leaves other files out before anything is planned; so do
equalities on the file's name or subset where Spark pushes them down.

    register(spark)
    spark.read.format("csr").load("s3://bucket/corpus").where("subset = 'long_h'")
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

#: Bytes that a partition reads and that a task holds at once, and lines of a text in a batch.
PARTITION, CHUNK, LINES = 64 << 20, 8 << 20, 10_000
#: Partitions up to which each range is one of its own and the driver reads every file's header; beyond, ranges and small files go together. What opening a file weighs, in bytes.
APART, OPENING = 256, 1 << 14


def _store(path: str):
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return pa.fs.LocalFileSystem(), path


@contextmanager
def opened(path: str):
    """A file for random access."""
    store, at = _store(path)
    with store.open_input_file(at) as f:
        yield f


def files_below(path: str, ends: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder whose names end so and don't begin with a dot or underscore, in order."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(pa.fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(ends) and not f.base_name.startswith((".", "_")))


def _near(path: str, at: str) -> str:
    """The store's own path of a file, as a path like the one that was asked for."""
    if "://" not in path or path.startswith("file:"):
        return at
    scheme, _, rest = path.partition("://")
    _, root = _store(path)
    host = rest.removesuffix(root) if rest.endswith(root) and rest != root else ""
    return f"{scheme}://{host}{at}"


@dataclass
class Slice(InputPartition):
    path: str
    lo: int
    hi: int
    more: tuple = ()


@dataclass
class Bundle(InputPartition):
    """Ranges, and files (path, bytes) that are still to be cut."""

    units: tuple


class Ranged(DataSourceReader):
    """A reader over files below a path. named is the column that equalities are pushed on."""

    ends: tuple[str, ...] = ()
    named = "path"

    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("partitionBytes", PARTITION))
        self.only: set[str] | None = set(options["only"].split(",")) if options.get("only") else None

    def name_of(self, path: str) -> str:
        return path

    def files(self) -> list[tuple[str, int]]:
        found = [(_near(self.path, p), size) for p, size in files_below(self.path, self.ends)]
        return [(p, size) for p, size in found if self.only is None or self.name_of(p) in self.only]

    def cut(self, path: str, size: int) -> Iterator[Slice]:
        """The ranges of a file."""
        raise NotImplementedError

    def read_range(self, part: Slice) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def partitions(self):
        files = self.files()
        share = min(max(sum(size + OPENING for _, size in files) // APART, self.bytes), max(self.bytes, PARTITION))
        units: list[tuple[int, tuple]] = []
        for path, size in files:
            if len(files) > APART and size <= share:
                units.append((size + OPENING, (path, size)))
            else:
                parts = list(self.cut(path, size))
                units += [(max(size // len(parts), 1), p) for p in parts]
        if len(units) <= APART:
            return [p if isinstance(p, Slice) else Bundle((p,)) for _, p in units]
        out, group, taken = [], [], 0
        for weight, unit in units:
            if taken and taken + weight > share:
                out.append(Bundle(tuple(group)))
                group, taken = [], 0
            group.append(unit)
            taken += weight
        return [*out, Bundle(tuple(group))]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        for unit in part.units if isinstance(part, Bundle) else (part,):
            for one in (unit,) if isinstance(unit, Slice) else self.cut(*unit):
                yield from self.read_range(one)


class Pushing:
    """Equalities on a reader's name column leave files out. Spark asks for them if spark.sql.python.filterPushdown.enabled is true, and refuses such a reader if it isn't."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.named,):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f


# .npy


@dataclass
class Npy:
    """What a header says: where the data begin, and their type and shape."""

    start: int
    dtype: str
    shape: tuple[int, ...]
    fortran: bool

    @classmethod
    def read(cls, path: str) -> Npy:
        with opened(path) as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if dtype.hasobject or dtype.fields:
                raise ValueError(f"{path} doesn't hold plain numbers")
            return cls(f.tell(), dtype.str, shape, fortran and len(shape) > 1)

    @property
    def width(self) -> int:
        return np.dtype(self.dtype).itemsize

    def values(self, f, lo: int, hi: int) -> np.ndarray:
        """The numbers lo to hi (exclusive) of the file."""
        f.seek(self.start + lo * self.width)
        return np.frombuffer(f.read((hi - lo) * self.width), self.dtype)


class NpyReader(Ranged):
    """Pieces of channels. An array in C order is cut along its numbers, one in Fortran order along its steps."""

    ends = (".npy",)

    def cut(self, path: str, size: int) -> Iterator[Slice]:
        h = Npy.read(path)
        rows, steps = (1, *h.shape)[-2:] if h.shape else (1, 1)
        if len(h.shape) > 2:
            raise ValueError(f"{path} has more than two dimensions")
        total, unit = (steps, rows) if h.fortran else (rows * steps, 1)
        per = max(1, self.bytes // (h.width * unit))
        for lo in range(0, total, per):
            yield Slice(path, lo, min(lo + per, total), (h, rows, steps))

    def read_range(self, part: Slice) -> Iterator[pa.RecordBatch]:
        h, rows, steps = part.more
        with opened(part.path) as f:
            if h.fortran:
                per = max(1, CHUNK // (h.width * rows))
                for lo in range(part.lo, part.hi, per):
                    hi = min(lo + per, part.hi)
                    block = h.values(f, lo * rows, hi * rows).reshape(hi - lo, rows).T
                    yield _pieces([part.path] * rows, list(range(rows)), [lo] * rows, [steps] * rows, block)
                return
            lo = part.lo
            while lo < part.hi:
                channels, starts, values, taken = [], [], [], 0
                while lo < part.hi and taken < CHUNK // h.width:  # whole channels as far as they fit
                    hi = min(part.hi, (lo // steps + 1) * steps, lo + CHUNK // h.width)
                    channels.append(lo // steps)
                    starts.append(lo % steps)
                    values.append((lo, hi))
                    taken, lo = taken + hi - lo, hi
                x = h.values(f, values[0][0], lo)
                yield _pieces([part.path] * len(starts), channels, starts, [steps] * len(starts), [x[a - values[0][0] : b - values[0][0]] for a, b in values])


def _pieces(names, channels, starts, totals, values, kinds=("path", "channel"), id_type=pa.int32()) -> pa.RecordBatch:
    flat = np.concatenate([np.asarray(v, np.float32) for v in values]) if len(values) else np.zeros(0, np.float32)
    offsets = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(channels, id_type), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), lists], [*kinds, "start", "length", "values"])


class PushingNpy(Pushing, NpyReader):
    pass


class NpySource(DataSource):
    """path, channel, start, length, values: pieces of a channel of length steps, from start on."""

    @classmethod
    def name(cls):
        return "npy_ranges"

    def schema(self):
        return "path string, channel int, start long, length long, values array<float>"

    def reader(self, schema: StructType):
        return (PushingNpy if self.options.get("pushdown") == "true" else NpyReader)(self.options)


# values and offsets


class CsrReader(Ranged):
    """Series of <subset>.values.npy, whose bounds stand in <subset>.offsets.npy. A partition is a range of the values; where its first series begins is looked up by bisection in the offsets, so that
    a long series is cut and many short ones are together. Empty series belong to the range in which they lie."""

    ends, named = (".values.npy",), "subset"

    def __init__(self, options: dict):
        super().__init__(options)
        self.values = str(options.get("values", "true")).lower() != "false"

    def name_of(self, path: str) -> str:
        return path.rsplit("/", 1)[-1].removesuffix(".values.npy")

    def cut(self, path: str, size: int) -> Iterator[Slice]:
        offsets = path.removesuffix(".values.npy") + ".offsets.npy"
        h, o = Npy.read(path), Npy.read(offsets)
        if len(h.shape) != 1 or len(o.shape) != 1 or not o.shape[0]:
            raise ValueError(f"{path} and its offsets aren't arrays of one dimension")
        per, total = max(1, self.bytes // h.width), h.shape[0]
        for lo in range(0, max(total, 1), per):
            yield Slice(path, lo, min(lo + per, total), (h, o, offsets, lo + per >= total))

    def read_range(self, part: Slice) -> Iterator[pa.RecordBatch]:
        h, o, offsets, last = part.more
        name, n = self.name_of(part.path), o.shape[0] - 1
        with opened(part.path) as f, opened(offsets) as g:

            def first(at: int) -> int:
                """The first series that ends after at, or begins there."""
                lo, hi = 0, n
                while lo < hi:
                    mid = (lo + hi) // 2
                    begin, end = o.values(g, mid, mid + 2).astype(np.int64).tolist()
                    lo, hi = (lo, mid) if end > at or begin >= at else (mid + 1, hi)
                return lo

            i = first(part.lo)
            while i < n:
                bounds = o.values(g, i, min(i + 4096, n) + 1).astype(np.int64)
                ids, starts, lengths, ranges, taken = [], [], [], [], 0
                for k in range(len(bounds) - 1):
                    begin, end = int(bounds[k]), int(bounds[k + 1])
                    if begin >= part.hi and not (last and begin == end):
                        i = n
                        break
                    lo, hi = max(begin, part.lo), min(end, part.hi)
                    for a in range(lo, max(hi, lo + 1), CHUNK // h.width):
                        b = min(hi, a + CHUNK // h.width)
                        if taken and taken + b - a > CHUNK // h.width:
                            yield self._batch(f, h, name, ids, starts, lengths, ranges)
                            ids, starts, lengths, ranges, taken = [], [], [], [], 0
                        for out, x in ((ids, i), (starts, a - begin), (lengths, end - begin), (ranges, (a, b))):
                            out.append(x)
                        taken += b - a
                    i += 1
                if ids:
                    yield self._batch(f, h, name, ids, starts, lengths, ranges)

    def _batch(self, f, h: Npy, name: str, ids, starts, lengths, ranges) -> pa.RecordBatch:
        if self.values:
            lo = ranges[0][0]
            x = h.values(f, lo, max(ranges[-1][1], lo))
            values = [x[a - lo : b - lo] for a, b in ranges]
        else:
            values = [[]] * len(ids)
        return _pieces([name] * len(ids), ids, starts, lengths, values, ("subset", "series_id"), pa.int64())


class PushingCsr(Pushing, CsrReader):
    pass


class CsrSource(DataSource):
    """subset, series_id, start, length, values: pieces of a series of length values, from start on. With the option values = false the values aren't read."""

    @classmethod
    def name(cls):
        return "csr"

    def schema(self):
        return "subset string, series_id long, start long, length long, values array<float>"

    def reader(self, schema: StructType):
        return (PushingCsr if self.options.get("pushdown") == "true" else CsrReader)(self.options)


# Arrow streams


def _messages(f) -> Iterator[tuple[int, int, int]]:
    """(kind, offset, bytes) of each message of an Arrow stream, bodies passed over. Kind 1 is the schema, 2 a dictionary, 3 a batch."""
    size = f.size()
    at = 0
    while at + 8 <= size:
        f.seek(at)
        mark, length = struct.unpack("<II", f.read(8))
        head = 8
        if mark != 0xFFFFFFFF:  # streams before version 0.15 have no mark
            length, head = mark, 4
        if not length:
            return
        f.seek(at + head)
        meta = f.read(length)
        root = struct.unpack_from("<I", meta)[0]
        vtable = root - struct.unpack_from("<i", meta, root)[0]
        slots = struct.unpack_from("<H", meta, vtable)[0] // 2 - 2
        field = lambda i: struct.unpack_from("<H", meta, vtable + 4 + 2 * i)[0] if i < slots else 0
        kind = meta[root + field(1)] if field(1) else 0
        body = struct.unpack_from("<q", meta, root + field(3))[0] if field(3) else 0
        yield kind, at, head + length + body
        at += head + length + body


class ArrowReader(Ranged):
    """Batches of Arrow streams with a target list column (and freq); a task reads the schema, dictionaries, the first batch's freq and its own batches."""

    ends = (".arrow",)

    def cut(self, path: str, size: int) -> Iterator[Slice]:
        with opened(path) as f:
            found = list(_messages(f))
        shared = tuple(m[1:] for m in found if m[0] in (1, 2))
        batches = [m[1:] for m in found if m[0] == 3]
        lo = taken = 0
        for i, (_, width) in enumerate(batches):
            if taken and taken + width > self.bytes:
                yield Slice(path, lo, i, (shared, tuple(batches[lo:i]), batches[0]))
                lo, taken = i, 0
            taken += width
        if batches:
            yield Slice(path, lo, len(batches), (shared, tuple(batches[lo:]), batches[0]))

    def read_range(self, part: Slice) -> Iterator[pa.RecordBatch]:
        shared, batches, first = part.more
        with opened(part.path) as f:

            def take(pieces) -> pa.RecordBatch:
                out = []
                for at, size in pieces:
                    f.seek(at)
                    out.append(f.read(size))
                return pa.ipc.open_stream(pa.py_buffer(b"".join(out))).read_next_batch()

            head = take([*shared, first])
            freq = head.column("freq")[0].as_py() if "freq" in head.schema.names and head.num_rows else None
            for i, piece in enumerate(batches, part.lo):
                b = take([*shared, piece])
                target = b.column("target")
                nested = pa.types.is_list(target.type.value_type)
                row, variate = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
                if nested:
                    n = target.value_lengths().to_numpy()
                    row, variate = np.repeat(row, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    target = target.flatten()
                k = len(row)
                for lo in range(0, k, 1000):
                    m = min(1000, k - lo)
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * m), pa.array([i] * m, pa.int64()), pa.array(row[lo : lo + m], pa.int64()), pa.array([freq] * m, pa.string()), pa.array([nested] * m), pa.array(variate[lo : lo + m].astype(np.int32)), target.slice(lo, m).cast(pa.list_(pa.float32()))], ["path", "batch", "row", "freq", "nested", "variate", "values"])


class PushingArrow(Pushing, ArrowReader):
    pass


class ArrowSource(DataSource):
    """path, batch, row, freq, nested, variate, values; a target of lists (nested) gives a row per variate."""

    @classmethod
    def name(cls):
        return "arrow_ranges"

    def schema(self):
        return "path string, batch long, row long, freq string, nested boolean, variate int, values array<float>"

    def reader(self, schema: StructType):
        return (PushingArrow if self.options.get("pushdown") == "true" else ArrowReader)(self.options)


# archives


def _gunzip(f):
    return gzip.GzipFile(fileobj=f)


_PACKED = {".gz": _gunzip, ".tgz": _gunzip, ".xz": lzma.LZMAFile, ".bz2": bz2.BZ2File}


class _Window(io.RawIOBase):
    """A range of a file as a file of its own."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.end = f, at, at + size

    def readable(self):
        return True

    def readinto(self, b):
        self.f.seek(self.at)
        got = self.f.read(min(len(b), self.end - self.at))
        b[: len(got)] = got
        self.at += len(got)
        return len(got)


class ArchiveReader(Ranged):
    """Lines of the text files in archives. Members of a zip or tar file are planned from its directory or headers and dealt to tasks by their packed bytes; compressed tar
    files and single compressed files are one task each. All are unpacked as a stream: a member may be larger than a task's memory."""

    ends = (".zip", ".tar", *_PACKED, ".txt", ".csv", ".tsv")

    def cut(self, path: str, size: int) -> Iterator[Slice]:
        if path.lower().endswith(".zip"):
            with opened(path) as f, zipfile.ZipFile(f) as z:
                members = [(m.filename, None, m.compress_size) for m in z.infolist() if not m.is_dir()]
        elif path.lower().endswith(".tar"):
            with opened(path) as f, tarfile.open(fileobj=f, mode="r:") as t:
                members = [(m.name, m.offset_data, m.size) for m in t if m.isfile()]
        else:
            yield Slice(path, 0, size)
            return
        group, taken = [], 0
        for m in members:
            if taken and taken + m[2] > self.bytes:
                yield Slice(path, 0, taken, tuple(group))
                group, taken = [], 0
            group.append(m)
            taken += m[2]
        if group:
            yield Slice(path, 0, taken, tuple(group))

    def _streams(self, part: Slice) -> Iterator[tuple[str, object]]:
        lower, base = part.path.lower(), part.path.rsplit("/", 1)[-1]
        with opened(part.path) as f:
            if lower.endswith(".zip"):
                with zipfile.ZipFile(f) as z:
                    for name, _, _ in part.more:
                        with z.open(name) as member:
                            yield name, member
            elif lower.endswith(".tar"):
                for name, at, size in part.more:
                    yield name, io.BufferedReader(_Window(f, at, size))
            else:
                end = next((e for e in _PACKED if lower.endswith(e)), None)
                data = _PACKED[end](f) if end else f
                if end and (end == ".tgz" or lower.removesuffix(end).endswith(".tar")):
                    with tarfile.open(fileobj=data, mode="r|") as t:
                        for m in t:
                            if m.isfile():
                                yield m.name, t.extractfile(m)
                else:
                    yield base[: -len(end)] if end else base, data

    def read_range(self, part: Slice) -> Iterator[pa.RecordBatch]:
        for member, data in self._streams(part):
            lines, first, size = [], 0, 0
            for line in _lines(data):
                lines.append(line)
                size += len(line)
                if len(lines) == LINES or size > CHUNK:
                    yield self._batch(part.path, member, first, lines)
                    lines, first, size = [], first + len(lines), 0
            if lines:
                yield self._batch(part.path, member, first, lines)

    @staticmethod
    def _batch(path: str, member: str, first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([member] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], ["path", "member", "line_no", "line"])


def _lines(data) -> Iterator[str]:
    """A stream's lines, without their ends (\\n, \\r\\n or \\r); what isn't UTF-8 is replaced."""
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("replace"), translate=True)
    rest, more = "", True
    while more:
        chunk = data.read(min(CHUNK, 1 << 20))
        more = bool(chunk)
        *lines, rest = (rest + decoder.decode(chunk, final=not more)).split("\n")
        yield from lines
    if rest:
        yield rest


class PushingArchive(Pushing, ArchiveReader):
    pass


class ArchiveSource(DataSource):
    """path, member, line_no, line of the text files in zip, tar, gz, xz and bz2 archives, and of plain ones."""

    @classmethod
    def name(cls):
        return "archived_text"

    def schema(self):
        return "path string, member string, line_no long, line string"

    def reader(self, schema: StructType):
        return (PushingArchive if self.options.get("pushdown") == "true" else ArchiveReader)(self.options)


def register(spark: SparkSession) -> None:
    for source in (NpySource, CsrSource, ArrowSource, ArchiveSource):
        spark.dataSource.register(source)


def _load(spark: SparkSession, kind: type[DataSource], path: str, **options) -> DataFrame:
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(kind.name()).options(pushdown=pushdown, **options).load(path)


def whole(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, values: pieces put together. What is in one piece already isn't shuffled."""
    one = pieces.where(F.size("values") == F.col("length")).select(*keys, "values")
    cut = pieces.where(F.size("values") != F.col("length")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "values"))).alias("p"))
    return one.unionByName(cut.select(*keys, F.flatten(F.transform("p", lambda p: p["values"])).alias("values")))


def points(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, value of pieces, without putting them together."""
    return pieces.select(*keys, "start", F.posexplode("values").alias("at", "value")).select(*keys, (F.col("start") + F.col("at")).alias("step"), "value")


def npy_pieces(spark: SparkSession, path: str, **options) -> DataFrame:
    return _load(spark, NpySource, path, **options)


def csr_pieces(spark: SparkSession, path: str, **options) -> DataFrame:
    return _load(spark, CsrSource, path, **options)


def csr_lengths(spark: SparkSession, path: str, **options) -> DataFrame:
    """subset, series_id, length, from the offsets alone."""
    return _load(spark, CsrSource, path, values="false", **options).where("start = 0").select("subset", "series_id", "length")


def arrow_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    return _load(spark, ArrowSource, path, **options)


def archived_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    return _load(spark, ArchiveSource, path, **options)


# writers


def write_files(rows: DataFrame, path: str, by: list[str], make) -> int:
    """Writes the files that make(table of a group) returns as (name, bytes) below path, one group of equal by a task; returns their number. A repeated task writes the same files again."""

    def run(part: pa.Table) -> pa.Table:
        store, root = _store(path)
        names = []
        for name, content in make(part):
            store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(content)
            names.append(name)
        return pa.table([pa.array(names, pa.string())], names=["name"])

    return rows.groupBy(*by).applyInArrow(run, "name string").count()


def npy_bytes(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


def write_csr(series: DataFrame, path: str) -> int:
    """series (subset, series_id from 0 without gaps, values) as <subset>.values.npy and <subset>.offsets.npy; subsets are what fits a task. Missing values become NaN."""

    def make(part: pa.Table):
        part = part.sort_by("series_id")
        values = part.column("values").combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        name = part.column("subset")[0].as_py()
        yield f"{name}.values.npy", npy_bytes(flat)
        yield f"{name}.offsets.npy", npy_bytes(np.append(0, np.cumsum(values.value_lengths().to_numpy())).astype(np.int64))

    return write_files(series.select("subset", "series_id", "values"), path, ["subset"], make)
