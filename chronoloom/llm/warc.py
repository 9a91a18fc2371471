"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are cut by size and written by Spark's text sink, so they go wherever Spark can write, with its commit protocol: an archive is one row of bytes (the sink
writes a string's bytes as they are), and the line end that the sink adds falls into a closing skippable frame. They are read by the binaryFile source, an
archive a row. Which records are revisits follows from a narrow table of ids and digests; payloads are compressed where they lie.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, forget, modest_batches, small, spill, uniform

#: Magic of the skippable frame that holds the dictionary, and of the closing one (fixed values of the format).
DICTIONARY_MAGIC, CLOSING_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: Compressed bytes after which an archive ends (it exceeds them by a record at most).
ARCHIVE_BYTES = 8 << 20
#: Records from which the dictionary is trained (about), characters of each payload's drawn passage, and the dictionary's size. Bounds of a training sample.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 200, 20_000, 64 << 10
#: Records without a payload that are trained on besides, so that there is a dictionary however few the pages are.
BARE_RECORDS = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHEN = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_column(payload):
    """The same in SQL: four groups of 40 bits of the SHA-1, each as eight digits of 5 bits."""
    h = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def make_record(kind: str, uri: str, page_id: int | None, payload: bytes, payload_digest: str, refers_to: int | None, length: int | None = None) -> bytes:
    """A response or revisit record. Both hold the HTTP header with the payload's length (given where the payload isn't); a revisit leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {WHEN}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields and block of one record; its header, lengths and block digest must be right."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not mark or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("a record doesn't begin with a WARC header")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ArchiveError(f"a header line without a colon: {line[:80]!r}")
        fields[name.decode().strip().lower()] = value.decode().strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ArchiveError(f"a record without {name}")
    if not fields["content-length"].isdigit():
        raise ArchiveError("a content length that is no number")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"a block of {len(rest) - 4} bytes where the header says {length}")
    if (said := fields.get("warc-block-digest", "").removeprefix("sha1:")) and said != digest(block):
        raise ArchiveError("a block whose digest is another")
    return {"fields": fields, "block": block}


def _frame_end(data: memoryview, at: int) -> tuple[int, int]:
    """End and dictionary id of the Zstandard frame at a place, from its header and block headers."""
    try:
        flags = data[at + 4]
        single, at_dict = flags >> 5 & 1, at + 5 + (not flags >> 5 & 1)
        n = (0, 1, 2, 4)[flags & 3]
        dict_id = int.from_bytes(data[at_dict : at_dict + n], "little")
        place = at_dict + n + ((single, 2, 4, 8)[flags >> 6])
        while True:
            head = int.from_bytes(data[place : place + 3], "little")
            kind, size = head >> 1 & 3, head >> 3
            if kind == 3 or place + 3 > len(data):
                raise ArchiveError("a broken block header")
            place += 3 + (1 if kind == 1 else size)
            if head & 1:
                break
        place += 4 * (flags >> 2 & 1)
    except IndexError:
        raise ArchiveError("a frame is cut off") from None
    if place > len(data):
        raise ArchiveError("a frame is cut off")
    return place, dict_id


def read_archive(data: bytes):
    """The records of an archive, one for each frame. The dictionary comes from the leading skippable frame (itself compressed or not)."""
    view, at, decoder, own_id = memoryview(data), 0, zstandard.ZstdDecompressor(), 0
    while at < len(view):
        if len(view) - at < 8:
            raise ArchiveError("bytes after the last frame")
        magic, size = struct.unpack("<II", view[at : at + 8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise ArchiveError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                held = bytes(view[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                known = zstandard.ZstdCompressionDict(held)
                decoder, own_id = zstandard.ZstdDecompressor(dict_data=known), known.dict_id()
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ArchiveError(f"no frame at byte {at}")
        end, dict_id = _frame_end(view, at)
        if dict_id and dict_id != own_id:
            raise ArchiveError(f"a frame needs dictionary {dict_id}; the archive has {own_id}")
        frame = bytes(view[at:end])
        size = zstandard.frame_content_size(frame)
        raw = decoder.decompressobj().decompress(frame)
        if size >= 0 and len(raw) != size:
            raise ArchiveError(f"a frame of {len(raw)} bytes where its header says {size}")
        yield parse_record(raw)
        at = end


def train_dictionary(pages: DataFrame, page_id: str, html: str) -> bytes:
    """A dictionary from about SAMPLE_ROWS pages, chosen by a hash of their ids, a passage of each at a place drawn by the same hash, and from bare records. It
    changes the archives' size only."""
    share = SAMPLE_ROWS / max(pages.count(), 1)
    start = (F.floor(uniform(page_id, seed=5) * F.greatest(F.char_length(html) - SAMPLE_CHARS + 1, F.lit(1))) + 1).cast("int")
    picked = pages.where((uniform(page_id, seed=4) < share) & (F.length(html) > 0)).select(F.substr(F.col(html), start, F.lit(SAMPLE_CHARS)).alias("t"))
    bodies = sorted(r["t"].encode() for r in picked.limit(2 * SAMPLE_ROWS).collect())
    bare = [make_record("revisit" if i % 2 else "response", f"http://host{i}.example/", 7919 * i, b"", digest(b"%d" % i), 31 * i if i % 2 else None) for i in range(BARE_RECORDS)]
    samples = bare + [make_record("response", "http://www.example/", i, t, digest(t), None) for i, t in enumerate(bodies)]
    return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", uri: str = "url", html: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record per row of pages into archives under path, each with the dictionary in front.

    The payload is html in UTF-8 (null: empty; very long ones are one record). Of the records with equal payloads of at least least bytes, that with the largest
    page_id is a response and the others revisit it; smaller ones are all responses. Rows that tie for the largest are all responses; null ids count as the
    smallest. A null uri is written as an empty one; other columns are ignored; no rows give no archive. Ids and digests alone are shuffled: payloads that occur
    once are compressed in place, revisits need no payload, and only the one response of each repeated payload moves.
    """
    modest_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", digest_column("payload"))
    narrow = spill(rows.select("page_id", "uri", "digest", F.length("payload").cast("long").alias("n")), "digests")
    known = narrow.where(F.col("n") >= least).groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("last")).where("copies > 1")
    known = spill(known.select("digest", "last"), "known")
    again = Filter(known, "digest")  # of fixed size; what it takes for repeated, though it isn't, is decided by the join below
    told = again.split(narrow, "digest")[0].join(small(known.withColumnRenamed("digest", "d")), F.col("digest") == F.col("d"), "left")
    told = told.withColumn("again", F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")))
    told = spill(told.select("page_id", "uri", "digest", "n", "last", "again"), "told")
    first = spill(told.where("NOT again").select(F.xxhash64("digest", "page_id").alias("key"), F.col("digest").alias("d"), F.col("page_id").alias("id")).distinct(), "first")
    may_be_first = Filter(first, "key")

    none = F.lit(None).cast("long")
    repeated, alone = again.split(rows, "digest")
    moved = may_be_first.split(repeated.withColumn("own", F.xxhash64("digest", "page_id")), "own")[0]
    moved = moved.join(first, (F.col("own") == F.col("key")) & (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("id")), "left_semi")
    columns = ["page_id", "uri", "payload", "digest"]
    responses = alone.select(*columns).union(moved.select(*columns)).select(*columns, F.length("payload").cast("long").alias("n"), none.alias("last"), F.lit(False).alias("again"))
    revisits = told.where("again").select("page_id", "uri", F.lit(b"").alias("payload"), "digest", "n", "last", "again")
    sent = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages, page_id, html))
    closing = struct.pack("<II", CLOSING_MAGIC, 1)  # its one byte is the line end

    def run(batches):
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(sent.value)) + sent.value
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(sent.value), write_content_size=True, write_checksum=True)
        frames, total = [lead], 0
        for b in batches:
            for i in range(b.num_rows):
                id_, uri_, body, dig, n, last, revisit = (b.column(c)[i].as_py() for c in ("page_id", "uri", "payload", "digest", "n", "last", "again"))
                frames.append(coder.compress(make_record("revisit" if revisit else "response", uri_, id_, body, dig, last, n)))
                total += len(frames[-1])
                if total >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join([*frames, closing])])], ["archive"])
                    frames, total = [lead], 0
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([*frames, closing])])], ["archive"])

    out = responses.union(revisits).mapInArrow(run, "archive binary")
    out.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    forget(narrow, known, told, first, again.words, may_be_first.words)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, uri, payload_bytes, payload_digest, record_type, refers_to of each record under path. Lengths and digests of payloads are checked against the bytes."""

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = []
                for r in read_archive(content.as_py()):
                    f = r["fields"]
                    http, _, payload = r["block"].partition(b"\r\n\r\n")
                    said = next(int(x[15:]) for x in http.decode().lower().split("\r\n") if x.startswith("content-length:"))
                    dig = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and (len(payload) != said or digest(payload) != dig):
                        raise ArchiveError(f"{f['warc-record-id']}: its payload isn't the one that was written")
                    own, refers = (x[len("<urn:page:") : -1] for x in (f["warc-record-id"], f.get("warc-refers-to", "<urn:page:>")))
                    rows.append((int(own) if own else None, f.get("warc-target-uri"), said, dig, f["warc-type"], int(refers) if refers else None))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long")
