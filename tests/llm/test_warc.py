import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from chronoloom.llm import warc as W


def brute(rows):
    last = {}
    for i, h in rows:
        p = (h or "").encode()
        if i is not None:
            last[p] = max(last.get(p, i), i)
    n = {}
    for i, h in rows:
        n[(h or "").encode()] = n.get((h or "").encode(), 0) + 1
    out = []
    for i, h in rows:
        p = (h or "").encode()
        again = n[p] > 1 and p in last and i != last[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", last[p] if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://cé", None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "u", "<p>same</p>"), (None, None, "alone"), (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (8, "u", "<p>same</p>"), (8, "u", "<p>same</p>")] + [(100 + i, f"http://h/{i}", f"<html><body>page {i} " + "text of the page " * (i % 30)) for i in range(200)]


def written(spark, path, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit("x"))
    W.write_archives(df.repartition(3), path, **more)
    return sorted([tuple(r) for r in W.read_archives(spark, path).drop("uri").collect()], key=str)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    assert written(spark, path, ROWS, archive_bytes=4000) == brute([(r[0], r[2]) for r in ROWS])
    assert spark.read.format("binaryFile").load(path).count() > 3  # several archives


def test_small_payloads_are_all_responses(spark, tmp_path):
    got = written(spark, str(tmp_path / "w"), ROWS, least=50)
    assert {r[3] for r in got} == {"response"}


def test_empty(spark, tmp_path):
    assert written(spark, str(tmp_path / "w"), []) == []


def test_digest_column(spark):
    values = ["", "a", "é" * 100]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(W.digest_column(F.col("t").cast("binary"))).collect()]
    assert got == [W.digest(v.encode()) for v in values]


def archive(records, dictionary=b"", packed=False):
    lead, known = b"", None
    if dictionary:
        known = zstandard.ZstdCompressionDict(dictionary)
        held = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        lead = struct.pack("<II", W.DICTIONARY_MAGIC, len(held)) + held
    coder = zstandard.ZstdCompressor(dict_data=known, write_checksum=True)
    return lead + b"".join(coder.compress(r) for r in records)


RECORDS = [W.make_record("response", "http://x", i, f"payload {i} ".encode() * 50, W.digest(b""), None) for i in range(60)]


def test_dictionary_raw_or_compressed():
    d = zstandard.train_dictionary(2048, RECORDS * 4).as_bytes()
    for packed in (False, True):
        got = list(W.read_archive(archive(RECORDS, d, packed)))
        assert [r["fields"]["warc-record-id"] for r in got] == [f"<urn:page:{i}>" for i in range(60)]


@pytest.mark.parametrize("harm", ["cut", "magic", "length", "digest", "dictionary", "header", "tail"])
def test_broken_archives_are_told(harm):
    d = zstandard.train_dictionary(2048, RECORDS * 4).as_bytes()
    good = archive(RECORDS[:3], d)
    bad = {
        "cut": good[:-7], "magic": good[:8 + len(d)] + b"XXXX" + good[12 + len(d) :], "length": archive([RECORDS[0].replace(b"Content-Length: ", b"Content-Length: 1", 1)]),
        "digest": archive([RECORDS[0].replace(b"payload 0 ", b"payload 1 ", 1)]), "dictionary": good[8 + len(d) :], "header": archive([b"HTTP/1.1 200 OK\r\n\r\n"]), "tail": good + b"abc",
    }[harm]
    with pytest.raises((W.ArchiveError, zstandard.ZstdError)):
        list(W.read_archive(bad))


def test_every_archive_has_its_dictionary(spark, tmp_path):
    for name, rows in (("few", [(1, "u", "one page")]), ("blank", [(1, "u", None)]), ("many", ROWS)):
        written(spark, str(tmp_path / name), rows, archive_bytes=4000)
        for r in spark.read.format("binaryFile").load(str(tmp_path / name)).collect():
            magic, size = struct.unpack("<II", r["content"][:8])
            assert magic == W.DICTIONARY_MAGIC and size > 0 and zstandard.ZstdCompressionDict(bytes(r["content"][8 : 8 + size])).dict_id() != 0


def test_payloads_behind_a_full_filter(spark, tmp_path, monkeypatch):
    """Where the bitmap takes every digest for repeated, the joins decide."""
    monkeypatch.setattr(W.Filter, "split", lambda self, df, column: (df, df.where("false")))
    assert written(spark, str(tmp_path / "w"), ROWS) == brute([(r[0], r[2]) for r in ROWS])
