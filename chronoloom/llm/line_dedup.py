"""Line dedup: a sharded minimal perfect hash over the distinct line hashes indexes fingerprint and count arrays, which documents probe.

Lines are hashed once where they lie (128 bits) and written as narrow probes. An aggregation with partial sums counts the distinct hashes; they are dealt to
shards by their first bits, and one task builds a shard's arrays: a cascade of bit arrays, and in order of rank the fingerprints, the counts (saturated), and the
keepers of what is counted often enough. Probes go to their shard's arrays in groups of bounded size, a shard that many probes want being copied to as many
groups, and read counts there. Nothing per line comes to the driver or is broadcast. Only documents that lose a line meet the answers in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Filter, forget, modest_batches, no_clash, spill
from .textkit import release

#: Keys in a shard at most on average, shards at most (beyond, shards grow: about 10 bytes a key), and probes in a group on average. A group has at least twice as
#: many probes as its shard has keys, so that the copies of a shard's arrays are no more than the probes that ask for them.
SHARD_KEYS, MOST_SHARDS, PROBES = 1 << 15, 1 << 20, 1 << 16
_BLANK = b" \t\n\x0b\x0c\r"
_U = np.uint64


def _level(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """The hash that level of the cascade uses, of all 128 bits."""
    h = (h1 + _U(0x9E3779B97F4A7C15) * np.asarray(level + 1, _U)) * _U(0xBF58476D1CE4E5B9)
    h = ((h ^ (h >> _U(29))) + h2) * _U(0x94D049BB133111EB)
    h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct hashes -> bit arrays (64-bit words) of the levels, and the hashes' order by rank. A hash's bit stands at the first level where no other of the
    rest falls on its place; its rank is the number of bits before."""
    levels, order, left = [], [], np.arange(len(h1))
    while len(left):
        words = -(-2 * len(left) // 64)
        place = _level(h1[left], h2[left], len(levels)) % _U(words * 64)
        value, first, n = np.unique(place, return_index=True, return_counts=True)
        alone = n == 1
        bits = np.zeros(words, _U)
        np.bitwise_or.at(bits, (value[alone] >> _U(6)).astype(np.int64), _U(1) << (value[alone] & _U(63)))
        levels.append(bits)
        order.append(left[first[alone]])
        rest = np.ones(len(left), bool)
        rest[first[alone]] = False
        left = left[rest]
    return levels, np.concatenate(order) if order else np.zeros(0, np.int64)


class Shard:
    """The arrays of a shard: bits by level, fingerprints of 32 bits, counts up to 255, and the ranks and keepers of the keys that are counted often enough."""

    FIELDS = "sizes binary, bits binary, prints binary, counts binary, often binary, keepers binary"

    @staticmethod
    def make(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, keeper: np.ndarray, listed: np.ndarray) -> list[bytes]:
        """listed: which keys get a keeper."""
        levels, order = build(h1, h2)
        often = np.flatnonzero(listed[order])
        parts = (np.array([len(x) for x in levels], np.int64), np.concatenate(levels) if levels else np.zeros(0, _U), (h2[order] >> _U(32)).astype(np.uint32), np.minimum(n[order], 255).astype(np.uint8), often, keeper[order][often].astype(np.int64))
        return [x.tobytes() for x in parts]

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, often: bytes, keepers: bytes):
        self.sizes, self.bits, self.prints = np.frombuffer(sizes, np.int64), np.frombuffer(bits, _U), np.frombuffer(prints, np.uint32)
        self.counts, self.often, self.keepers = np.frombuffer(counts, np.uint8), np.frombuffer(often, np.int64), np.frombuffer(keepers, np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.before = np.zeros(len(self.bits) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.bits), out=self.before[1:])

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Rank of each hash, -1 if its fingerprint isn't there."""
        out, left = np.full(len(h1), -1), np.arange(len(h1))
        for level, (size, start) in enumerate(zip(self.sizes, self.start)):
            place = _level(h1[left], h2[left], level) % _U(size * 64)
            word, bit = start + (place >> _U(6)).astype(np.int64), place & _U(63)
            hit = (self.bits[word] >> bit) & _U(1) == 1
            rank = self.before[word[hit]] + np.bitwise_count(self.bits[word[hit]] & ((_U(1) << bit[hit]) - _U(1)))
            same = self.prints[rank] == (h2[left[hit]] >> _U(32)).astype(np.uint32)
            out[left[hit][same]] = rank[same]
            left = left[~hit]
        return out

    def kept_by(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ranks have a keeper, and it."""
        if not len(self.often):
            return np.zeros(len(rank), bool), np.zeros(len(rank), np.int64)
        at = np.minimum(np.searchsorted(self.often, rank), len(self.often) - 1)
        return self.often[at] == rank, self.keepers[at]


def split(text: str | None, min_chars: int) -> tuple[list[bytes], list[int], bytes]:
    """A text's lines, the places of those whose key is long enough, and those keys' hashes."""
    raw = (text or "").encode()
    lines, at, hashes = raw.split(b"\n"), [], []
    for i, k in enumerate(raw.lower().split(b"\n")):
        if len(k) >= min_chars and len(k := k.strip(_BLANK)) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars):
            at.append(i)
            hashes.append(xxhash.xxh3_128_digest(k))
    return lines, at, b"".join(hashes)


def probes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """h1, h2 of the distinct keys of each document, with its doc_id and a hash of its text."""

    def run(batches):
        for b in batches:
            found, n = [], []
            for t in b.column(2).to_pylist():
                h = split(t, min_chars)[2]
                h = {h[i : i + 16] for i in range(0, len(h), 16)}
                found.append(b"".join(sorted(h)))
                n.append(len(h))
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            own = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), b.column(0).take(own), b.column(1).take(own)], ["h1", "h2", "doc_id", "own"])
        release()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), text).mapInArrow(run, "h1 long, h2 long, doc_id long, own long")


def index(keys: DataFrame, most: int, min_docs: int) -> tuple[DataFrame, int]:
    """keys (h1, h2, n, keeper): distinct hashes, most at most -> shard, its numbers of probes and keys, and its arrays (see Shard); and the number of shards, which the first
    bits of h1 tell."""
    shards = 1
    while shards * SHARD_KEYS < most and shards < MOST_SHARDS:
        shards *= 2

    def run(part: pa.Table) -> pa.Table:
        h1, h2, n = (part.column(c).to_numpy() for c in ("h1", "h2", "n"))
        keeper = part.column("keeper")
        listed = (n >= min_docs) & keeper.is_valid().to_numpy()
        arrays = Shard.make(h1.view(_U), h2.view(_U), n, keeper.fill_null(0).to_numpy(), listed)
        return pa.table([[part.column("shard")[0].as_py()], [int(n.sum())], [len(n)], *([x] for x in arrays)], names=["shard", "probes", "keys", *(f.split()[0] for f in Shard.FIELDS.split(", "))])

    return keys.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(run, f"shard long, probes long, keys long, {Shard.FIELDS}"), shards


def shard_of(shards: int):
    return F.lit(0).cast("long") if shards == 1 else F.shiftrightunsigned("h1", 64 - shards.bit_length() + 1)


def copied(shards: DataFrame) -> DataFrame:
    """shard, copies: the groups in which a shard is probed."""
    group = F.greatest(F.lit(PROBES), 2 * F.col("keys"))
    return shards.select("shard", F.ceil(F.greatest(F.col("probes"), F.lit(1)) / group).cast("int").alias("copies"))


def losses(asked: DataFrame, shards: DataFrame, n: int, min_docs: int) -> DataFrame:
    """asked (probes) -> h1, h2, doc_id, own of the lines that go, by the counts and keepers in the shards' arrays (n shards)."""
    copies = F.broadcast(copied(shards))  # MOST_SHARDS rows at most
    arrays = shards.join(copies, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = asked.withColumn("shard", shard_of(n)).join(copies, "shard").withColumn("salt", F.pmod(F.xxhash64("h2", "doc_id", "own"), F.col("copies")).cast("int"))
    names = [f.split()[0] for f in Shard.FIELDS.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(["h1", "h2", "doc_id", "own"])
        if not len(left) or not len(right):
            return out.slice(0, 0)
        s = Shard(*(right.column(c)[0].as_py() for c in names))
        rank = s.find(*(left.column(c).to_numpy().view(_U) for c in ("h1", "h2")))
        kept, keeper = s.kept_by(rank)
        ids = left.column("doc_id")
        mine = (ids.fill_null(0).to_numpy() == keeper) & ids.is_valid().to_numpy()
        return out.filter(pa.array((rank >= 0) & (s.counts[rank] >= min(min_docs, 255)) & kept & ~mine))

    dealt = dealt.select("shard", "salt", "h1", "h2", "doc_id", "own")
    return dealt.groupBy("shard", "salt").cogroup(arrays.select("shard", "salt", *names).groupBy("shard", "salt")).applyInArrow(run, "h1 long, h2 long, doc_id long, own long")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """Drops the lines that several documents share, from all but the largest doc_id that holds them.

    A text is split at \\n; a line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Keys of at least min_chars code points that at
    least min_docs documents hold lose all their lines except in the largest doc_id holding them. Returns docs with text replaced by what stays, joined by \\n
    (null becomes the empty text), and with n_lines and n_dropped (long); a column of docs of either name gives way to them. A null or empty text is one empty
    line; very long texts are split whole. Each row counts as a document of its own, so rows of equal doc_id and text count one each and all keep the line; null
    ids count as smaller than any (if no holder has an id, nothing goes). No rows give no rows.
    """
    modest_batches(docs.sparkSession)
    asked = spill(probes(docs, doc_id, text, min_chars), "probes")
    keys = asked.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    arrays, n = index(keys, asked.count(), min_docs)
    arrays = spill(arrays, "shards")
    gone = losses(asked, arrays, n, min_docs)
    hashes = F.collect_set(F.struct("h1", "h2")).alias("hashes")
    gone = spill(gone.groupBy("doc_id", "own").agg(hashes).withColumn("key", F.xxhash64("doc_id", "own")), "gone")
    forget(asked, arrays)

    out = [c for c in docs.columns if c.lower() not in (n_lines.lower(), n_dropped.lower())]
    at_id, at_text = [next(i for i, c in enumerate(out) if c.lower() == x.lower()) for x in (doc_id, text)]
    key, own, its_id, its_own, its_key, its_hashes, one, two = no_clash(docs, "_key", "_own", "_id", "_own_2", "_key_2", "_hashes", "_h1", "_h2")
    rows = docs.select(*(F.col(f"`{c}`") for c in out)).withColumn(own, F.xxhash64(F.col(f"`{out[at_text]}`"))).withColumn(key, F.xxhash64(F.col(f"`{out[at_id]}`").cast("long"), own))
    loses, others = Filter(gone, "key").split(rows, key)
    whole = F.coalesce(F.col(f"`{out[at_text]}`"), F.lit(""))
    breaks = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit("")))
    schema = T.StructType([*(T.StructField(c, T.StringType() if i == at_text else docs.schema[c].dataType) for i, c in enumerate(out)), T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    untouched = others.select(*(whole.alias(c) if i == at_text else F.col(f"`{c}`") for i, c in enumerate(out)), (breaks + 1).cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_dropped))

    met = F.col(key).eqNullSafe(F.col(its_key)) & F.col(own).eqNullSafe(F.col(its_own)) & F.col(f"`{out[at_id]}`").cast("long").eqNullSafe(F.col(its_id))
    joined = loses.join(gone.toDF(its_id, its_own, its_hashes, its_key), met, "left").select(*(F.col(f"`{c}`") for c in out), F.col(f"{its_hashes}.h1").alias(one), F.col(f"{its_hashes}.h2").alias(two))

    def cut(batches):
        for b in (whole_.slice(i, 500) for whole_ in batches for i in range(0, whole_.num_rows, 500)):
            texts, lines, dropped = [], [], []
            for t, h1, h2 in zip(b.column(at_text).to_pylist(), b.column(len(out)), b.column(len(out) + 1)):
                parts, at, hashes = split(t, min_chars)
                go = set()
                if h1.is_valid:
                    go = {h.tobytes() for h in np.stack([h1.values.to_numpy(), h2.values.to_numpy()], 1)}
                go = {i for j, i in enumerate(at) if hashes[16 * j : 16 * j + 16] in go}
                texts.append(b"\n".join([x for i, x in enumerate(parts) if i not in go] if go else parts).decode())
                lines.append(len(parts))
                dropped.append(len(go))
            kept = [pa.array(texts, pa.string()) if i == at_text else b.column(i) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*out, n_lines, n_dropped])
        release()

    return joined.mapInArrow(cut, schema).union(untouched)
