"""Resampling documents towards a target corpus by hashed n-gram features: bucket-partitioned inverted postings.

Each text is read once where it lies. What leaves the task are inverted postings, the buckets of a range with their counts in a document; they are shuffled by
range of buckets, and by a salt of the documents where a range holds many, so that a bucket that all documents hold is many groups. In a group they meet the
counts of both corpora in the range's buckets, which give the buckets' gains on the spot; a document's contributions from the ranges are summed by a last
aggregation. Ranks come from sums over ranges of the order, never from one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Filter, forget, modest_batches, no_clash, running, small, spill
from .textkit import chunks, release

BUCKETS = 10_000
#: Ranges of buckets, and postings of a range that are one group on average.
PARTS, POSTINGS = 16, 1 << 20
#: Features whose buckets a task remembers.
REMEMBERED = 1 << 20
_LETTERS = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_POSTINGS = "row long, doc_id long, own long, n_words long, n_features long, part int, buckets array<int>, counts array<int>"


class Buckets(dict):
    """Feature in UTF-8 -> bucket, worked out when first asked for; pickled it is empty again."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = zlib.crc32(feature) % self.buckets
        if len(feature) < 64:
            self[feature] = out
        return out

    def __reduce__(self):
        return Buckets, (self.buckets,)


def features(words: list[bytes], ngrams: tuple[int, int]):
    """All runs of ngrams[0] to ngrams[1] consecutive words, joined by one space."""
    for n in range(ngrams[0], ngrams[1] + 1):
        yield from words if n == 1 else (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))


def postings(docs: DataFrame, doc_id: Column, text: str, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """A head row per document (doc_id, hash of its text, n_words, n_features) and its postings by range of buckets, under a number of the row."""
    bucket_of, width = Buckets(buckets), -(-buckets // PARTS)

    def run(batches):
        for b in batches:
            raw = [(t or "").encode() for t in b.column(3).to_pylist()]
            for lo, hi in chunks(raw, 1 << 22):
                ids, n_words, n_features = [], [], []
                for t in raw[lo:hi]:
                    words = t.translate(_LETTERS).split()
                    own = np.fromiter(map(bucket_of.__getitem__, features(words, ngrams)), np.int64)
                    ids.append(own)
                    n_words.append(len(words))
                    n_features.append(len(own))
                codes, counts = np.unique(np.repeat(np.arange(hi - lo), n_features) * buckets + np.concatenate(ids), return_counts=True)
                group = codes // buckets * PARTS + codes % buckets // width
                starts = np.flatnonzero(np.diff(group, prepend=-1))
                heads, offsets = b.slice(lo, hi - lo), pa.array(np.append(starts, len(codes)), pa.int32())
                rows, none = pa.array(group[starts] // PARTS), len(starts)
                yield pa.RecordBatch.from_arrays([*heads.columns[:3], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *(pa.nulls(hi - lo, t) for t in (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))], _NAMES)
                lists = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (codes % buckets, counts))
                yield pa.RecordBatch.from_arrays([heads.column(0).take(rows), *(pa.nulls(none, pa.int64()) for _ in range(4)), pa.array((group[starts] % PARTS).astype(np.int32)), *lists], _NAMES)
        release()

    return docs.select(F.monotonically_increasing_id().alias("_row"), doc_id.cast("long").alias("_id"), F.xxhash64(text).alias("_own"), F.col(text).alias("_text")).mapInArrow(run, _POSTINGS)


_NAMES = [c.split()[0] for c in _POSTINGS.split(", ")]


def totals(posted: DataFrame) -> DataFrame:
    """bucket, n: how often the corpus holds the features of each bucket (at most as many rows as there are buckets)."""
    pair = F.explode(F.arrays_zip("buckets", "counts"))
    return posted.where("part IS NOT NULL").select("part", pair.alias("p")).groupBy("part", F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"), F.count("*").alias("held"))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    """How much more common a bucket is in the target: thousandths of the logarithm of the ratio of its smoothed shares, rounded down."""
    return math.floor(1000 * math.log((t + 1.0) * (all_s + float(buckets)) / ((s + 1.0) * (all_t + float(buckets)))))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, in thousandths rounded down; it depends on seed and doc_id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 10, min_words: int = 20, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, own (hash of the text), n_words, n_features, weight, score, rank (all long) of every row of docs.

    Words are what is left of a text, A-Z in lower case, when all of ASCII but letters and digits is cut out; features are runs of ngrams[0] to ngrams[1] of them,
    hashed into buckets. weight is the mean gain of a document's features, rounded down; score adds Gumbel noise, so that the highest scores are a sample without
    replacement whose odds follow the weights. Of the rows with at least min_words words the best percent (rounded down) are drawn and ranked from 1; rank is null
    for the others. Ties go to the smaller doc_id (null last), then by hash of the text. Null and empty texts have no feature and weight 0; very long texts are read
    whole. Rows of equal id are documents of their own; their noise is the same. An empty target has gain by smoothing alone; no rows give no rows. Columns of docs
    beyond the two aren't read. See drawn() for the documents themselves.
    """
    modest_batches(docs.sparkSession)
    posted = spill(postings(docs, F.col(f"`{doc_id}`"), text, ngrams, buckets), "postings")
    here = spill(totals(posted), "totals")
    there = totals(postings(target, F.lit(None), target_text, ngrams, buckets)).select(F.col("bucket").alias("b"), F.col("n").alias("t"))
    both = spill(here.join(there, F.col("bucket") == F.col("b"), "left").select("part", "bucket", F.col("n").alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "gains")
    all_s, held = here.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("held"), F.lit(0))).first()
    all_t = there.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]

    salts = max(1, -(-held // (PARTS * POSTINGS)))
    lists = posted.where("part IS NOT NULL").select("part", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), "row", "buckets", "counts")
    counts = both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def contribute(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table([pa.array([], pa.int64())] * 2, names=["row", "part_of_weight"])
        at = np.zeros(buckets, np.int64)
        for b, s, t in zip(*(right.column(c).to_pylist() for c in ("bucket", "s", "t"))):
            at[b] = gain(s, t, all_s, all_t, buckets)
        lists = [left.column(c).combine_chunks() for c in ("buckets", "counts")]
        each = at[lists[0].flatten().to_numpy()] * lists[1].flatten().to_numpy()
        starts = np.append(0, np.cumsum(lists[0].value_lengths().to_numpy())[:-1])
        return pa.table([left.column("row"), pa.array(np.add.reduceat(each, starts))], names=["row", "part_of_weight"])

    parts = lists.groupBy("part", "salt").cogroup(counts.groupBy("part", "salt")).applyInArrow(contribute, "row long, part_of_weight long")
    heads = posted.where("part IS NULL").select("row", "doc_id", "own", "n_words", "n_features", F.lit(0).cast("long").alias("part_of_weight"))
    none = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "own", "n_words", "n_features")]
    summed = heads.unionByName(parts.select("row", *none, "part_of_weight")).groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "own", "n_words", "n_features")), F.sum("part_of_weight").alias("w"))
    weight = F.when(F.col("n_features") > 0, F.expr("(w - pmod(w, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = spill(summed.withColumn("weight", weight).select("row", "doc_id", "own", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")), "scored")
    forget(posted, here, both)

    enough = scored.where(F.col("n_words") >= min_words)
    wanted = enough.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("own"), F.col("row")]
    ranked = running(enough, order, rank=F.lit(1).cast("long")).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    others = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).drop("row")


def drawn(docs: DataFrame, told: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that resample() has drawn, all columns. Rows equal in id and text go together."""
    key, own, its_id, its_own = no_clash(docs, "_key", "_own", "_id", "_own_2")
    keys = spill(told.where("rank IS NOT NULL").select("doc_id", "own").distinct().withColumn("key", F.xxhash64("doc_id", "own")), "drawn")
    rows = docs.withColumn(own, F.xxhash64(text)).withColumn(key, F.xxhash64(F.col(f"`{doc_id}`").cast("long"), own))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(its_own))
    return Filter(keys, "key").split(rows, key)[0].join(small(keys.select(F.col("doc_id").alias(its_id), F.col("own").alias(its_own))), same, "left_semi").select(*docs.columns)
