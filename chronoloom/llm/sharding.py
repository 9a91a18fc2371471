"""Sharding by sampled splitters.

Records are ordered by (hash of the text, id, a number of their own): equal texts lie side by side, yet no key is so heavy that it can't be cut. A size-weighted
sample of keys gives splitters of many ranges per shard; ranges that turn out overfull are sampled again by themselves and subdivided. Ranges are small enough
to be sorted by one task each, and sums over ranges give every record its exact place, so shards differ in size by a record or so, whatever the sample was.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, no_clash, spill, uniform

#: Ranges per shard at least, rows in a range about at most, ranges in all at most (their table is broadcast), and sampled keys per range on average.
RANGES, RANGE_ROWS, MOST_RANGES, SAMPLES = 16, 2_000_000, 1 << 16, 16
#: A range is overfull above this many times the mean, and is subdivided up to this many times; a subdivision's number has SUB bits.
OVERFULL, ROUNDS, SUB = 3.0, 2, 16
_KEY = ["h", "id", "own"]


def _quantiles(keys: pd.DataFrame, n: int) -> list[tuple[int, int, int]]:
    """n - 1 splitters of n ranges from sampled keys."""
    at = sorted(zip(*(keys[c].tolist() for c in _KEY)))
    return sorted({at[len(at) * i // n] for i in range(1, n)} if len(at) >= n else set(at))


def _range_of(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """Number of splitters (columns, sorted) not above each key (columns)."""
    lo, hi = (np.searchsorted(splitters[0], keys[0], side) for side in ("left", "right"))
    out = lo.copy()
    for a in np.unique(lo[lo < hi]) if len(keys) > 1 else ():
        at = np.flatnonzero((lo == a) & (hi > a))
        out[at] = a + _range_of([k[at] for k in keys[1:]], [x[a : hi[at[0]]] for x in splitters[1:]])
    return hi if len(keys) == 1 else out


def _place(rows: DataFrame, splitters: dict[int, list[tuple[int, int, int]]], shift: int) -> DataFrame:
    """rows with path plus the number of its range among the splitters of its path, shifted; paths without splitters stay."""
    sent = {path: [np.array(c, np.int64) for c in zip(*x)] for path, x in splitters.items() if x}

    @F.pandas_udf("long")
    def place(path: pd.Series, h: pd.Series, i: pd.Series, own: pd.Series) -> pd.Series:
        out, keys = path.to_numpy().copy(), [x.to_numpy() for x in (h, i, own)]
        for p in np.unique(out):
            if p in sent:
                at = np.flatnonzero(path.to_numpy() == p)
                out[at] += _range_of([k[at] for k in keys], sent[p]).astype(np.int64) << shift
        return pd.Series(out)

    return rows.withColumn("path", place("path", *_KEY))


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 8, seed: int = 1) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus overhead), text_crc32, shard (0 to shards - 1), slot (place within the shard, from 0), range.

    A record belongs to the shard in which its middle byte falls when all records stand end to end in order of (hash of the text, id). Shards therefore hold
    equal numbers of bytes up to about a record at either end, and equal texts (null and empty are alike here) stand together, parted only where a shard is full.
    Records that tie in both (repeated rows) are interchangeable, and any number of them is cut like others. A null id counts as the smallest; a very long text is
    one record, however full its shard gets. Other columns are ignored; no rows give no rows. Splitters change the work's distribution, never the result. Each
    row is placed once, and again only if its range was overfull.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_crc32"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("own"),
    )
    rows = spill(rows, "sized")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(max(shards * RANGES, n // RANGE_ROWS), MOST_RANGES)
    share = F.col("size") * (ranges * SAMPLES / max(total, 1))  # with which each row is drawn
    sampled = rows.where(uniform(*_KEY, seed=seed) < share).select(*_KEY).toPandas()
    done, now, shift = [], spill(_place(rows.withColumn("path", F.lit(0).cast("long")), {0: _quantiles(sampled, ranges)}, ROUNDS * SUB), "ranges"), ROUNDS * SUB
    tables = [rows, now]
    for turn in range(1, ROUNDS + 1):
        sums = now.groupBy("path").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        over = {r["path"]: r["bytes"] for r in sums.where((F.col("bytes") > OVERFULL * total / ranges) & (F.col("rows") > 1)).collect()}
        if not over:
            break
        again = now.where(F.col("path").isin(list(over)))
        sampled = again.where(uniform(*_KEY, seed=seed + turn) < share).select("path", *_KEY).toPandas()
        shift -= SUB
        cuts = {int(p): _quantiles(keys, min(math.ceil(over[p] * ranges / total), 1 << SUB)) for p, keys in sampled.groupby("path")}
        done.append(now.where(~F.col("path").isin(list(over))))
        now = spill(_place(again, cuts, shift), "ranges")
        tables.append(now)
    placed = now
    for d in done:
        placed = placed.unionByName(d)
    sums = placed.groupBy("path").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    starts = F.broadcast(sums.select("path", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0")))
    own = Window.partitionBy("path").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("size").over(own)).withColumn("nth", F.row_number().over(own)).join(starts, "path")
    middle = F.col("bytes0") + F.col("upto") - F.ceil(F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int")).withColumn("row", F.col("rows0") + F.col("nth") - 1)
    placed = spill(placed.select("doc_id", "size", "text_crc32", "shard", "row", F.col("path").alias("range")), "placed")
    forget(*tables)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("row0")))  # a row a shard
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("row0")).alias("slot"), "range")


def write_shards(docs: DataFrame, places: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """docs as Parquet folders shard=0, shard=1, ...; rows in order of slot. places: from shard(), for unique ids. A column of docs named shard gives way."""
    kept = [c for c in docs.columns if c.lower() != "shard"]
    own, slot, part = no_clash(docs, "_own", "_slot", "_range")
    told = places.select(F.col("doc_id").alias(own), "shard", F.col("slot").alias(slot), F.col("range").alias(part))
    here = docs.select(*(F.col(f"`{c}`") for c in kept)).join(told, F.col(f"`{doc_id}`").eqNullSafe(F.col(own))).drop(own)
    here.repartition("shard", part).sortWithinPartitions("shard", slot).drop(slot, part).write.partitionBy("shard").parquet(path)
