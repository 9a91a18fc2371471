"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt to blocks of bounded size by a hash, and each block is packed by itself, longest pieces first. A block's bins stand in order of what they have
left; each carries a bitmap of its sources and one of its duplicate clusters. A piece looks at the tightest bin that holds it and goes on to the next larger
until one has neither its source nor its cluster, so it always gets the tightest compatible bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import no_clash, spill
from .mixing import WORD

#: Words in a bin, pieces packed together on average, and equal rows that one task numbers.
CAPACITY, BLOCK, EQUAL = 2048, 2000, 1 << 20


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bins of pieces, given longest first: each piece's bin and start in it, and what each bin has left."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(clusters))}
    room: list[tuple[int, int]] = []  # (left, bin), in order
    left, has_source, has_cluster, bins, starts = [], [], [], [], []
    for size, s, c in zip(sizes, sources, clusters):
        s, c = source_bit[s], cluster_bit[c]
        for at in range(bisect_left(room, (size, -1)), len(room)):
            b = room[at][1]
            if not (has_source[b] & s or has_cluster[b] & c):
                del room[at]
                break
        else:
            b = len(left)
            left.append(capacity)
            has_source.append(0)
            has_cluster.append(0)
        bins.append(b)
        starts.append(capacity - left[b])
        left[b] -= size
        has_source[b] |= s
        has_cluster[b] |= c
        insort(room, (left[b], b))
    return bins, starts, left


def pack(docs: DataFrame, size: Column, cluster: Column, doc_id: str = "doc_id", source: str = "source", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """doc_id, source, piece (from 0), first_word, n_words, bin_id, start, free: where each document's words go.

    A document longer than capacity is cut into full pieces, each a bin of its own, and a rest; all other pieces are packed. No bin holds two pieces of a source
    or of a cluster, and none holds more than capacity words; free is what the bin has left. A null source is a source of its own, a null cluster is one cluster;
    a null or empty text is a document without words, a piece of 0 words. Equal rows (or copies) are pieces of one cluster; they are counted and numbered, and dealt to
    blocks by their number, so that no block is full of them. Ties in size go by id (null first), source and cluster, so reruns agree. Bins are numbered by block; blocks hold
    about block documents, however many there are. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.cast("long").alias("size"), cluster.cast("long").alias("cluster"))
    rows = spill(rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("equal")), "pieces")
    blocks = max(1, -(-(rows.agg(F.sum("equal")).first()[0] or 0) // block))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("equal") - 1, F.lit(EQUAL).cast("long")))
    some, few = rows.where(F.col("equal") > EQUAL).withColumn("first", first).repartition("doc_id", "source", "cluster", "first"), rows.where(F.col("equal") <= EQUAL).withColumn("first", F.lit(0).cast("long"))
    nth = F.explode(F.sequence(F.col("first"), F.least(F.col("equal"), F.col("first") + EQUAL) - 1))
    dealt = few.union(some).withColumn("nth", nth).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "doc_id", "source", "cluster", "nth"), F.lit(blocks)))

    def run(part: pa.Table) -> pa.Table:
        pieces = []  # what is left of each document after its full pieces
        out, bins = [], 0
        base = part.column("block")[0].as_py() << 32
        order = zip(*(part.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "size")))
        for i, s, c, n in sorted(order, key=lambda x: [(v is not None, v if v is not None else 0) for v in x]):
            whole, rest = divmod(n, capacity)
            for piece in range(whole):
                out.append((i, s, piece, piece * capacity, capacity, base + bins, 0, 0))
                bins += 1
            if rest or not whole:
                pieces.append((rest, i, s, c, whole))
        pieces.sort(key=lambda x: -x[0])
        to, starts, left = best_fit([x[0] for x in pieces], [x[2] for x in pieces], [x[3] for x in pieces], capacity)
        out += [(i, s, whole, whole * capacity, n, base + bins + b, at, left[b]) for (n, i, s, _, whole), b, at in zip(pieces, to, starts)]
        return pa.table([pa.array(x, pa.string() if c == "source" else pa.int64()) for x, c in zip(zip(*out), _COLUMNS)], names=_COLUMNS)

    return dealt.select("doc_id", "source", "size", "cluster", "block").groupBy("block").applyInArrow(run, _SCHEMA)


_SCHEMA = "doc_id long, source string, piece long, first_word long, n_words long, bin_id long, start long, free long"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def bin_texts(docs: DataFrame, packed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bin_id, text, n_words: the bins' words, pieces in order of start, joined by spaces. docs: one row an id."""
    own, words = no_clash(packed, "own", "words")
    parts = docs.select(F.col(doc_id).cast("long").alias(own), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias(words))
    joined = packed.join(parts, F.col("doc_id").eqNullSafe(F.col(own))).where("n_words > 0")
    piece = F.struct("start", F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("t"))
    bins = joined.groupBy("bin_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("n_words").alias("n_words"))
    return bins.select("bin_id", F.array_join(F.col("p.t"), " ").alias("text"), "n_words")
