"""N-gram Jaccard join: grouped prefix join over the distinct word shingles of whole texts.

Plan: (1) shingles that are frequent in whole batches go last in the global order of shingles, so that no prefix ends up full of a passage everyone shares;
(2) one pass writes, per document, the set's size and 128-bit digest, a parity bitmap and the prefix, the prefix once per batch and group of documents with equal prefix and size.
Documents with equal sets are one class, classes with equal prefix and size one group;
(3) postings of the groups are sorted by shingle; lists with one group go; each member is paired with a few hubs of its list, and the groups' first classes are verified;
(4) groups that this has not yet connected are paired within each list (size and position filters); group pairs are expanded to the classes that are not yet
connected, and these are verified. What is left out are only pairs whose ends are known to be connected, so the components are those of all links.
Long lists are cut into blocks: each has hubs of its own, which are paired with each other in a list of hubs, and blocks meet two by two in step (4).
"""

from __future__ import annotations

import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, maybe_in, modest_batches, small, spill
from .components import components
from .textkit import CHUNK, release, shingle_sets

#: Most shingles that are put last for being frequent (2 MB); it bounds a broadcast and changes only the order, never the result.
HOT_SHINGLES = 1 << 18
#: Documents counted together that share a shingle for it to be told, and the sum of what is told from which on it goes last.
HOT_IN_BATCH, HOT_IN_ALL = 3, 32
#: Shingles that are counted together (32 MB), and the parts in which they are.
COUNTED, PARTS = 4 << 20, 16


def row_key(doc_id: Column, own: Column) -> Column:
    """By which a row's text is found again. Rows of equal keys are told apart by the digests of their sets."""
    return F.xxhash64(doc_id, own)


#: Rows of a batch whose texts are held at once.
SLICE = 500


def _texts(batch: pa.RecordBatch, name: str | int = "text") -> list[bytes]:
    return [(t or "").encode().lower() for t in batch.column(name).to_pylist()]


def _sets(batch: pa.RecordBatch, name: str | int, k: int):
    """The shingle sets of a batch's texts, one after another."""
    for lo in range(0, batch.num_rows, SLICE):
        yield from shingle_sets(_texts(batch.slice(lo, SLICE), name), k)


def _digest(u: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(u.tobytes()))


def least_overlap(n, m, percent: int):
    """Least intersection of two sets of sizes n and m at which 100 * intersection >= percent * union."""
    return -((-percent * (n + m)) // (100 + percent))


def hot_shingles(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Sorted hashes of the shingles that many different texts of the same batches share; about HOT_SHINGLES at most, the most frequent."""

    def counts(sets: list):
        for lo in range(PARTS):  # the shingles by their first bits, so that little is sorted at once
            ends = [np.uint64(x * ((1 << 64) // PARTS)) for x in (lo, lo + 1) if x < PARTS]
            cut = [[np.searchsorted(u, e) for e in ends] + [len(u)] for u in sets]
            token, n = np.unique(np.concatenate([u[c[0] : c[1]] for u, c in zip(sets, cut)]), return_counts=True)
            at = n >= HOT_IN_BATCH
            yield pa.RecordBatch.from_arrays([pa.array(token[at].view(np.int64)), pa.array(n[at], pa.int64())], ["token", "n"])
        release()

    def count(batches):
        seen, sets, total = set(), [], 0
        for b in batches:
            for u in _sets(b, text, k):
                d = _digest(u)
                if d not in seen:
                    seen.add(d)
                    sets.append(u)
                    total += len(u)
            if total >= COUNTED:
                yield from counts(sets)
                seen, sets, total = set(), [], 0
        if sets:
            yield from counts(sets)

    counted = docs.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_IN_ALL)
    counted = spill(counted, "hot")
    if (total := counted.count()) > HOT_SHINGLES:  # then from that count on which about as many have
        counted = counted.where(F.col("n") > counted.approxQuantile("n", [1 - HOT_SHINGLES / total], 1e-3)[0])
    out = np.sort(counted.select("token").limit(2 * HOT_SHINGLES).toArrow().column(0).to_numpy().view(np.uint64))
    forget(counted)
    return out


def parity(u: np.ndarray) -> bytes:
    """A bitmap of at least one bit per shingle; each shingle flips one bit. Bits in which two differ bound the symmetric difference from below."""
    bits = 64
    while bits < len(u):
        bits *= 2
    return np.packbits(np.bincount((u >> np.uint64(20)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """False only if the bitmaps show that the sets don't link."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum()) <= n + m - 2 * least_overlap(n, m, percent)


def describe(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """doc_id, own (hash of the text), n, s1, s2 (digest of the set), g (of prefix and size), prefix (shingles in global order; null but for the first of a group in a batch), bits."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_shingles(docs, text, k))
    names = ["doc_id", "own", "n", "s1", "s2", "g", "prefix", "bits"]

    def told(ids, sets, seen: set):
        last = hot.value
        for (i, own), u in zip(ids, sets):
            n = len(u)
            if not n:
                yield i, own, 0, None, None, None, None, None
                continue
            p = n + (-percent * n) // 100 + 1
            if len(last):
                is_hot = last[np.minimum(np.searchsorted(last, u), len(last) - 1)] == u
                cold = u[~is_hot][:p]
                prefix = cold if len(cold) == p else np.concatenate([cold, u[is_hot][: p - len(cold)]])
            else:
                prefix = u[:p]
            g = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n)
            g -= (g >> 63) << 64
            first = g not in seen
            if first:
                seen.add(g)
            yield i, own, n, *_digest(u), g, prefix.view(np.int64) if first else None, parity(u)

    def run(batches):
        kinds = [*[pa.int64()] * 6, pa.list_(pa.int64()), pa.binary()]
        seen: set = set()
        for b in batches:
            if len(seen) > 200_000:  # a prefix may come twice; the postings are the same
                seen.clear()
            ids, sets = zip(b.column(0).to_pylist(), b.column(1).to_pylist()), _sets(b, 2, k)
            while rows := list(islice(told(ids, sets, seen), SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), text)
    return rows.mapInArrow(run, "doc_id long, own long, n long, s1 long, s2 long, g long, prefix array<long>, bits binary")


def _runs(batches, columns: int, one: bool = False):
    """Sorted batches (first column: key) -> arrays in which no run of equal keys is cut in two; one run at a time if so asked."""
    if one:
        for run in _runs(batches, columns):
            edges = np.r_[0, np.flatnonzero(run[0][1:] != run[0][:-1]) + 1, len(run[0])].tolist()
            yield from ([x[lo:hi] for x in run] for lo, hi in zip(edges, edges[1:]))
        return
    held = None
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        held = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if held is not None and len(held[0]):
        yield held


#: Rows of a list that are held to tell its size; a longer one's is counted apart.
HELD = 1 << 16


def _several(batches):
    """Sorted (token, g, np) -> the rows of tokens with several groups, once each, with their number (-1 for a list longer than HELD)."""
    own, last, parts, count, long = None, None, [], 0, False  # the run that may go on: its token, last group, what is held of it, its rows

    def rows(token, g, np_, size):
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(x, len(g)).astype(np.int64)) for x in (token, g, np_, size)], ["token", "g", "np", "size"])

    def flush():
        if parts and (long or count > 1):
            yield rows(own, *(np.concatenate([p[i] for p in parts]) for i in range(2)), -1 if long else count)

    for b in batches:
        token, g, np_ = (b.column(i).to_numpy() for i in range(3))
        keep = np.ones(len(token), bool)  # without repeats, which lie side by side
        keep[1:] = (token[1:] != token[:-1]) | (g[1:] != g[:-1])
        if len(token) and (token[0], g[0]) == (own, last):
            keep[0] = False
        token, g, np_ = token[keep], g[keep], np_[keep]
        if not len(token):
            continue
        edges = np.r_[0, np.flatnonzero(token[1:] != token[:-1]) + 1, len(token)]
        if token[0] == own:
            parts.append((g[: edges[1]], np_[: edges[1]]))
            count += int(edges[1])
            edges = edges[1:]
        if len(edges) > 1:  # the run before has ended, and so have all of these but the last
            yield from flush()
            size = np.repeat(np.diff(edges[:-1]), np.diff(edges[:-1]))
            at = np.flatnonzero(size > 1) + edges[0]
            if len(at):
                yield rows(token[at], g[at], np_[at], size[size > 1])
            own, parts, count, long = token[-1], [(g[edges[-2] :], np_[edges[-2] :])], int(edges[-1] - edges[-2]), False
        last = g[-1]
        if count > HELD:
            long = True
            yield from flush()
            parts = []
    yield from flush()


#: Hubs with which each member of a block is paired first, members of a block on average, and of the blocks of a list and of a group that meet two by two in what is left.
HUBS, HUB_BLOCK, CROSS_BLOCK, WITHIN_BLOCK = 4, 1 << 16, 1 << 12, 1 << 10


def _hubs(percent: int):
    """Sorted (list, weight, g, np, token) -> pairs (lead, g) of each member with the first HUBS of its list that its size may link with; and the hubs themselves,
    without a lead. Sizes that no hub may link with make new hubs, so their number follows the logarithm of the sizes' range."""

    def run(batches):
        before, hubs = None, []
        for b in batches:
            lead, out = [], []
            for at, (t, g, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("list", "g", "np")))):
                n = y >> 32
                if t != before:
                    before, hubs = t, []
                found = 0
                for x, m in hubs:
                    if 100 * min(m, n) >= percent * max(m, n):
                        lead.append(x)
                        out.append(at)
                        found += 1
                        if found == HUBS:
                            break
                else:
                    hubs.append((g, n))
                    lead.append(None)
                    out.append(at)
            rows = b.select(["token", "g", "np"]).take(pa.array(out, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), *rows.columns], ["lead", "token", "g", "np"])

    return run


def leads(lists: DataFrame, longest: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """lists (token, g, np, size, weight; longest: the largest size) -> distinct pairs (lead, g) of groups, and the tables that they need. A list longer than HUB_BLOCK is cut into blocks; their hubs are the next list."""
    out, tables = None, []
    while True:
        block = F.pmod(F.xxhash64("g"), F.ceil(F.col("size") / HUB_BLOCK))
        rows = lists.select(F.xxhash64("token", block).alias("list"), "weight", "g", "np", "token").repartition("list").sortWithinPartitions("list", F.desc("weight"), "g")
        made = rows.mapInArrow(_hubs(percent), "lead long, token long, g long, np long")
        if longest > HUB_BLOCK:
            made = spill(made, "hubs")
            tables.append(made)
        pairs = made.where("lead IS NOT NULL").select("lead", "g")
        out = pairs if out is None else out.union(pairs)
        if longest <= HUB_BLOCK:
            return out.distinct(), tables
        hubs = made.where("lead IS NULL").join(lists.where(F.col("size") > HUB_BLOCK).select("token", "g", "weight"), ["token", "g"]).distinct()
        hubs = hubs.join(hubs.groupBy("token").agg(F.count("*").alias("size")), "token").select("token", "g", "np", "size", "weight")
        after = spill(hubs, "lists")
        tables.append(after)
        shorter = after.agg(F.max("size")).first()[0] or 0
        if shorter >= longest:  # sizes are so many that hubs don't get fewer: what is left is paired in full
            return out.distinct(), tables
        lists, longest = after, shorter


def _cross(percent: int):
    """Sorted (list, np, g, comp, side) -> pairs of groups of a list that are not known to be connected and may link by size and position; of the two blocks of a
    list (sides 0 and 1) only pairs across, in a block with itself (side 2) all. comp is negative for a group whose classes aren't all connected."""

    def found(batches):
        for token, np_, group, comp, side in _runs(batches, 5):
            edge = np.flatnonzero(np.diff(token)) + 1
            for lo, hi in zip(np.r_[0, edge].tolist(), np.r_[edge, len(token)].tolist()):
                c, s = comp[lo:hi], side[lo:hi]
                if hi - lo < 2 or (c == c[0]).all() and c[0] >= 0:
                    continue
                n, pos, r = np_[lo:hi] >> 32, np_[lo:hi] & 0xFFFFFFFF, group[lo:hi]
                first = np.searchsorted(n, -((-percent * n) // 100)).tolist()  # the smallest that may link with each
                for i in range(1, hi - lo):
                    if first[i] == i:
                        continue
                    j = slice(first[i], i)
                    need = -((-percent * (n[i] + n[j])) // (100 + percent))
                    other = r[j][((c[j] != c[i]) | (c[i] < 0)) & ((s[j] != s[i]) | (s[i] == 2)) & (r[j] != r[i]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)]
                    if len(other):
                        yield np.minimum(other, r[i]), np.maximum(other, r[i])

    def run(batches):
        held, size = [], 0
        for pair in found(batches):
            held.append(pair)
            size += len(pair[0])
            if size >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["x", "y"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["x", "y"])
        release()

    return run


def _two_by_two(rows: DataFrame, by: Column, key: str) -> DataFrame:
    """rows (with blocks, the number of blocks of their key) once for each block that theirs meets: list tells key and pair of blocks, side the block (2 where it meets itself)."""
    d = rows.withColumn("own", F.pmod(by, F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("long")
    return d.withColumn("list", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", side)


def _within(percent: int):
    """Sorted (list, cid, comp, n, side, bits) of classes of a group -> pairs that aren't known to be connected and whose bitmaps don't rule a link out. Sizes and so
    bitmaps of a group are equal; lists of one hash are told apart by size, and what remains is verified as all pairs are."""

    def run(batches):
        for _, cid, comp, n, side, bits in _runs(batches, 6, True):
            a, b = [], []
            for size in np.unique(n).tolist():
                at = np.flatnonzero(n == size)
                c, k, s = cid[at], comp[at], side[at]
                x = np.frombuffer(b"".join(bits[at]), np.uint8).reshape(len(at), -1)
                most = 2 * (size - least_overlap(size, size, percent))
                for i in range(1, len(at)):
                    j = np.flatnonzero((k[:i] != k[i]) & ((s[:i] != s[i]) | (s[i] == 2)))
                    if len(j):
                        j = j[np.bitwise_count(x[j] ^ x[i]).sum(1) <= most]
                        a.append(c[j])
                        b.append(np.full(len(j), c[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *y])) for y in (a, b)], ["a", "b"])
        release()

    return run


def open_pairs(lists: DataFrame, named: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """lists (token, g, np), named (g, cid, comp: classes and what is known of their components) -> pairs (a, b) of classes that share a list or a group, may link by
    size and position and aren't known to be connected."""
    state = named.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("classes"))
    state = spill(state.select("g", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("comp"), "classes"), "state")
    members = lists.select("token", "g", "np").join(state.select("g", "comp"), "g")
    tokens = members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi OR lo < 0")
    tokens = tokens.select(F.col("token").alias("t"), F.ceil(F.col("size") / CROSS_BLOCK).cast("int").alias("blocks"))
    met = _two_by_two(members.join(tokens, F.col("token") == F.col("t")), F.xxhash64(F.lit(1), "g"), "token").select("list", "np", "g", "comp", "side")
    groups = spill(met.repartition("list").sortWithinPartitions("list", "np", "g").mapInArrow(_cross(percent), "x long, y long").distinct(), "groups")
    one, two = (named.select(F.col("g").alias(x), F.col("cid").alias(c), F.col("comp").alias(k)) for x, c, k in (("x", "a", "ca"), ("y", "b", "cb")))
    across = groups.join(one, "x").join(two, "y").where("ca <> cb")
    mixed = state.where("classes > 1 AND comp < 0").select(F.col("g").alias("h"), F.ceil(F.col("classes") / WITHIN_BLOCK).cast("int").alias("blocks"))
    of_mixed = named.join(mixed, F.col("g") == F.col("h")).join(classes.select(F.col("cid").alias("c"), "n", "bits"), F.col("cid") == F.col("c"))
    met = _two_by_two(of_mixed, F.xxhash64(F.lit(2), "cid"), "g").select("list", "cid", "comp", "n", "side", "bits")
    within = met.repartition("list").sortWithinPartitions("list", "cid").mapInArrow(_within(percent), "a long, b long")
    pairs = across.select("a", "b").union(within.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = spill(pairs.distinct(), "pairs")
    forget(state, groups)
    return pairs


def verify(pairs: DataFrame, classes: DataFrame, words: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes -> those that link: bitmaps first, then the exact sets of their texts. words: _key, _text, a row for each different row of a key."""
    side = classes.select("cid", "n", "bits", "key", "s1", "s2")

    def by_bits(batches):
        for b in batches:
            t = b.to_pydict()
            at = [i for i in range(b.num_rows) if may_link(t["n"][i], t["bits"][i], t["m"][i], t["other"][i], percent)]
            yield b.select(["a", "b", "x_key", "y_key", "s1", "s2", "t1", "t2"]).take(pa.array(at, pa.int64()))

    left = side.toDF("a", "n", "bits", "x_key", "s1", "s2")
    right = side.toDF("b", "m", "other", "y_key", "t1", "t2")
    kept = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "bits", "m", "other", "x_key", "y_key", "s1", "s2", "t1", "t2")
    kept = spill(kept.mapInArrow(by_bits, "a long, b long, x_key long, y_key long, s1 long, s2 long, t1 long, t2 long"), "pairs")
    words = maybe_in(words, "_key", kept.select("x_key").union(kept.select("y_key")).toDF("_key"))
    both = kept.join(words.withColumnsRenamed({"_key": "x_key", "_text": "x"}), "x_key").join(words.withColumnsRenamed({"_key": "y_key", "_text": "y"}), "y_key").select("a", "b", "x", "y", "s1", "s2", "t1", "t2")

    def exact(batches):
        for b in batches:
            ids, x, y = b.select(["a", "b", "s1", "s2", "t1", "t2"]).to_pydict(), b.column("x"), b.column("y")
            links, lo = [], 0
            sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy() for c in (x, y)).tolist()
            while lo < b.num_rows:
                hi, total = lo + 1, sizes[lo]
                while hi < b.num_rows and total + sizes[hi] <= 4 * CHUNK:
                    total, hi = total + sizes[hi], hi + 1
                sets = [shingle_sets([(t or "").encode().lower() for t in c.slice(lo, hi - lo).to_pylist()], k) for c in (x, y)]
                for i, u, v in zip(range(lo, hi), *sets):
                    if _digest(u) != (ids["s1"][i], ids["s2"][i]) or _digest(v) != (ids["t1"][i], ids["t2"][i]):
                        continue  # another text of the same key
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    if 100 * both >= percent * (len(u) + len(v) - both):
                        links.append((ids["a"][i], ids["b"][i]))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["a", "b"])

    links = spill(both.mapInArrow(exact, "a long, b long"), "links")
    forget(kept)
    return links


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """near_duplicates() with two more columns: own (xxhash64 of the text), and component (a number that rows of one component share, and no others; null for a row
    without copies or links). doc_ids may repeat with different texts: a row is told by its text, not by its id."""
    modest_batches(docs.sparkSession)
    told = spill(describe(docs, doc_id, text, k, percent), "sets")
    full = told.where("n > 0")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own"))
    classes = full.groupBy("s1", "s2").agg(row.alias("row"), F.min("n").alias("n"), F.min("g").alias("g"), F.min("bits").alias("bits"), F.count("*").alias("copies"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "s1", "s2", "n", "g", "bits", "copies", F.col("row.doc_id").alias("first"), row_key(F.col("row.doc_id"), F.col("row.own")).alias("key"))
    classes = spill(classes, "classes")
    groups = classes.groupBy("g").agg(F.min("cid").alias("lead_class"), F.count("*").alias("classes"))
    words = docs.select(row_key(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("_key"), F.col(text).alias("_text"), F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_own"))
    if full.groupBy("doc_id", "own").count().where("count > 1").limit(1).count():  # rows that repeat would repeat their pairs; different rows of one key stay
        words = words.dropDuplicates(["_key", "_id", "_own"])
    words = words.drop("_id", "_own")

    postings = full.where("prefix IS NOT NULL").select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("token", "g", (F.shiftleft("n", 32) + F.col("pos")).alias("np")).repartition("token").sortWithinPartitions("token", "g")
    lists = spill(postings.mapInArrow(_several, "token long, g long, np long, size long"), "lists")

    # Each member with the hubs of its lists, the groups that share most with others, and each class of a group with the group's first.
    sized, longest = lists, lists.agg(F.max("size")).first()[0] or 0
    if lists.where("size < 0").limit(1).count():
        sizes = lists.where("size < 0").groupBy("token").agg(F.count("*").alias("size"))
        longest = max(longest, sizes.agg(F.max("size")).first()[0])
        sized = lists.where("size > 0").unionByName(lists.where("size < 0").drop("size").join(sizes, "token"))
    weight = F.sum("size").over(Window.partitionBy("g")).alias("weight")  # over a prefix's shingles
    lead, made = leads(sized.select("token", "g", "np", "size", weight), longest, percent)
    lead = lead.join(groups.select(F.col("g").alias("lead"), F.col("lead_class").alias("a")), "lead").join(groups.select("g", F.col("lead_class").alias("b")), "g").select("a", "b")
    inner = classes.join(groups.where("classes > 1"), "g").where("cid <> lead_class").select(F.col("lead_class").alias("a"), F.col("cid").alias("b"))
    pairs = spill(lead.union(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = verify(pairs, classes, words, k, percent)
    known = spill(components(links.toDF("u", "v")), "components")

    # What isn't connected yet: group pairs of each list, and classes of a group.
    named = classes.join(known.withColumnRenamed("node", "cid"), "cid", "left").select("g", "cid", F.coalesce("component", "cid").alias("comp"))
    named = spill(named, "named")
    rest = open_pairs(lists, named, classes, percent)
    left = spill(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = verify(left, classes, words, k, percent)

    linked = spill(components(links.union(more).toDF("u", "v")).withColumnRenamed("node", "cid"), "components")
    final = classes.join(linked, "cid", "left").where("copies > 1 OR component IS NOT NULL").select("s1", "s2", "first", F.coalesce("component", "cid").alias("component"))
    smallest = final.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("component_id"))
    final = spill(final.join(smallest, F.col("component") == F.col("c")).select("s1", "s2", "component", "component_id"), "components")
    forget(classes, lists, pairs, links, known, named, rest, left, more, linked, *made)
    out = told.select("doc_id", "own", "n", "s1", "s2").join(small(final), ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "own", "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Components of the documents whose sets of k-word shingles have 100 * intersection >= percent * union.

    Returns per row of docs: doc_id long, n_shingles long, component_id long (the smallest doc_id reachable by links, itself included). Texts are lower-cased
    in A-Z and split at [\\x20\\x09-\\x0D]; a text with 1 to k - 1 words is one shingle; null, empty and blank texts have none and link with nothing; very long
    texts count whole. Rows without a doc_id are documents too: they link, and get the smallest doc_id they reach, null if there is none. Repeated rows come
    back repeated. Rows of one doc_id with different texts are documents of their own. Other columns are ignored; no rows give no rows.
    """
    return near_groups(docs, doc_id, text, k, percent).select("doc_id", "n_shingles", "component_id")
