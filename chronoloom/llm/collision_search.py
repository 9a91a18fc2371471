"""Nearest neighbours by collision-counting hashing with query-centred windows.

Each vector is projected on random lines. In a block of vectors every line has a sorted array; a query's window around its own projection is a range of it, and
a vector collides on the lines whose window holds it. Vectors that collide often enough are verified with the exact measure; windows widen (virtual rehashing) to
the radius of the k-th best found until that lies within the radius that they stand for, and only entries that a wider window adds are counted. The largest inner
product becomes the least distance by one more coordinate.

Blocks are cells of a few routing lines, cut at sampled quantiles. A query is first answered in the block it lies in; the distance of its k-th best there bounds
its radius, and it then visits only the cells that its windows of that radius on the routing lines reach. Data as far from each other as near (random directions
in many dimensions) leave few cells out: then a query visits nearly all, as any exact search does.
"""

from __future__ import annotations

import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, modest_batches, small, spill, uniform

#: Lines; half-width of a window in units of the radius; deviations below the mean of collisions at the radius that still make a candidate; growth of a
#: radius in which too few were found.
LINES, HALF, MISS, GROWTH = 64, 1.3, 1.65, 1.3
#: Vectors of a block on average, queries that meet them at once, vectors of a block whose distances give a query's first radius, queries counted together.
BLOCK, QUERIES, PROBE, CHUNK = 8192, 8192, 256, 256
#: Routing lines at most, half-width of a window on them in units of the radius (0.9 % of neighbours at the radius lie outside), vectors sampled for quantiles.
ROUTES, REACH, SAMPLE = 3, 2.6, 20_000
#: Lengths of vectors that are searched together; a table with more is searched in rounds.
MOST_LENGTHS = 1000


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, longest: float, radius: np.ndarray | None = None, floor: np.ndarray | None = None, lines: int = LINES):
    """For each query the k vectors of the block with the largest inner products that were found: positions of queries, of vectors, products; and how many array
    entries were counted and vectors verified. own: the query's own position (-1: not here). With radius (one for each query) windows stay as they are; what
    lies below floor is left out."""
    n, d = vectors.shape
    normal = np.random.default_rng(5).standard_normal((lines, d + 1))
    p = normal @ np.c_[vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))].T
    order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
    arrays = np.take_along_axis(p, order, axis=1)
    p = queries @ normal[:, :d].T
    square = (queries**2).sum(1) + longest**2
    hit = math.erf(HALF / math.sqrt(2))
    least = max(1, math.floor(lines * hit - MISS * math.sqrt(lines * hit * (1 - hit))))
    fixed = radius is not None
    if not fixed:  # that of a few vectors, as many of them in it as should hold k of the block
        few = min(n, PROBE)
        seen = queries @ vectors[:few].T
        inside = np.flatnonzero((own >= 0) & (own < few))
        seen[inside, own[inside]] = -np.inf
        nth = min(few, math.ceil(few * k / n))
        near = -np.partition(-seen, nth - 1, axis=1)[:, nth - 1]
        radius = np.sqrt(np.clip(square - 2 * np.maximum(near, -square), 1e-12, 2 * square))
    radius = np.minimum(radius, 2 * np.sqrt(square))
    out, counted, verified = [[], [], []], 0, 0
    for begin in range(0, len(queries), CHUNK):
        left = np.arange(begin, min(begin + CHUNK, len(queries)))
        count = np.zeros((len(left), n), np.int16)
        middle = np.stack([np.searchsorted(arrays[i], p[left, i]) for i in range(lines)])
        seen, held = np.zeros((len(left), n), bool), {}
        was = middle.copy(), middle.copy()
        while len(left):
            reach = HALF * radius[left]
            lo = np.stack([np.searchsorted(arrays[i], p[left, i] - reach, "left") for i in range(lines)])
            hi = np.stack([np.searchsorted(arrays[i], p[left, i] + reach, "right") for i in range(lines)])
            lo, hi = np.minimum(lo, was[0][:, left - begin]), np.maximum(hi, was[1][:, left - begin])
            again = []
            for j, q in enumerate(left):
                old, new = (was[0][:, q - begin], was[1][:, q - begin]), (lo[:, j], hi[:, j])
                added, outside = int((old[0] - new[0] + new[1] - old[1]).sum()), int((n - new[1] + new[0]).sum())
                if added <= outside:  # the entries that the windows have gained, or those still outside: whichever are fewer
                    parts = [x for i in range(lines) for x in (order[i, new[0][i] : old[0][i]], order[i, old[1][i] : new[1][i]])]
                    count[q - begin] += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
                else:
                    parts = [x for i in range(lines) for x in (order[i, : new[0][i]], order[i, new[1][i] :])]
                    count[q - begin] = lines - np.bincount(np.concatenate(parts), minlength=n)
                counted += min(added, outside)
                at = np.flatnonzero((count[q - begin] >= least) & ~seen[q - begin])  # those that the wider windows have added
                seen[q - begin, at] = True
                at = at[at != own[q]]
                product = vectors[at] @ queries[q]
                verified += len(at)
                if floor is not None:
                    keep = product >= floor[q]
                    at, product = at[keep], product[keep]
                if q in held:
                    at, product = np.concatenate([held[q][0], at]), np.concatenate([held[q][1], product])
                if len(at) > k:
                    keep = product >= np.partition(product, len(at) - k)[len(at) - k]
                    at, product = at[keep], product[keep]
                    best = np.lexsort((ids[at], -product))[:k]
                    at, product = at[best], product[best]
                held[q] = at, product
                if not fixed and not seen[q - begin].all():
                    reached = math.sqrt(max(square[q] - 2 * product.min(), 0.0)) if len(at) >= k else GROWTH * radius[q]
                    if reached > radius[q]:
                        again.append(q)
                        radius[q] = reached
                        continue
                out[0].append(np.full(len(at), q))
                out[1].append(at)
                out[2].append(product)
            was[0][:, left - begin], was[1][:, left - begin] = lo, hi
            left = np.array(again, np.int64)
    got = tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64)))
    return *got, counted, verified


def usable(vector: str) -> Column:
    """Not null, not empty, and no component null or not finite; not all zero."""
    v = F.col(vector).cast("array<double>")
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _by_length(batch, column: str = "v"):
    """(length, places of its rows, their vectors as a matrix), for each length in a batch or table."""
    v = batch.column(column)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    d = batch.column("d").to_numpy()
    for x in np.unique(d).tolist():
        at = np.flatnonzero(d == x)
        yield x, at, v.take(pa.array(at)).flatten().to_numpy().reshape(-1, x)


def _routes(d: int, lines: int) -> np.ndarray:
    return np.random.default_rng([11, d]).standard_normal((lines, d + 1))


def _keys(vectors: np.ndarray, longest: float, lines: int) -> np.ndarray:
    """Projections on the routing lines, the added coordinate included."""
    return np.c_[vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))] @ _routes(vectors.shape[1], lines).T


def nearest(vectors: DataFrame, asked: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that asked marks about the k rows with the largest inner product, nearest first, ties to the smaller vec_id.

    A row is no candidate of its own; other rows are, those of its id included, and rows that repeat are candidates and queries as often as they occur. Vectors that
    are null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors meet those of their own length only. Fewer than k
    candidates give fewer rows, none gives none; so does an empty table. Scores are exact, in double precision. Other columns are ignored. A table may
    hold vectors of any number of lengths.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    rows = vectors.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = spill(rows.withColumn("d", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = spill(rows.groupBy("d").agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.count_if("asked").alias("m")).where("m > 0"), "lengths")
    some, out = sizes.toLocalIterator(), None
    while True:
        part = list(islice(some, MOST_LENGTHS))
        if part or out is None:
            found = _nearest(rows, part, k)
            out = found if out is None else out.unionByName(found)
        if len(part) < MOST_LENGTHS:
            break
    forget(rows, sizes)
    return out


def _nearest(rows: DataFrame, sizes: list, k: int) -> DataFrame:
    """nearest() for the rows (id, v, asked, d, row) of some lengths; sizes: d, n, longest of each."""
    spark = rows.sparkSession
    plan = {}
    for s in sizes:
        blocks = math.ceil(s["n"] / BLOCK)
        lines = max(1, min(ROUTES, int(math.log2(blocks))))
        ranges = math.ceil(blocks ** (1 / lines) - 1e-9)
        drawn = rows.where((F.col("d") == s["d"]) & (uniform("row", seed=12) < SAMPLE / s["n"])).select("d", "v").limit(2 * SAMPLE).toArrow() if ranges > 1 else None
        keys = next((_keys(x, s["longest"], lines) for _, _, x in _by_length(drawn)), np.zeros((0, lines))) if drawn is not None else np.zeros((0, lines))
        cuts = np.quantile(keys, [i / ranges for i in range(1, ranges)], axis=0).T if len(keys) else np.zeros((lines, 0))
        plan[s["d"]] = s["longest"], lines, cuts
    sent = spark.sparkContext.broadcast(plan)

    def cells(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The number of each row's cell, its ranges on the routing lines as digits."""
        out = np.zeros(len(keys), np.int64)
        for j, c in enumerate(cuts):
            out = out * (len(c) + 1) + np.searchsorted(c, keys[:, j], "right")
        return out

    def place(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, np.int64)
            for d, at, x in _by_length(b):
                longest, lines, cuts = sent.value[d]
                cell[at] = cells(_keys(x, longest, lines), cuts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    known = rows.where(F.col("d").isin([s["d"] for s in sizes])) if sizes else rows.where("false")
    placed = spill(known.mapInArrow(place, rows.withColumn("cell", F.lit(0).cast("long")).schema), "placed")
    counts = spill(placed.groupBy("d", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("subs")), "cells")
    data = placed.join(small(counts), ["d", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), "subs")).select("d", "cell", "sub", "id", "row", "v", "asked")

    def answers(left: pa.Table, right: pa.Table | None):
        """Rows found in a block (left) for the queries in it, or for those in right, which bring a radius."""
        d = left.column("d")[0].as_py()
        longest = sent.value[d][0]
        _, _, x = next(_by_length(left))
        ids, row = left.column("id").to_numpy(), left.column("row").to_numpy()
        if right is None:
            own = np.flatnonzero(left.column("asked").to_numpy(zero_copy_only=False))
            q, query_id, query_row, near = x[own], ids[own], row[own], (None, None)
        else:
            _, _, q = next(_by_length(right, "q_v"))
            query_id, query_row = right.column("q_id").to_numpy(), right.column("q_row").to_numpy()
            near = right.column("radius").to_numpy(), right.column("floor").to_numpy()
            own = np.full(len(q), -1)
        j, i, s, _, _ = search(x, ids, q, own, k, longest, *near) if len(q) else (*(np.zeros(0, t) for t in (np.int64, np.int64, np.float64)), 0, 0)
        return pa.table([pa.array(c) for c in (query_row[j], query_id[j], ids[i], s)], names=["q_row", "query_id", "vec_id", "score"])

    schema = "q_row long, query_id long, vec_id long, score double"
    home = spill(data.groupBy("d", "cell", "sub").applyInArrow(lambda part: answers(part, None), schema), "home")
    kth = F.sort_array(F.collect_list("score"), asc=False)
    bounds = home.groupBy("q_row").agg(F.get(kth, F.lit(k - 1)).alias("floor"))
    asking = data.where("asked").join(bounds, data["row"] == bounds["q_row"], "left").select("d", "cell", "sub", "id", "row", "v", "floor")

    def route(batches):
        for b in batches:
            floor = b.column("floor")
            floor = np.where(floor.is_valid().to_numpy(zero_copy_only=False), floor.fill_null(0).to_numpy(), -np.inf)
            at_, cell_, radius_ = [], [], []
            for d, at, x in _by_length(b):
                longest, lines, cuts = sent.value[d]
                square = (x**2).sum(1) + longest**2
                radius = np.sqrt(np.clip(square - 2 * np.maximum(floor[at], -square), 0, None))
                keys = x @ _routes(d, lines)[:, :d].T
                lo = np.stack([np.searchsorted(c, keys[:, j] - REACH * radius, "right") for j, c in enumerate(cuts)], 1)
                hi = np.stack([np.searchsorted(c, keys[:, j] + REACH * radius, "right") for j, c in enumerate(cuts)], 1)
                for place_, r, low, high in zip(at.tolist(), radius.tolist(), lo.tolist(), hi.tolist()):
                    cell = [0]
                    for c, x0, x1 in zip(cuts, low, high):
                        cell = [y * (len(c) + 1) + z for y in cell for z in range(x0, x1 + 1)]
                    at_ += [place_] * len(cell)
                    cell_ += cell
                    radius_ += [r] * len(cell)
                    if len(cell_) >= 10_000:
                        yield parts(b, at_, cell_, radius_, floor)
                        at_, cell_, radius_ = [], [], []
            if cell_:
                yield parts(b, at_, cell_, radius_, floor)

    def parts(b, at, cell, radius, floor):
        at = np.array(at)
        return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("d", "cell", "sub", "id", "row", "v")), pa.array(cell, pa.int64()), pa.array(radius), pa.array(floor[at])], ["d", "home", "home_sub", "q_id", "q_row", "q_v", "q_cell", "radius", "floor"])

    visits = asking.mapInArrow(route, "d int, home long, home_sub long, q_id long, q_row long, q_v array<double>, q_cell long, radius double, floor double")
    visits = visits.join(small(counts.withColumnsRenamed({"d": "c_d", "cell": "c_cell"})), (F.col("d") == F.col("c_d")) & (F.col("q_cell") == F.col("c_cell")))
    visits = visits.withColumn("q_sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).where("q_cell <> home OR q_sub <> home_sub")
    visits = spill(visits.select("d", "q_cell", "q_sub", "q_id", "q_row", "q_v", "radius", "floor"), "visits")
    groups = spill(visits.groupBy("d", F.col("q_cell").alias("cell"), F.col("q_sub").alias("sub")).agg(F.ceil(F.count("*") / QUERIES).alias("groups")), "groups")
    tiles = data.drop("asked").join(small(groups), ["d", "cell", "sub"]).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    callers = visits.withColumnsRenamed({"q_cell": "cell", "q_sub": "sub"}).join(small(groups), ["d", "cell", "sub"]).withColumn("grp", F.pmod(F.xxhash64("q_row"), "groups"))
    key = ["d", "cell", "sub", "grp"]

    def elsewhere(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=["q_row", "query_id", "vec_id", "score"])
        return answers(left, right)

    found = tiles.select(*key, "id", "row", "v").groupBy(*key).cogroup(callers.select(*key, "q_id", "q_row", "q_v", "radius", "floor").groupBy(*key)).applyInArrow(elsewhere, schema)
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    ranked = home.union(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    ranked = spill(ranked, "nearest")
    forget(placed, counts, home, visits, groups)
    return ranked
