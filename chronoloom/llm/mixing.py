"""Mixing sources to target weights by Pareto order sampling.

All steps are aggregations, joins with the table of sources, and one window over a narrow slice of each source, so a source that holds a third of all rows
is no task of its own: ranks are cut into SLICES ranges whose words are summed first, and only the range in which a source's target falls is sorted. Rows that
tie in rank are told apart by their contents and a number of their own, whose digits cut a range that ties have filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, no_clash, running, small, spill

#: Ranges of rank per source and level (4096), and rows of a range that are sorted at once; a larger one is cut by the next digits.
DIGIT, SORTED_ROWS = 12, 500_000
#: Steps per doubling to which weights are rounded, so that a source's odds follow from sums over few classes; and the largest step.
STEPS, FARTHEST = 16, 1024
#: Expected copies are whole numbers of 2**-FINE, so that engines agree on them.
FINE = 30
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_weight(size: str | Column) -> Column:
    """Binary digits of a size: a document of 1000 words weighs 10, one of 10 words 4."""
    return F.length(F.bin(size)).cast("double")


def targets(sized: DataFrame, source: str, size: str, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """Per source: source_size, target. Sources in order of code points, null last, weigh weights in turn; a target that would be above most times its source's
    size stops there and the excess goes to the others by weight. With the sources in order of size a weight, the first whose share of what is left stays
    below its stop gives the level for itself and all after it. Both orders are running sums over ranges of sources, so many sources aren't one task."""
    t = running(sized.groupBy(source).agg(F.sum(size).alias("source_size")), [F.col(source).asc_nulls_last()], nth=F.lit(1))
    t = t.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("room", most * F.col("source_size") / F.col("weight"))
    t = running(t, [F.col("room").asc(), F.col(source).asc_nulls_last()], words=F.col("source_size"), open=F.col("weight"))
    words, weight = t.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (share * (words or 0) - most * (F.col("words") - F.col("source_size"))) / (F.lit(weight or 0.0) - F.col("open") + F.col("weight"))
    found = t.select("room", level.alias("level")).where("level <= room").agg(F.max(F.struct(-F.col("room"), "level"))["level"]).first()[0]  # of equal rooms the first, whose level is the largest
    cap = most * F.col("source_size")
    return t.select(source, "source_size", (F.least(F.lit(found) * F.col("weight"), cap) if found is not None else cap).cast("double").alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed only, in steps that SQL engines share."""
    x = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("double")
    return (x + 0.5) / float(1 << 48)


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, u / (1 - u) over p / (1 - p), as q / (1 + q): between 0 and 1, in the same order."""
    up, down = u * (1 - p), (1 - u) * p
    return up / (up + down)


def expected_copies(per: DataFrame, classes: DataFrame, most: float) -> DataFrame:
    """per (s, source_size, target), classes (s, k, words): s, k, whole and part, the expected copies of a document of a class as whole copies and 2**-FINE ths.

    They are in proportion to the class's weight 2 ** (k / STEPS) up to most, and give the target in sum: with the classes in falling order of weight, those
    before the first that stays below most get most.
    """
    w = F.pow(F.lit(2.0), F.col("k") / STEPS)
    t = classes.join(per, classes["s"].eqNullSafe(per["s"])).select(per["s"], "k", "words", "source_size", "target", w.alias("w"))
    falling = Window.partitionBy("s").orderBy(F.desc("k"))
    above = F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    mass = F.sum(F.col("words") * F.col("w")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("c", (F.col("target") - most * above) / F.nullif(mass, F.lit(0.0)))
    t = t.withColumn("c", F.max(F.when(F.col("c") * F.col("w") <= most * (1 + 1e-12), F.struct("k", "c"))).over(Window.partitionBy("s"))["c"])
    copies = F.when(F.col("target") >= most * F.col("source_size"), F.lit(most)).otherwise(F.greatest(F.least(F.col("c") * F.col("w"), F.lit(most)), F.lit(0.0)))
    e = F.floor(F.coalesce(copies, F.lit(0.0)) * float(1 << FINE) + 0.5).cast("long")
    return t.select("s", "k", "words", "source_size", "target", F.shiftright(e, FINE).alias("whole"), F.pmod(e, F.lit(1 << FINE)).alias("part"))


def mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 8, weight: str | None = None, text: str = "text") -> DataFrame:
    """docs with size, source_size, target, copies (int), taken (long); columns of docs of these names give way.

    Each source is to yield target words (see targets). A document's expected copies are in proportion to the column weight (finite, above zero, rounded to
    STEPS steps a doubling; null counts as 1), up to most, and make up the target. Their whole part is certain; for the rest, documents are drawn by Pareto
    order sampling: with u uniform and p what is left of the expected copies, the smallest u / (1 - u) over p / (1 - p) are taken until the source's rest is
    filled, the last one only if that brings the words nearer to the target. u comes from doc_id and seed alone (for a null id from source, size
    and the column text, if there is one), so reruns agree. Rows that tie in rank (repeated ids) go by these and then by all columns, and equal rows one by one,
    so that taken words come near the target whatever repeats. Null text has size 0; a null source is a source; very long texts count whole. A source without words gets target 0. No rows give no rows. docs are
    written once with their sizes; only tables of sources meet them.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")]
    sz, k, u, h, g, r = no_clash(docs.select(*kept), "_words", "_class", "_u", "_hash", "_all", "_row")
    step = F.round(F.log2(F.coalesce(F.col(weight).cast("double"), F.lit(1.0))) * STEPS) if weight else F.lit(0)
    hashed = [F.col(f"`{c}`") if not isinstance(docs.schema[c].dataType, T.MapType) else F.map_entries(f"`{c}`") for c in kept]
    base = docs.select(*kept, size.cast("long").alias(sz), F.greatest(F.least(step, F.lit(FARTHEST)), F.lit(-FARTHEST)).cast("int").alias(k), F.xxhash64(*hashed).alias(g), F.monotonically_increasing_id().alias(r))
    base = base.withColumn(h, F.xxhash64(doc_id, source, sz, *(F.col(f"`{c}`") for c in kept if c.lower() == text.lower())))
    base = base.withColumn(u, draw(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null"), F.col(h).cast("string"))), seed))
    base = spill(base, "sized")

    narrow = base.select(F.col(source).alias("s"), F.col(k).alias("k"), F.col(sz).alias("size"), F.col(u).alias("u"), F.col(h).alias("h"), F.xxhash64(g, r).alias("x"), F.col(g).alias("g"), F.col(r).alias("r"))
    per = spill(targets(narrow, "s", "size", share, most, weights), "sources")
    classes = narrow.groupBy("s", "k").agg(F.sum("size").alias("words"))
    plan = spill(expected_copies(per, classes, most), "classes")
    rest = plan.groupBy("s").agg((F.sum((F.col("part") * F.col("words")).cast("decimal(38,0)")).cast("double") / float(1 << FINE)).alias("rest"))

    p = F.col("part") / float(1 << FINE)
    cell = F.least(F.floor(pareto_rank(F.col("u"), p) * float(1 << 48)), F.lit((1 << 48) - 1)).cast("long")
    open_ = plan.where("part > 0").select(F.col("s").alias("ps"), F.col("k").alias("pk"), "part")
    ranked = narrow.join(small(open_), F.col("s").eqNullSafe(F.col("ps")) & (F.col("k") == F.col("pk"))).select("s", "size", cell.alias("q"), "h", "g", "x", "r")
    levels = [F.shiftright("q", 48 - DIGIT * (i + 1)).bitwiseAND((1 << DIGIT) - 1) for i in range(4)]
    levels += [F.shiftright(c, 64 - DIGIT).cast("long") + (1 << (DIGIT - 1)) if not i else F.shiftrightunsigned(c, 64 - DIGIT * (i + 1)).bitwiseAND((1 << DIGIT) - 1) for c in ("h", "g", "x") for i in range(2)]
    state = spill(rest.select("s", "rest", F.lit(0).cast("long").alias("before")), "edges")  # the words before the range in which a source's cut falls
    inside, cut_at = ranked, []
    for level, digit in enumerate(levels):
        at = f"d{level}"
        cut_at.append(at)
        inside = inside.withColumn(at, digit.cast("long"))
        here = inside.join(small(state.withColumnsRenamed({c: f"e_{c}" for c in state.columns})), F.col("s").eqNullSafe(F.col("e_s")) & (F.lit(True) if not level else F.expr(" AND ".join(f"{c} = e_{c}" for c in cut_at[:-1]))))
        sums = here.groupBy("s", at).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("e_rest").alias("rest"), F.first("e_before").alias("before"), *(F.first(f"e_{c}").alias(c) for c in cut_at[:-1]))
        so_far = Window.partitionBy("s").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(so_far)).withColumn("last", F.max(at).over(Window.partitionBy("s")))
        edge = sums.where(f"upto >= rest OR {at} = last").groupBy("s").agg(F.min_by(F.struct("rest", (F.col("upto") - F.col("words")).alias("before"), "rows", *cut_at), at).alias("e"))
        new = spill(edge.select("s", "e.*"), "edges")
        forget(state)
        state = new
        if (state.agg(F.max("rows")).first()[0] or 0) <= SORTED_ROWS:
            break
    here = inside.join(small(state.withColumnsRenamed({c: f"e_{c}" for c in state.columns})), F.col("s").eqNullSafe(F.col("e_s")) & F.expr(" AND ".join(f"{c} = e_{c}" for c in cut_at)))
    one = Window.partitionBy("s").orderBy("q", "h", "g", "x", "r").rowsBetween(Window.unboundedPreceding, 0)
    upto = here.withColumn("upto", F.col("e_before") + F.sum("size").over(one))
    cuts = upto.groupBy(F.col("s").alias("c")).agg(
        F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("e_rest"), F.struct("q", "h", "g", "x", "r"))).alias("cut"), F.min(F.struct("q", "h", "g", "x", "r")).alias("first")
    )
    whole = spill(plan.join(cuts, F.col("s").eqNullSafe(F.col("c")), "left").drop("c"), "plan")
    forget(per, plan, state)

    hidden = dict(zip(whole.columns, no_clash(base, *(f"_{c}" for c in whole.columns))))
    at = {c: F.col(v) for c, v in hidden.items()}
    rows = base.join(small(whole.withColumnsRenamed(hidden)), F.col(source).eqNullSafe(at["s"]) & (F.col(k) == at["k"]))
    p = at["part"] / float(1 << FINE)
    q = F.least(F.floor(pareto_rank(F.col(u), p) * float(1 << 48)), F.lit((1 << 48) - 1)).cast("long")
    mine = F.struct(q.alias("q"), F.col(h).alias("h"), F.col(g).alias("g"), F.xxhash64(g, r).alias("x"), F.col(r).alias("r"))
    extra = F.when(at["part"] == 0, False).otherwise(F.coalesce(F.when(at["cut"].isNotNull(), mine <= at["cut"]).otherwise(mine < at["first"]), F.lit(False)))
    copies = (at["whole"] + extra.cast("int")).cast("int")
    return rows.select(*(F.col(f"`{c}`") for c in kept), F.col(sz).alias("size"), at["source_size"].alias("source_size"), at["target"].alias("target"), copies.alias("copies"), (F.col(sz) * copies).alias("taken"))


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of mix()'s rows, each row as often as its copies say."""
    again = no_clash(mixed, "again")[0]
    return mixed.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*columns)
