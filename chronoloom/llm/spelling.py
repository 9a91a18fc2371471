"""Grouping spelling variants: a trie self-join with active-node sets over a partitioned vocabulary.

Two words at distance one agree before and after the place of their edit. So the places are cut into windows: for words whose shorter one has c letters, first the
halves [0, c // 2) and [c // 2, c + 1). Words that agree before and after a window form a group, whose tries hold what lies between; from the root down, a node's
active nodes (those at distance one) follow from its parent's, and pairs are emitted where two words end. A pair belongs to the window of its first difference,
so it is found once. A group that holds too many letters is cut into the halves of its window, which asks for longer agreement; a window of one place leaves few
words, so hot prefixes and very long words end in small groups. Groups are dealt to tasks by hash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, modest_batches, small, spill
from .textkit import release

#: Letters of a group between its window's ends beyond which it is cut, and letters dealt to a task on average.
GROUP_LETTERS, TASK_LETTERS = 1 << 18, 1 << 19
#: Deletes a letter of a document's word where a hash of the two is a multiple of it.
EVERY = 199
_KEYED = "word string, n long, key long, c int, lo int, hi int"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 6, min_count: int = 5, every: int = EVERY) -> DataFrame:
    """word, n: maximal runs of [A-Za-z\\u00C0-\\u00FF] in whole texts, A-Z in lower case, with one letter deleted where every divides crc32("<doc_id>:<run>") (a null id is
    "null"; every 0: never), that have at least min_chars code points and occur at least min_count times. Each batch of texts is counted before it is shuffled."""
    runs = re.compile(f"[a-z\\u00c0-\\u00ff]{{{min_chars},}}")  # a run that is shorter has no word

    def run(batches):
        for b in batches:
            total: Counter = Counter()
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                found = Counter(runs.findall(t.encode().lower().decode()))  # of bytes only A-Z have a lower case
                seed = zlib.crc32(f"{'null' if i is None else i}:".encode())
                for w, n in found.items():
                    h = zlib.crc32(w.encode(), seed) if every else 1
                    if every and h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < min_chars:
                            continue
                    total[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        release()

    counted = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(words: DataFrame, windows: Column) -> DataFrame:
    """words (word, n) in each of windows (array of c, lo, hi): the key is what a window's words agree on."""
    at = words.withColumn("w", F.explode(windows)).select("word", "n", "w.*")
    after = F.expr("right(word, greatest(c - hi, 0))")
    return at.select("word", "n", F.xxhash64("c", "lo", "hi", F.expr("left(word, lo)"), after).alias("key"), "c", "lo", "hi")


def _halves(c: Column, lo: Column, hi: Column) -> Column:
    mid = (F.floor((lo + hi) / 2)).cast("int")
    return F.array(*(F.struct(c.cast("int").alias("c"), a.cast("int").alias("lo"), b.cast("int").alias("hi")) for a, b in ((lo, mid), (mid, hi))))


def distance_one(group: list[tuple[str, int]]):
    """Index pairs of distinct strings at distance one, by a trie whose nodes carry their active nodes on the way down. A node is (children, string's index)."""
    root: list = [{}, -1]
    for i, (s, _) in enumerate(group):
        node = root
        for x in s:
            node = node[0].setdefault(x, [{}, -1])
        node[1] = i
    stack = [(root, list(root[0].values()))]
    while stack:
        node, active = stack.pop()
        children = node[0]
        if node[1] >= 0:
            yield from ((node[1], other[1]) for other in active if other[1] > node[1])
        for x, child in children.items():
            near = {id(node): node}  # a letter more
            for other in children.values():  # another letter
                near[id(other)] = other
            for other in child[0].values():  # a letter less
                near[id(other)] = other
            for other in active:  # the same letter
                if x in other[0]:
                    near[id(other[0][x])] = other[0][x]
            near.pop(id(child), None)
            stack.append((child, list(near.values())))


def _first_difference(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _joined(part: pa.Table) -> pa.Table:
    """A task's pairs, in both directions. Groups are told apart by what they agree on, not by its hash."""
    groups = defaultdict(list)
    for word, n, c, lo, hi in zip(*(part.column(x).to_pylist() for x in ("word", "n", "c", "lo", "hi"))):
        end = len(word) - max(c - hi, 0)
        groups[c, lo, hi, word[:lo], word[end:]].append((word[lo:end], word, n))
    out = []
    for (c, lo, hi, _, _), members in groups.items():
        if len(members) > 1:
            for i, j in distance_one([(m, 0) for m, _, _ in members]):
                (_, a, n), (_, b, m) = members[i], members[j]
                if min(len(a), len(b)) == c and lo <= _first_difference(a, b) < hi:
                    out += [(a, n, b, m), (b, m, a, n)]
    return pa.table([pa.array(list(x), t) for x, t in zip(zip(*out) if out else ([],) * 4, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "near", "m"])


def near_words(words: DataFrame) -> DataFrame:
    """words (distinct word, n) -> word, n, near, m: all pairs of words that differ by exactly one inserted, deleted or replaced code point, in both directions.
    Words may have any length of at least one; empty ones and nulls are passed over."""
    words = words.where("word <> ''").select("word", F.col("n").cast("long").alias("n"))
    size, whole = F.char_length("word"), lambda c: F.struct(c.cast("int").alias("c"), F.lit(0).alias("lo"), (c + 1).cast("int").alias("hi"))
    cut = lambda c: F.when(c > 1, _halves(c, F.lit(0), c + 1)).otherwise(F.array(whole(c)))
    classes = F.when(size > 1, F.concat(cut(size), cut(size - 1))).otherwise(cut(size))  # with words of its own length or one more, and with shorter ones
    todo, done, written = spill(_keyed(words, classes), "groups"), [], []
    letters = F.char_length("word") - F.col("lo") - F.greatest(F.col("c") - F.col("hi"), F.lit(0)) + 1
    while True:
        written.append(todo)
        per = todo.groupBy(F.col("key").alias("k")).agg(F.sum(letters).alias("letters"), F.max(F.col("hi") - F.col("lo")).alias("width"), F.count("*").alias("words"))
        hot = spill(per.where(f"letters > {GROUP_LETTERS} AND width > 1 AND words > 1").select("k"), "hot")
        written.append(hot)
        if not hot.limit(1).count():
            done.append(todo)
            break
        is_hot = (F.col("key") == F.col("k")) & (F.col("hi") - F.col("lo") > 1)
        done.append(todo.join(small(hot), is_hot, "left_anti"))
        inside = todo.join(small(hot), is_hot, "left_semi")
        todo = spill(_keyed(inside.select("word", "n", F.struct("c", "lo", "hi").alias("old")), _halves(F.col("old.c"), F.col("old.lo"), F.col("old.hi"))), "groups")
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    total = sum(t.agg(F.coalesce(F.sum(letters), F.lit(0))).first()[0] for t in done)
    tasks = max(32, -(-total // TASK_LETTERS))
    pairs = rows.withColumn("task", F.pmod("key", F.lit(tasks))).groupBy("task").applyInArrow(_joined, "word string, n long, near string, m long")
    out = spill(pairs, "near")
    forget(*written)
    return out


def forms(words: DataFrame, times: int = 5) -> DataFrame:
    """words (distinct word, n) -> word, form, root, n, n_near, form_n.

    form is the near word (see near_words) of the largest n, ties to the smallest in code-point order, if its n is at least times the word's; root follows forms to the last, and is
    the word itself without one. n_near counts near words. Forms grow times-fold at each step, so following them ends after a few doublings of the step.
    """
    words = spill(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("near", "string"), ("m", "long"))]
    per = near.unionByName(words.select("word", "n", *nothing)).groupBy("word", "n").agg(F.count("near").alias("n_near"), F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("m")).alias("m"), "near"))).alias("best"))
    big = -F.col("best.m") >= times * F.col("n")
    told = spill(per.select("word", "n", "n_near", F.when(big, F.col("best.near")).alias("form"), F.when(big, -F.col("best.m")).alias("form_n")), "forms")
    forget(words, near)

    last = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that are followed
        last = spill(last, "roots")
        ahead = last.select(F.col("word").alias("w"), F.col("root").alias("further"))
        step = last.join(ahead, F.col("root") == F.col("w"), "left")
        if not step.where("further IS NOT NULL").limit(1).count():
            break
        last = step.select("word", F.coalesce("further", "root").alias("root"))
    roots = last.select(F.col("word").alias("w"), "root")
    return told.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 6, min_count: int = 5, times: int = 5, every: int = EVERY) -> DataFrame:
    """forms() of the documents' vocabulary().

    Null and empty texts hold no word; very long texts and words are taken whole. Rows of equal id and text count as often as they stand; a null id is hashed as "null". Of near words
    that occur equally often the first in code-point order is the form. No rows give no rows; columns of docs beyond the two aren't read.
    """
    modest_batches(docs.sparkSession)
    return forms(vocabulary(docs, doc_id, text, min_chars, min_count, every), times)
