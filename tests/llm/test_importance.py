import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from chronoloom.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, ngrams):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, ngrams=(1, 1), buckets=10_000, min_words=20, percent=10):
    """(doc_id, n_words, n_features, weight, score, rank) of each row, sorted."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x, ngrams)[1]))
    for x in target:
        t.update(map(bucket, features(x, ngrams)[1]))
    S, T, out = sum(s.values()), sum(t.values()), []
    for i, x in docs:
        words, f = features(x, ngrams)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, f)]
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        out.append((i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), x))
    best = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    wanted = len(best) * percent // 100
    return out, [(r[4], r[0]) for r in best[:wanted]]


def held(got, docs, target, **how):
    want, best = brute(docs, target, **how)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted((r[:5] for r in want), key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(best) + 1)) and [(r["score"], r["doc_id"]) for r in ranked] == best


@pytest.mark.parametrize("how", [{}, {"ngrams": (1, 2), "buckets": 97, "min_words": 3, "percent": 50}])
def test_equals_brute_force(spark, edge, edge_rows, clash, how):
    target = [None, "", "w1a w2b w3c", "changed Text of its own"]
    there = spark.createDataFrame([(t,) for t in target], "text string")
    for docs in (edge, clash):
        held(I.resample(docs, there, **how).collect(), [r[:2] for r in edge_rows], target, **how)


def test_hot_buckets_are_many_groups(spark, edge, edge_rows, monkeypatch):
    monkeypatch.setattr(I, "POSTINGS", 50)  # a bucket's postings are dealt to many groups
    held(I.resample(edge, edge).collect(), [r[:2] for r in edge_rows], [r[1] for r in edge_rows])


def test_empty_tables(empty, edge, edge_rows):
    assert I.resample(empty, edge).collect() == []
    held(I.resample(edge, empty).collect(), [r[:2] for r in edge_rows], [])


def test_documents_like_the_target_are_drawn_more_often(spark):
    rows = [(i, " ".join(f"{'aim' if i % 2 else 'other'}{(i * 7 + j * 3) % 50}" for j in range(30))) for i in range(2000)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(r[1],) for r in rows if r[0] % 2][:100], "text string")
    told = I.resample(docs, target)
    taken = [r["doc_id"] for r in I.drawn(docs, told).collect()]
    assert len(taken) == 200 and sum(i % 2 for i in taken) > 120


def test_drawn_rows_have_all_columns(clash):
    told = I.resample(clash, clash, min_words=1, percent=100)
    assert I.drawn(clash, told).columns == clash.columns and I.drawn(clash, told).count() == told.where("rank IS NOT NULL").count()
