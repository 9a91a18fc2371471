import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from chronoloom.llm import spelling as S


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, times=5):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def brute_vocabulary(rows, min_chars=6, min_count=5):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= min_chars and n >= min_count}


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def some_words(rng, n, letters="abé", most=9):
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, most))): rng.choice([1, 5, 5, 25, 26, 130, 700]) for _ in range(n)}


@pytest.mark.parametrize("limit", [1 << 18, 6])
def test_forms_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "GROUP_LETTERS", limit)  # the smaller one cuts nearly all windows
    rng = random.Random(limit)
    words = some_words(rng, 400) | {"the" * 20: 9, "the" * 20 + "s": 80, "a": 3, "b": 15, "ab": 75, "x" * 3000: 5, "x" * 2999: 25, "x" * 1500 + "y" + "x" * 1499: 125}
    got = S.forms(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert rows_of(got) == brute_forms(words)


def test_pairs_come_once_in_each_direction(spark):
    words = some_words(random.Random(2), 300, "ab")
    got = S.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert len(got) == len({(r["word"], r["near"]) for r in got}) and {(r["near"], r["word"]) for r in got} == {(r["word"], r["near"]) for r in got}


def test_hot_prefix_ends_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_LETTERS", 2000)
    rng = random.Random(7)
    words = {"prefix" + "".join(rng.choice("abcdefghij") for _ in range(6)): rng.choice([5, 30]) for _ in range(3000)}
    assert rows_of(S.forms(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute_forms(words)


def test_trie_join():
    rng = random.Random(9)
    for _ in range(50):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(20)})
        got = list(S.distance_one([(w, 0) for w in words]))
        assert sorted(got) == [(i, j) for i, j in combinations(range(len(words)), 2) if one_apart(words[i], words[j])]


def test_documents(spark, edge, edge_rows, clash, empty):
    more = [(1000 + i, "Straße strasse Strasse straße×÷ colour COLOUR color colours ÉTUDES études etudes " * (i % 7), None, None, None) for i in range(700)]
    docs = edge.union(spark.createDataFrame(more, edge.schema))
    words = brute_vocabulary([r[:2] for r in edge_rows + more])
    want = brute_forms(words)
    assert any(w[1] for w in want) and rows_of(S.group_spellings(docs)) == want
    assert rows_of(S.group_spellings(clash)) == brute_forms(brute_vocabulary([r[:2] for r in edge_rows]))
    assert S.group_spellings(empty).collect() == []


def test_nothing_is_deleted_on_request(spark):
    docs = spark.createDataFrame([(i, "letters and ciphers") for i in range(2000)], "doc_id long, text string")
    assert rows_of(S.vocabulary(docs, every=0)) == {("letters", 2000), ("ciphers", 2000)}
