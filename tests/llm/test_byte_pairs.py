import hashlib
import random
import struct
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from chronoloom.llm import byte_pairs as B
from chronoloom.llm import queries

#: Letters of several scripts, marks, blanks of all kinds, signs, new letters, and special tokens.
ALPHABETS = ["abcdeinorst", "aab", "aaaaaaaaaa", "the ing'st", "éÀ́éEß", "ΣσςaΑΒ ", "中文字漢", " \t\x1c\x85 \xa0 \n", "0123٣Ⅷ½", "!?'\"--__", "😀👍🏽❤️", "İıſKͅ", "Ɤ՘\U00010d50\U00016ea0Ᲊ"]
SPECIAL = ["<|startoftext|>", "<|endoftext|>", "<|endoftext|", "'s", "'LL"]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(B.VOCABULARY)


@pytest.fixture(scope="module")
def ours():
    return B.Coder(Path(B.VOCABULARY).read_bytes())


def same(texts, theirs, ours):
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = ours.encode(t)
        assert got == struct.pack(f"<{len(want)}I", *want), t
        assert ours.decode(got).decode() == theirs.decode(want, skip_special_tokens=False), t


def test_equals_the_library(theirs, ours):
    rng = random.Random(3)
    texts = []
    for _ in range(4000):
        pool = "".join(rng.sample(ALPHABETS, rng.randrange(1, 5)))
        texts.append("".join(rng.choice(pool) if rng.random() < 0.95 else rng.choice(SPECIAL) for _ in range(rng.randrange(40))))
    texts += ["a" * n for n in range(1, 200)] + ["ab" * n for n in range(1, 60)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    texts += ["".join(chr(rng.randrange(0x20, 0x2FFFF)) for _ in range(40)).encode("utf-8", "ignore").decode() for _ in range(300)]
    same(texts, theirs, ours)


def test_long_words_are_linear(theirs, ours):
    rng = random.Random(4)
    same(["".join(rng.choice("etaoinshrdlu") for _ in range(200_000)), "a" * 200_000, "ha" * 100_000, "!" * 100_000], theirs, ours)


def test_compatible_pairs_are_those_that_merges_leave_apart(theirs, ours):
    rng, pieces = random.Random(5), ours.pieces
    inner = [s for s in pieces.id if ord(s[-1]) < 256 and s.isascii() and s.isalpha()]
    ends = [s for s in pieces.id if ord(s[-1]) >= 256 and all(chr(ord(c) % 256).isascii() and chr(ord(c) % 256).isalpha() for c in s)]
    for _ in range(5000):
        a, b = rng.choice(inner), rng.choice(ends)
        word = (a + b[:-1]) + chr(ord(b[-1]) - 256)
        if word.islower():
            pair = [pieces.id[a], pieces.id[b]]
            assert pieces.compatible(*pair) == (theirs.encode(word, add_special_tokens=False).ids == pair)


def test_bounded_memories_change_nothing(theirs, ours, monkeypatch):
    monkeypatch.setattr(B, "PAIRS", 3)
    monkeypatch.setattr(B, "WORDS", 2)
    monkeypatch.setattr(B, "TOKENS", 4)
    same(["the cat sat on the mat and other mats", "unbelievable antidisestablishmentarianism " * 3], theirs, B.Coder(ours.file))


def test_numbers_without_a_token_are_passed_over(ours):
    assert ours.decode(struct.pack("<4I", 512, 4_000_000_000, 49407, 70_000)) == b"in <|endoftext|>" and ours.decode(b"") == b""


def test_edges(spark, edge, edge_rows, clash, empty, theirs):
    want = {}
    for i, t, *_ in edge_rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.setdefault(i, set()).add((struct.pack(f"<{len(ids)}I", *ids), theirs.decode(ids, skip_special_tokens=False)))
    for docs in (edge, clash):
        coded = B.encode(docs, ids="score")  # takes the place of a column of that name
        got = B.decode(coded, ids="score", text="kept").collect()
        assert len(got) == len(edge_rows) and all((bytes(r["score"]), r["kept"]) in want[r["doc_id"]] for r in got)
        assert set(docs.columns) <= set(coded.columns)
    assert B.encode(empty).collect() == [] and B.decode(B.encode(empty)).collect() == []
    blank = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert B.decode(blank).first()["decoded"] == ""


def test_query_equals_the_library(spark, sf, theirs):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_byte_pair_codes"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = theirs.encode(d["text"] or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        assert got[d["doc_id"]] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_other_vocabularies_are_refused(tmp_path):
    spec = Path(B.VOCABULARY).with_name("byte_bpe_50k.json")
    with pytest.raises((ValueError, KeyError, TypeError)):
        B.Coder(spec.read_bytes())
