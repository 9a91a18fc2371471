import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import fertility as Fe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x1f #|", max_size=80), max_size=6))
def test_base_counts(texts):
    assert Fe.base_counts(texts) == [brute(t) for t in texts]


def test_edges(edge, edge_rows, clash, empty):
    for df in (edge, clash):
        got = Fe.judge(df).collect()
        assert len(got) == len(edge_rows)
        told = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
        assert told == sorted((str(r[0]), *brute(r[1])) for r in edge_rows)
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert r["kept"] == (not r["base_failed"] and r["reason"] is None)
    assert Fe.judge(empty).collect() == []


def test_bands_reject_what_is_no_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    junk = [(10**6 + i, t, "en") for i, t in enumerate(("丂\U0001f9ff " * 60 + "a b c d e f g h i j", "".join(chr(33 + (i * 7919) % 90) for i in range(2000)) + " x" * 3 + " a b c d e f g h"))]
    got = {r["doc_id"]: r for r in Fe.judge(docs.unionByName(spark.createDataFrame(junk, docs.schema))).collect()}
    assert not got[10**6]["kept"] and not got[10**6 + 1]["kept"]
    fine = [r for i, r in got.items() if i < 10**6 and not r["base_failed"]]
    assert sum(r["kept"] for r in fine) >= 0.97 * len(fine)


def test_bands_part_planted_symbol_runs_from_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = [r for r in Fe.judge(docs).collect() if not r["base_failed"]]
    junk = [r for r in got if r["n_symbols"] > 2 * r["n_words"]]
    clean = [r for r in got if 10 * r["n_symbols"] <= 3 * r["n_words"]]
    assert len(junk) > 30 and {r["lang"] for r in junk} == {"de", "en", "es", "fr"}
    assert sum(not r["kept"] for r in junk) >= 0.95 * len(junk)
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean)


def test_bands_end_on_both_sides(spark):
    """Long known words once each: more characters a token than prose has; random hexadecimal digits: more entropy than texts of that length have."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    known = "government development environment information understanding responsibility organizations relationship international communication".split()
    rich = " ".join(chr(0x4E00 + (i * 7919) % 20_000) for i in range(400))
    odd = [(10**6, " ".join(f"{a} {b}" for a in known for b in known if a != b), "en"), (10**6 + 1, rich, "en")]
    got = {r["doc_id"]: r for r in Fe.judge(docs.unionByName(spark.createDataFrame(odd, docs.schema))).where("doc_id >= 1000000").collect()}
    assert all(not r["base_failed"] and not r["kept"] for r in got.values()) and got[10**6]["reason"] == "chars_per_token"


def test_measures_of_a_text():
    v = Fe.Vocabularies(*(open(f"{Fe.VOCABULARIES}/{n}", "rb").read() for n in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))
    assert Fe.fertility("", v)[0] == 0
    n, chars, share, entropy = Fe.fertility("the cat sat on the mat", v)
    assert chars == pytest.approx(22 / 6) and share == 0 and 0 < entropy <= 1
    assert Fe.fertility("", v)[2] > 0.5
    assert Fe.fertility("x" * 200_000, v)[0] > 0
    assert Fe.script("привет мир") == "CYRILLIC" and Fe.script("123") == "none" and Fe.script("abc") == "LATIN"


def test_script_is_that_of_the_whole_text(spark):
    assert Fe.script("A Latin title of more than twenty letters\n" + "привет мир " * 50) == "CYRILLIC"
    assert Fe.script("https://example.com/some/long/address " + "漢字" * 200) == "CJK"
    assert Fe.script("привет, это начало текста из многих букв " + "word " * 500) == "LATIN"
    got = Fe.judge(spark.createDataFrame([(1, "Released under the MIT License and others\n" + "привет мир " * 50, None)], "doc_id long, text string, lang string")).first()
    assert got["lang"] == "script CYRILLIC"


def slow_reasons(rows):
    """The verdicts by plain loops from measured values: rows of (lang, n_tokens, chars_per_token, byte_share, entropy_share) that pass the base rules."""
    cells = {}
    for g, n, _, _, e in rows:
        cells.setdefault((g, n.bit_length()), []).append((math.log2(max(n, 1)), e))
    spread = sum(sum(x * x for x, _ in c) - sum(x for x, _ in c) ** 2 / len(c) for c in cells.values())
    slant = sum(sum(x * y for x, y in c) - sum(x for x, _ in c) * sum(y for _, y in c) / len(c) for c in cells.values())
    slope = round(slant / spread, 5) if spread > 1e-9 else 0.0
    means, by = {}, {}
    for g in {g for g, _ in cells}:
        off = [y - slope * x for (lang, _), c in cells.items() if lang == g for x, y in c]
        means[g] = sum(off) / len(off)
    for (g, k), c in cells.items():
        by.setdefault(k, []).extend(y - slope * x - means[g] for x, y in c)
    by = sorted((k, sum(v) / len(v)) for k, v in by.items() if len(v) >= Fe.LEAST_DOCS)
    off = np.interp(np.arange(65), *zip(*by)).round(5) if by else np.zeros(65)
    values = [(g, n, dict(zip(Fe.MEASURES, (c, b, e - slope * math.log2(max(n, 1)) - off[n.bit_length()])))) for g, n, c, b, e in rows]

    def band(part, m, all_):
        step, least, least_of_all, _ = Fe.MEASURES[m]
        x = sorted(math.floor(v[m] / step) for _, _, v in part)
        mid = x[(len(x) + 1) // 2 - 1]
        away = sorted(abs(y - mid) for y in x)[(len(x) + 1) // 2 - 1]
        return (mid + 0.5) * step, max((Fe.REACH_OF_ALL if all_ else Fe.REACH) * 1.4826 * away * step, least_of_all if all_ else least)

    langs = {g: [v for v in values if v[0] == g] for g, _, _ in values}
    out = []
    for g, n, v in values:
        rare, reason = len(langs[g]) < Fe.LEAST_DOCS, None
        for m, (*_, up) in Fe.MEASURES.items():
            mid, reach = band(values if rare else langs[g], m, rare)
            wider = 1 + Fe.SHORT / math.sqrt(max(n, 1))
            if reason is None and not mid - reach * wider <= v[m] <= mid + up * reach * wider and (m != "byte_share" or round(v[m] * n) >= Fe.FEWEST):
                reason = m
        out.append(reason)
    return out


def planted(prose):
    """Texts that one measure each tells from prose, by that measure; prose: ordinary texts."""
    rng = random.Random(3)
    symbols = [" ".join("".join(rng.choice("#*$%&|<>~^") for _ in range(6)) for _ in range(150)) for _ in prose]  # few characters a token
    faces = [" ".join(w if rng.random() < 0.93 else chr(0x1F600 + rng.randrange(60)) for w in t.split()[:300]) for t in prose]  # pieces fall back to bytes
    poor = [" ".join(rng.choice(t.split()[:25]) for _ in range(400)) for t in prose]  # few words over and over
    return {"chars_per_token": symbols, "byte_share": faces, "entropy_share": poor}


def test_verdicts_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    prose = [r["text"] for r in docs.where("lang = 'en' AND length(text) > 1500").orderBy("doc_id").limit(12).collect()]
    junk = [(10**6 + i, t, "en") for i, t in enumerate(t for texts in planted(prose).values() for t in texts)] + [(2 * 10**6, "une langue rare avec bien plus de dix mots dans son texte unique ici", "xx")]
    got = Fe.judge(docs.unionByName(spark.createDataFrame(junk, docs.schema))).collect()
    rows = [r for r in got if not r["base_failed"]]
    want = slow_reasons([(r["lang"], r["n_tokens"], r["chars_per_token"], r["byte_share"], r["entropy_share"]) for r in rows])
    assert [r["reason"] for r in rows] == want and len({*want}) >= 3
    assert all(r["chars_per_token"] is None and not r["kept"] for r in got if r["base_failed"])


def test_each_measure_tells_its_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    for lang in ("en", "de"):
        prose = [r["text"] for r in docs.where(f"lang = '{lang}' AND length(text) > 1500").orderBy("doc_id").limit(20).collect()]
        kinds = planted(prose)
        junk = [(10**6 + 1000 * k + i, t, lang) for k, texts in enumerate(kinds.values()) for i, t in enumerate(texts)]
        got = {r["doc_id"]: r for r in Fe.judge(docs.unionByName(spark.createDataFrame(junk, docs.schema))).collect()}
        for k, (measure, texts) in enumerate(kinds.items()):
            told = [r for r in (got[10**6 + 1000 * k + i] for i in range(len(texts))) if not r["base_failed"]]
            assert len(told) >= 8 and sum(r["reason"] is not None for r in told) >= 0.9 * len(told), (lang, measure)
            assert sum(r["reason"] == measure for r in told) >= 0.5 * len(told), (lang, measure, [r["reason"] for r in told])
        fine = [r for i, r in got.items() if i < 10**6 and not r["base_failed"] and 10 * r["n_symbols"] <= 3 * r["n_words"]]
        assert sum(r["kept"] for r in fine) >= 0.98 * len(fine)
