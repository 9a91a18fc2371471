import zlib

import numpy as np
import pytest

from chronoloom.llm import language_id as L


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 12):
        c = L.codewords(n)
        apart = min(int((a != b).sum()) for i, a in enumerate(c) for b in c[:i])
        assert c.shape[0] == n and apart >= (1 if n == 2 else 2 ** (n - 2) if n <= L.EXHAUSTIVE else L.BITS // 4)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = L.identify(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98
    assert np.mean([r["ambiguous"] for r in held]) <= 0.02
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(edge, clash, empty, edge_rows):
    for df in (edge, clash):
        got = L.identify(df).collect()
        assert len(got) == len(edge_rows)
        for r in got:
            letters = any(map(str.isalpha, r["text"] or ""))
            assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
            assert not letters or r["lang_pred"] in {"en", "de", "fr"}
    assert L.identify(empty).collect() == []


def test_prediction_reads_text_alone(spark, edge):
    model = L.train(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")], "text string, lang string"))
    texts = ["the dog and cat", "die katze und der hund", "le chien et le chat", None, "123"]
    alone = [L.classify([t], model) for t in texts]
    together = L.classify(texts, model)
    assert [a[0][0] for a in alone] == together[0] == ["en", "de", "fr", "und", "und"]
    assert [a[1][0] for a in alone] == pytest.approx(together[1].tolist())


def test_a_text_between_codewords_is_ambiguous():
    code = L.codewords(3)
    model = {"code": code, "bits": np.full(code.shape[1], 1 / code.shape[1])}
    best, score, lead = L.decode(np.stack([0 * code[0], code[2], 0.01 * code[1]]), model)
    assert (lead < L.LEAD).tolist() == [True, False, True] and best[1] == 2 and best[0] == 0 and score[1] > 0.5 > score[0]


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in L.identify(df).collect()] == [("und", 0.0)]


def test_one_language(spark):
    df = spark.createDataFrame([(i, "some text", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.identify(df).collect()} == {"en"}


def slow(labelled, texts):
    """The method by plain loops: counts of n-grams by slot, a log odds per codeword bit, weighted loss of the margins."""
    low = 1 << 32

    def slots(t):
        b = t.lower().encode()
        out = []
        for i in range(len(b)):
            two = (b[i] * 0x9E3779B1 + (b[i + 1] if i + 1 < len(b) else 0) * 0x85EBCA77) % low
            three = (two + (b[i + 2] if i + 2 < len(b) else 0) * 0xC2B2AE3D) % low
            out.append(((three ^ three >> 15) * 0x27D4EB2F % low >> 9) % (L.SLOTS // 2))
            out.append(((two ^ two >> 15) * 0x165667B1 % low >> 9) % (L.SLOTS // 2) + L.SLOTS // 2)
        return out

    langs = sorted({g for _, g in labelled})
    share = np.zeros((len(langs), L.SLOTS))
    for t, g in labelled:
        got = slots(t)
        for x in got:
            share[langs.index(g), x] += 2 / len(got)
    share = np.array([(row + 1e-3 * row.sum() / L.SLOTS + 1e-9) / row.sum() for row in share])
    out, code, bits = [], L.codewords(len(langs)), []
    for column in code.T:
        w = np.clip(np.log(share[column > 0].mean(0) / share[column < 0].mean(0)), -4, 4)
        m = [(row * w).sum() / row.sum() for row in share]
        lo, hi = max(x for x, c in zip(m, column) if c < 0), min(x for x, c in zip(m, column) if c > 0)
        gap = max(hi - lo, 1e-3)
        bits.append((2 * (w - (hi + lo) / 2) / gap, gap / (gap + 1)))
    total = sum(b for _, b in bits)
    for t in texts:
        if not any(map(str.isalpha, t or "")):
            out.append(("und", 0.0, False))
            continue
        got = slots(t)
        margins = [w[got].mean() for w, _ in bits]
        loss = [sum(b / total * np.log1p(np.exp(-2 * c * m)) for c, m, (_, b) in zip(word, margins, bits)) for word in code]
        best = int(np.argmin(loss))
        out.append((langs[best], 1 / sum(np.exp(-4 * (x - loss[best])) for x in loss), sorted(loss)[1] - loss[best] < L.LEAD))
    return out


def test_query_against_brute_force(spark, sf):
    from chronoloom.llm.queries import op7_output_codes

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    labelled = [(r["text"], r["lang"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["text"] and r["lang"] is not None]
    want = dict(zip([r["doc_id"] for r in docs], slow(labelled, [r["text"] for r in docs])))
    for r in op7_output_codes(spark, sf).collect():
        lang, score, unsure = want[r["doc_id"]]
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4) and r["ambiguous"] == unsure


def test_sums_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 3)
    monkeypatch.setattr(L, "HELD", 2)
    rows = [(f"some text number {i} of many", f"l{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string")
    one, many = (L.gram_counts(df.repartition(n)).collect() for n in (1, 23))
    sums = [{(r["lang"], r["block"]): np.frombuffer(r["counts"]) for r in x} for x in (one, many)]
    assert len(one) == len(many) == 5 * L.BLOCKS and all(sums[0][k] == pytest.approx(sums[1][k]) for k in sums[0])


def test_of_many_languages_the_most_frequent_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    rows = [(f"text {i} of l{i % 5}", f"l{i % 5}") for i in range(22)]  # l0 and l1 have five texts, the others four
    assert L.train(spark.createDataFrame(rows, "text string, lang string"))["langs"] == ["l0", "l1", "l2"]


def test_every_document_gets_a_language_whatever_the_labels(spark):
    rows = [(i, f"words of document {i} and some more of them", f"label{i % 1600}") for i in range(2000)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 2000 and all(r["lang_pred"].startswith("label") for r in got)


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de")] * 6)] + [(50, "the dog and a cat " * 60_000, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.identify(df).where("doc_id = 50").collect()} == {"en"}
