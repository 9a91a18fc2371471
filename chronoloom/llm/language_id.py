"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit, over hashed byte n-grams, says on which side of the bit a text lies. The classifiers are trained
from the n-gram counts of all labelled texts, summed by language where they lie and then in rounds of at most FAN parts, so no task gathers a row per task of
the pass before. Decoding takes the
codeword of least loss, each bit weighted by how well it parts its two sides; a small lead over the second marks the text as ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, modest_batches, spill
from .textkit import release

#: Slots of the hashed 2- and 3-grams together, and blocks in which their counts are summed.
SLOTS, BLOCKS = 1 << 15, 8
#: Bits of a codeword with more than EXHAUSTIVE languages.
EXHAUSTIVE, BITS = 6, 48
#: Least lead of the best language over the second, in loss a bit, below which a text is ambiguous.
LEAD = 0.05
#: Bytes of text hashed at once.
PIECE = 1 << 18
UNKNOWN = "und"
#: Parts of a sum that one task adds up, languages whose counts a task holds at once (256 KB each), and languages that are learned: of more those with the most texts.
FAN, HELD, MOST_LANGUAGES = 256, 64, 1024


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1 as rows: all ways to part few languages; else the random columns that keep the least distance between rows large."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        return np.array([(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]).T.astype(float)
    rng = np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, BITS))
        if (abs(code.sum(0)) == n).any():
            continue
        far = int((BITS - (code @ code.T - 2 * BITS * np.eye(n)).max()) / 2)
        if far > apart:
            best, apart = code, far
    return best


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the 3-grams and of the 2-grams that begin at each byte of the joined texts, and where each text begins and ends, in turn. Two zero bytes after each
    text keep its n-grams from the next one's."""
    parts = [t.lower().encode() + b"\0\0" for t in texts]
    a = np.frombuffer(b"".join(parts) + b"\0\0", np.uint8).astype(np.uint32)
    two = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77)
    three = two + a[2:] * np.uint32(0xC2B2AE3D)
    half = np.uint32(SLOTS // 2 - 1)
    three = ((three ^ (three >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(9)) & half
    two = (((two ^ (two >> np.uint32(15))) * np.uint32(0x165667B1) >> np.uint32(9)) & half) + np.uint32(SLOTS // 2)
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    return three, two, np.stack([start, start + size - 2], 1).ravel()


def _pieces(texts: list[str]):
    """Ranges of about PIECE bytes, and for each text the parts into which a long one is cut."""
    flat, owner = [], []
    for i, t in enumerate(texts):
        for lo in range(0, max(len(t), 1), PIECE):
            flat.append(t[lo : lo + PIECE])
            owner.append(i)
    lo = total = 0
    for i, t in enumerate(flat):
        if total and total + len(t) > PIECE:
            yield flat[lo:i], np.array(owner[lo:i])
            lo, total = i, 0
        total += len(t)
    if lo < len(flat):
        yield flat[lo:], np.array(owner[lo:])


def gram_counts(rows: DataFrame) -> DataFrame:
    """rows (text, lang) -> lang, block, counts (doubles, as bytes): n-gram counts, each text scaled to weight 1."""

    def partial(batches):
        sums: dict[str, np.ndarray] = {}

        def parts():
            for lang, total in sums.items():
                for block, x in enumerate(np.split(total, BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([block], pa.int32()), pa.array([x.tobytes()])], ["lang", "block", "counts"])
            sums.clear()

        for b in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            texts, langs = ([x or "" for x in b.column(i).to_pylist()] for i in range(2))
            for piece, owner in _pieces(texts):
                three, two, at = _grams(piece)
                for i, lo, hi in zip(owner, at[::2], at[1::2]):
                    if hi > lo:
                        if langs[i] not in sums and len(sums) >= HELD:
                            yield from parts()
                        got = np.bincount(np.concatenate([three[lo:hi], two[lo:hi]]).astype(np.int64), minlength=SLOTS)
                        sums.setdefault(langs[i], np.zeros(SLOTS))
                        sums[langs[i]] += got / (hi - lo)
        yield from parts()

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in part.column("counts"))
        return pa.table([part.column("lang").slice(0, 1), part.column("block").slice(0, 1), pa.array([total.tobytes()])], names=["lang", "block", "counts"])

    schema = "lang string, block int, counts binary"
    now = spill(rows.select("text", "lang").mapInArrow(partial, schema), "grams")
    while (most := now.groupBy("lang", "block").count().agg(F.max("count")).first()[0] or 0) > 1:
        few = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-most // FAN))) if most > FAN else F.lit(0)
        after = now.withColumn("part", few).groupBy("lang", "block", "part").applyInArrow(add, schema)
        after = spill(after, "grams")
        forget(now)
        now = after
    return now


def train(rows: DataFrame) -> dict:
    """rows (text, lang; both not null) -> model: languages in order, their codewords, slot weights by bit, bit weights. Of more than MOST_LANGUAGES values those with the most
    texts are learned, the first in code-point order of equally frequent ones; texts of the others get the nearest of these."""
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").select(F.col("lang").alias("_lang")).limit(MOST_LANGUAGES + 1)
    frequent = [r["_lang"] for r in frequent.collect()]  # a name each
    if len(frequent) > MOST_LANGUAGES:
        rows = rows.where(F.col("lang").isin(frequent[:MOST_LANGUAGES]))
    counts = gram_counts(rows)
    got = counts.toPandas()  # BLOCKS rows of 32 KB a language
    forget(counts)
    langs = sorted(got["lang"].unique()) if len(got) else []
    if not langs:
        return {"langs": [], "code": codewords(0), "slots": np.zeros((SLOTS, 1), np.float32), "bits": np.ones(1)}
    share = np.array([np.concatenate([np.frombuffer(x) for x in got[got["lang"] == g].sort_values("block")["counts"]]) for g in langs])
    share = (share + 1e-3 * share.sum(1, keepdims=True) / SLOTS + 1e-9) / share.sum(1, keepdims=True)
    code = codewords(len(langs))
    slots, bits = [], []
    for column in code.T:
        on, off = share[column > 0].mean(0) if (column > 0).any() else None, share[column < 0].mean(0) if (column < 0).any() else None
        w = np.log(on / off) if on is not None and off is not None else np.zeros(SLOTS)
        w = np.clip(w, -4, 4)
        margins = (share * w).sum(1) / share.sum(1)  # mean of each language's texts
        if on is not None and off is not None:
            lo, hi = margins[column < 0].max(), margins[column > 0].min()
            gap = max(hi - lo, 1e-3)
            w = 2 * (w - (hi + lo) / 2) / gap  # the nearest languages of the two sides come out at -1 and 1
        slots.append(w)
        bits.append(gap / (gap + 1) if off is not None and on is not None else 1.0)
    return {"langs": langs, "code": code, "slots": np.array(slots, np.float32).T.copy(), "bits": np.array(bits) / np.sum(bits)}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins (texts by bits) -> index of the language of least loss (the first of equals), score, lead over the second."""
    # A logistic loss per bit, weighted.
    loss = np.stack([(np.logaddexp(0, -2 * row * margins) * model["bits"]).sum(1) for row in model["code"]], 1)
    best = loss.argmin(1)
    at = np.arange(len(loss))
    odds = np.exp(-4 * (loss - loss[at, best][:, None]))
    lead = np.partition(loss, 1, 1)[:, 1] - loss[at, best] if loss.shape[1] > 1 else np.full(len(loss), 1.0)
    return best, 1 / odds.sum(1), lead


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def classify(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    texts = [t or "" for t in texts]
    sums, n = np.zeros((len(texts), model["slots"].shape[1])), np.zeros(len(texts))
    for piece, owner in _pieces(texts):
        three, two, at = _grams(piece)
        got = sum(np.add.reduceat(model["slots"][x], at, axis=0, dtype=np.float64)[::2] for x in (three, two))
        size = at[1::2] - at[::2]
        got[size == 0] = 0
        np.add.at(sums, owner, got)
        np.add.at(n, owner, 2.0 * size)
    known = np.array([has_letter(t) for t in texts], bool) & bool(model["langs"])
    if not model["langs"] or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    best, score, lead = decode(sums / np.maximum(n, 1)[:, None], model)
    return [model["langs"][k] if ok else UNKNOWN for k, ok in zip(best, known)], np.where(known, score, 0.0), known & (lead < LEAD)


def predict(docs: DataFrame, text: str, model: dict, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with language, score (0 to 1) and ambiguity; columns of docs of these names give way.

    Null texts and texts without a letter get "und", score 0, not ambiguous; so do all texts if nothing was labelled. Of equally near languages the first in
    order of code points wins, as ambiguous. Only text is read; equal texts get equal results; very long texts count as a whole. No rows give no rows.
    """
    out = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    at = next(i for i, c in enumerate(out) if c.lower() == text.lower())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lang, score, unsure = classify(part.column(at).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [*out, *names])
            release()

    schema = docs.select(*out).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    return docs.select(*out).mapInArrow(run, schema)


def is_held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Trains on the labelled texts of docs that aren't held out (crc32 of doc_id as text, modulo 3, is 1; a null doc_id isn't) and returns docs with held_out,
    lang_pred, score and ambiguous (columns of docs of these names give way). Null languages and texts aren't learned from; repeated rows count each time. What
    nulls, empty texts and ties get is said at predict()."""
    modest_batches(docs.sparkSession)
    labelled = docs.where(~is_held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    out = [c for c in docs.columns if c.lower() != "held_out"]
    return predict(docs.select(*out, is_held_out(doc_id).alias("held_out")), text, train(labelled))
