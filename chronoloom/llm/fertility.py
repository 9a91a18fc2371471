"""Tokeniser fertility as a quality rule, after a few base counts.

One pass per document with public vocabularies: characters per token, the share of tokens that fall back to bytes, and the entropy of the tokens. Histograms of
these over all documents, by language (by script where the language is unknown), give the bands outside which a document is rejected; they are one row per
language, measure and step, whatever the input's size, and stay tables: the driver sees a line's slope and a row per doubling of the number of tokens.
"""

from __future__ import annotations

import base64
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, modest_batches, small, spill
from .textkit import chunks, windows, words

VOCABULARIES = "/opt/tokenizers"
#: The pattern by which the byte vocabulary's makers split text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Measure: step of its histogram, least reach of a language's own band, least reach of the band of all languages, and how many times as far it reaches up as
#: down. Prose that the vocabulary knows well and texts of two languages lie high in the first and the last, so that side is wider.
MEASURES = {"chars_per_token": (0.005, 0.05, 0.25, 2.0), "byte_share": (0.001, 0.02, 0.05, 1.0), "entropy_share": (0.002, 0.02, 0.15, 2.0)}
#: Reach of a band in robust deviations (1.4826 times the median distance from the median). In a text of n tokens it is 1 + SHORT / sqrt(n) times as wide. The
#: band of all languages is for those too rare for one of their own; it spans whole languages and so is wider.
REACH, REACH_OF_ALL, SHORT = 3.0, 6.0, 7.0
#: Byte tokens below which their share says nothing.
FEWEST = 6
#: The column that a measure's band holds for.
JUDGED = {m: m for m in MEASURES} | {"entropy_share": "_entropy"}
#: Documents of a language below which the bands of all documents together hold for it.
LEAST_DOCS = 30
SYMBOLS = b"#*$%&|<>"
_SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy_share double"


class Vocabularies:
    """Tokenisers from files' bytes; what travels is the bytes."""

    def __init__(self, pieces: bytes, ranks: bytes):
        self.files = pieces, ranks
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def __reduce__(self):
        return Vocabularies, self.files


def script(text: str) -> str:
    """The script of most letters of the whole text: the first word of their Unicode names, or "none"."""
    seen: dict[str, int] = {}
    for c, n in Counter(text).items():
        if c.isalpha():
            name = unicodedata.name(c, "UNKNOWN").split(" ")[0]
            seen[name] = seen.get(name, 0) + n
    return max(seen, key=lambda k: (seen[k], k), default="none")


def base_counts(texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    raw, out = [t.encode() for t in texts], []
    symbol = np.isin(np.arange(256), list(SYMBOLS))
    for lo, hi in chunks(raw):
        h, starts, ends, at, arr = words(raw[lo:hi])
        w = windows(h, 5)
        points = np.concatenate([[0], np.cumsum((arr & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
        marks = np.concatenate([[0], np.cumsum(symbol[arr])])
        place = 0
        for i in range(lo, hi):
            a, b = at[i - lo], at[i - lo + 1]
            repeated = 0
            if b - a > 5:
                _, inverse, n = np.unique(w[a : b - 4], return_inverse=True, return_counts=True)
                twice = n[inverse] > 1
                if twice.any():
                    covered = np.zeros(b - a + 1, np.int64)
                    covered[:-5] += twice
                    covered[5:] -= twice
                    repeated = int((np.cumsum(covered) > 0)[: b - a].sum())
            seen, dup = set(), 0
            for line in raw[i].split(b"\n"):
                if line in seen:
                    dup += 1
                elif line.strip(b" \t\n\x0b\x0c\r"):
                    seen.add(line)
            end = place + len(raw[i]) + 1
            out.append((int(b - a), int(chars[b] - chars[a]), int(marks[end] - marks[place]), dup, repeated))
            place = end
    return out


def fails_base(n_words, n_repeat_words):
    """Fewer than 10 words, or over 20 % of them in repeated 5-word windows; of numbers or columns."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def fertility(text: str, v: Vocabularies) -> tuple[int, float | None, float | None, float | None]:
    """Tokens, characters per token (byte vocabulary), and share of byte tokens and entropy of the tokens over its most (pieces)."""
    ids = np.array(v.pieces.encode(text), np.int64)
    if not len(ids):
        return 0, None, None, None
    n = np.unique(ids, return_counts=True)[1]
    p = n / len(ids)
    entropy = float(-(p * np.log2(p)).sum())
    return len(ids), len(text) / len(v.bytes.encode_ordinary(text)), float(v.is_byte[ids].mean()), entropy / float(np.log2(len(ids))) if len(ids) > 1 else 1.0


def measure(docs: DataFrame, doc_id: str, text: str, lang: str | None, path: str) -> DataFrame:
    with open(f"{path}/piece_bpe_32k.model", "rb") as a, open(f"{path}/byte_bpe_50k.tiktoken", "rb") as b:
        sent = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def run(batches):
        v = Vocabularies(*sent.value)
        names = ["doc_id", "lang", *_SCHEMA_NAMES]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                texts = [t or "" for t in b.column(1).to_pylist()]
                langs = [g if g is not None else f"script {script(t)}" for g, t in zip(b.column(2).to_pylist(), texts)]
                told = [(*c, *((None,) * 4 if fails_base(c[0], c[4]) else fertility(t, v))) for c, t in zip(base_counts(texts), texts)]
                kinds = [pa.int64()] * 6 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), *(pa.array(c, k) for c, k in zip(zip(*told), kinds))], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang")).mapInArrow(run, _SCHEMA)


_SCHEMA_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")][2:]


def at_length(told: DataFrame):
    """A column: entropy_share less what a text of its length has. The share falls with the tokens, by far more than junk and clean texts differ.

    Within languages and doublings of n_tokens a line in their logarithm, and for each doubling of LEAST_DOCS documents or more how far it lies off that line.
    """
    x, doubling = F.log2(F.greatest("n_tokens", F.lit(1))), F.length(F.bin("n_tokens"))
    at = told.where("NOT base_failed AND entropy_share IS NOT NULL").select("lang", doubling.alias("k"), x.alias("x"), F.col("entropy_share").alias("y"))
    t = at.groupBy("lang", "k").agg(F.count("*").alias("n"), *(F.sum(e).alias(n) for n, e in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")))))
    t = spill(t, "lengths")
    spread, slant = t.agg(F.sum("xx") - F.sum(F.col("x") * F.col("x") / F.col("n")), F.sum("xy") - F.sum(F.col("x") * F.col("y") / F.col("n"))).first()
    slope = round(slant / spread, 5) if spread and spread > 1e-9 else 0.0
    t = t.select("lang", "k", "n", (F.col("y") - slope * F.col("x")).alias("off"))
    mean = t.groupBy(F.col("lang").alias("l")).agg((F.sum("off") / F.sum("n")).alias("mean"))
    by = t.join(mean, F.col("lang") == F.col("l")).groupBy("k").agg(F.sum(F.col("off") - F.col("n") * F.col("mean")).alias("off"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    by = sorted((r["k"], r["off"] / r["n"]) for r in by.collect())  # 64 rows at most
    off = np.interp(np.arange(65), *zip(*by)).round(5) if by else np.zeros(65)
    return F.col("entropy_share") - slope * x - F.get(F.array(*(F.lit(float(o)) for o in off)), doubling)


def bands(told: DataFrame) -> DataFrame:
    """lang, docs, and the middle and the reach of each measure's band, from the documents that pass the base rules; lang is null for all languages together.

    Middle: the median step of the measure's histogram. Reach: REACH robust deviations, the median distance of steps from it times 1.4826, at least that of MEASURES.
    """
    steps = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.floor(F.col(JUDGED[m]) / s).cast("long").alias("step")) for m, (s, *_) in MEASURES.items()))).alias("x")
    own = told.where("NOT base_failed").select("lang", steps).select("lang", "x.*").where("step IS NOT NULL").groupBy("lang", "measure", "step").agg(F.count("*").alias("n"))
    own = spill(own, "steps")
    both = own.unionByName(own.groupBy("measure", "step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))

    def middle(t: DataFrame, value: str) -> DataFrame:
        """lang, measure, the least value up to which half of the documents lie."""
        w = Window.partitionBy("lang", "measure")
        upto = t.withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
        return upto.where("2 * upto >= all").groupBy("lang", "measure").agg(F.min(value).alias("middle"), F.first("all").alias("docs"))

    mid = middle(both, "step")
    far = both.join(mid.withColumnsRenamed({"lang": "l", "measure": "m"}), F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")))
    far = far.groupBy("lang", "measure", F.abs(F.col("step") - F.col("middle")).alias("away"), "middle").agg(F.sum("n").alias("n"))
    reach = middle(far, "away").withColumnRenamed("middle", "away").join(mid.select(F.col("lang").alias("l"), F.col("measure").alias("m"), "middle"), F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")))
    columns = [F.max(F.when(F.col("measure") == "entropy_share", F.col("docs"))).alias("docs")]
    for m, (s, least, least_of_all, _) in MEASURES.items():
        of = lambda c, m=m: F.max(F.when(F.col("measure") == m, c))
        times, floor = F.when(F.col("lang").isNull(), REACH_OF_ALL).otherwise(REACH), F.when(F.col("lang").isNull(), least_of_all).otherwise(least)
        columns += [of((F.col("middle") + 0.5) * s).alias(f"{m}_mid"), of(F.greatest(times * 1.4826 * F.col("away") * s, floor)).alias(f"{m}_reach")]
    return reach.groupBy("lang").agg(*columns)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", path: str = VOCABULARIES) -> DataFrame:
    """Per row of docs: doc_id, lang (or "script X"), the base counts and measures, base_failed, reason (of the first band left; null if none) and kept.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text (null: none). base_failed: fewer than 10 words, or over 20 % of the words in repeated 5-word windows; the measures
    of such documents are null. kept: not base_failed, and every measure within its language's band: the median and REACH robust deviations, at least the reach
    in MEASURES, over all documents that pass the base rules; short texts get wider bands, fewer than FEWEST byte
    tokens are let pass, and entropy_share is held against texts of like length. Languages with
    fewer than LEAST_DOCS such documents use the wider bands of all. Equal rows count each and get equal verdicts; a value on the band's edge is kept; very long
    texts are measured whole; other columns are ignored; no rows give no rows. The vocabulary files at path are read by the driver and sent along.
    """
    modest_batches(docs.sparkSession)
    told = spill(measure(docs, doc_id, text, lang, path).withColumn("base_failed", fails_base(F.col("n_words"), F.col("n_repeat_words"))), "measures")
    told = told.withColumn("_entropy", at_length(told))
    limits = spill(bands(told), "bands")
    common = limits.where("lang IS NULL").first()
    columns = [f"{m}_{side}" for m in MEASURES for side in ("mid", "reach")]
    own = limits.where((F.col("docs") >= LEAST_DOCS) & F.col("lang").isNotNull()).select(F.col("lang").alias("_lang"), *columns)
    told = told.join(small(own), F.col("lang") == F.col("_lang"), "left").drop("_lang")
    wider = 1 + SHORT / F.sqrt(F.greatest("n_tokens", F.lit(1)))
    broken = []
    for m, (*_, up) in MEASURES.items():
        mid, reach = (F.coalesce(F.col(f"{m}_{x}"), F.lit(common[f"{m}_{x}"] if common else None).cast("double")) for x in ("mid", "reach"))
        value = F.col(JUDGED[m])
        outside = (value < mid - reach * wider) | (value > mid + up * reach * wider)
        broken.append(F.when(outside & (F.round(value * F.col("n_tokens")) >= FEWEST) if m == "byte_share" else outside, F.lit(m)))
    reason = F.coalesce(*broken)
    return told.withColumn("reason", reason).withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull()).drop("_entropy", *columns)
