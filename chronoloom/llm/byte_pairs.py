"""Byte-pair encoding by backtracking, and decoding by an offset table.

A word's tokens follow from its longest vocabulary matches, found by an Aho-Corasick automaton in one pass. From left to right the longest match is taken if it
is compatible with the token before: if in merging the two by themselves no merge would cross their border. If not, the next shorter match is tried, and where
none is left the token before is given up and its end marked as a dead end. A sequence of tokens is what the merges give exactly if all its neighbours are
compatible, and every prefix has one such sequence, so each place is visited a bounded number of times and the tokens are exact.

What a vocabulary says of normalisation and words is done with the standard library where the tokenizers library agrees on every character of a text, and by that
library's own normaliser and splitter where it doesn't (characters that newer versions of Unicode have added).
"""

from __future__ import annotations

import json
import struct
import unicodedata
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import modest_batches
from .textkit import release

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Pairs and words that a task remembers, the longest such word, and tokens that are decoded at once.
PAIRS, WORDS, LONG_WORD, TOKENS = 1 << 20, 1 << 19, 64, 1 << 16
_NEVER = 1 << 40


def letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others for 256 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Pieces:
    """A word's tokens. Symbols are chr(byte), and chr(256 + byte) for the last byte of a word."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        byte = {c: b for b, c in enumerate(letters())}
        self.size = [0] * len(vocab)
        self.automaton, self.id = ahocorasick.Automaton(), {}
        for name, i in vocab.items():
            last = suffix and name.endswith(suffix)
            raw = [byte[c] for c in (name[: -len(suffix)] if last else name)]
            s = "".join(map(chr, raw[:-1])) + chr(raw[-1] + (256 if last else 0))
            self.id[s], self.size[i] = i, len(s)
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.shorter = [-1] * len(vocab)  # the longest token that a token begins with
        for s, i in self.id.items():
            self.shorter[i] = next((self.id[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.id), -1)
        self.parts: list[tuple[int, int] | None] = [None] * len(vocab)
        self.merged: dict[tuple[int, int], int] = {}
        for m in merges:
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            i = vocab[a + b]
            self.parts[i], self.merged[vocab[a], vocab[b]] = (vocab[a], vocab[b]), i
            if max(vocab[a], vocab[b]) >= i:
                raise ValueError("tokens aren't numbered in the order of their merges")
        self.table: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b. Tokens are numbered in the order in which they are made, so a piece at the border lasts from its own
        number to that of what it becomes part of."""
        x, until_x = a, _NEVER
        while x >= 0:
            y, until_y = b, _NEVER
            while y >= 0:
                made = self.merged.get((x, y))
                if made is not None and made < until_x and made <= until_y:  # of equal merges the left one comes first
                    return False
                y, until_y = (self.parts[y][0], y) if self.parts[y] else (-1, y)
            x, until_x = (self.parts[x][1], x) if self.parts[x] else (-1, x)
        return True

    def encode(self, word: bytes, last: int = 256) -> list[int]:
        """Tokens of a word (not empty)."""
        s = word[:-1].decode("latin-1") + chr(word[-1] + last)
        n, size_of, shorter, table = len(s), self.size, self.shorter, self.table
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(s):
            longest[end - size + 1] = i  # longer matches end later
        out, dead, at, before, token = [], bytearray(n + 1), 0, -1, longest[0]
        while True:
            while token >= 0:
                if not dead[at + size_of[token]]:
                    fits = before < 0 or table.get((before, token))
                    if fits is None:
                        if len(table) >= PAIRS:
                            table.clear()
                        fits = table[before, token] = self.compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size_of[token]
                if at == n:
                    return out
                before, token = token, longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size_of[token]
                before, token = out[-1] if out else -1, shorter[token]


class Coder:
    """Texts to tokens and back, from the bytes of a vocabulary file; those bytes are what travels."""

    def __init__(self, file: bytes):
        self.file, spec = file, json.loads(file)
        model, splits = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and not spec.get("decoder") and not spec.get("post_processor")
        plain &= [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in splits] == ["Split", "ByteLevel"]
        plain &= splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
        if model["type"] != "BPE" or not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("not a byte-level vocabulary of words in lower case, or with further rules")
        pattern = splits[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.pieces = Pieces(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.last = 256 if model["end_of_word_suffix"] else 0
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.agreed: dict[str, bool] = {c: True for c in map(chr, range(128))}
        self.lower, self.normal = normalizers.Lowercase(), normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.classes = [(pre_tokenizers.Split(Regex(p), "removed", invert=True), regex.compile(p)) for p in (r"\p{L}", r"\p{N}", r"\s")]
        names = {i: name for name, i in (model["vocab"] | self.added).items()}
        spaced = [names.get(i, "").encode() + b" " for i in range(max(names, default=-1) + 1)]
        self.offsets = np.append(0, np.cumsum([len(x) for x in spaced])).astype(np.int64)
        self.names = np.frombuffer(b"".join(spaced), np.uint8)
        self.named = np.array([i in names for i in range(len(spaced))], bool)

    def __reduce__(self):
        return Coder, (self.file,)

    def _agrees(self, c: str) -> bool:
        """Whether the tokenizers library sees a character as the standard library and regex do; asked once."""
        low = c.lower()
        ok = self.lower.normalize_str(c) == low and all(bool(theirs.pre_tokenize_str(x)) == bool(ours.match(x)) for x in (c, *low) for theirs, ours in self.classes)
        self.agreed[c] = ok
        return ok

    def split_words(self, text: str) -> list[str]:
        """The words of a text without added tokens, normalised."""
        s = text if text.isascii() else unicodedata.normalize("NFC", text)
        if not s.isascii() and not all(self.agreed[c] if c in self.agreed else self._agrees(c) for c in set(s)):
            return [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]
        return self.words.findall(s.replace("Σ", "σ").lower())  # a sigma at a word's end is one like others

    def _word(self, word: str) -> bytes:
        tokens = self.pieces.encode(word.encode(), self.last)
        out = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(word) <= LONG_WORD:
            if len(self.known) >= WORDS:
                self.known.clear()
            self.known[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Tokens of a text as little-endian unsigned 32-bit numbers."""
        out, known = [], self.known
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                out += [known[w] if w in known else self._word(w) for w in self.split_words(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' names with blanks between them, in UTF-8. Numbers that are no token's are passed over."""
        tokens, out = np.frombuffer(ids, "<u4"), []
        tokens = tokens[tokens < len(self.named)].astype(np.int64)
        tokens = tokens[self.named[tokens]]
        for lo in range(0, len(tokens), TOKENS):
            start = self.offsets[tokens[lo : lo + TOKENS]]
            size = self.offsets[tokens[lo : lo + TOKENS] + 1] - start
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            out.append(self.names[at].tobytes())
        return b"".join(out)[:-1]


def _added(df: DataFrame, keep: list[str] | None, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != name.lower()]
    return kept, T.StructType([*(df.schema[c] for c in kept), T.StructField(name, kind)])


def _mapped(df: DataFrame, column: str, keep: list[str] | None, name: str, kind: T.DataType, arrow: pa.DataType, each) -> DataFrame:
    kept, schema = _added(df, keep, name, kind)
    modest_batches(df.sparkSession)

    def run(batches):
        for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([each(x) for x in b.column(len(kept)).to_pylist()], arrow)], schema.names)
        release()

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").alias("_read" if "_read" not in kept else "_read_2")).mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of keep) and ids: the tokens of the whole text, little-endian unsigned 32-bit numbers in one binary value.

    vocabulary is a file that the driver reads, its bytes travel with the tasks. The tokens are those of the tokenizers library with that file, without special
    tokens of its own; a special token's string in a text is that token. Null and empty texts have no token (an empty value). A column of the name ids gives way.
    Rows are worked on one by one, so repeated rows and ties are nothing special; no rows give no rows. Words and pairs that a task has met are remembered up to a
    bound, which changes no result.
    """
    coder = Coder(Path(vocabulary).read_bytes())
    return _mapped(docs, text, keep, ids, T.BinaryType(), pa.binary(), lambda t: coder.encode(t or ""))


def decode(coded: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """coded's columns (or those of keep) and text: the tokens of ids as the tokenizers library writes them for a file without a decoder, their names with blanks between them. Null
    ids give the empty text; numbers without a token are passed over."""
    coder = Coder(Path(vocabulary).read_bytes())
    return _mapped(coded, ids, keep, text, T.StringType(), pa.string(), lambda x: coder.decode(x or b"").decode())
