"""Secret scans, in DataFrame functions alone: three patterns, and character Markov models for the strings that no pattern names.

Two models of character pairs, of random strings and of ordinary identifiers, are counted from labelled samples by plain aggregations; their log-likelihood
ratio is one constant array in the plan. Only texts that pass a cheap test are searched for positions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_clash, uniform

#: Kinds in their order: pattern, least characters of the whole match, least characters of group 2, a test that every text with a match passes, and the test's
#: kind. Fixed values of the rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = {
    "assign": (ASSIGN, 0, 6, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": (r"AKIA[A-Z0-9]+", 20, 0, "AKIA"),
    "hex": (r"[0-9a-f]{24,}", 24, 0, r"[0-9a-f]{24}"),
}
#: Characters of a candidate string, and how many it must have.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Alphabets of the random strings of the labelled samples, by kind.
RANDOM = {
    "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "base 32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "upper and digits": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower and digits": "abcdefghijklmnopqrstuvwxyz0123456789", "letters": ALPHABET[:52], "letters and digits": ALPHABET[:62], "base 64": ALPHABET[:64], "base 64 for addresses": ALPHABET[:62] + "-_",
}
#: Words of which identifiers of programs are made.
CODE_WORDS = """get set value field name list index count user account request response http status code error message time date file path base folder data type item key table column
row query result total number string byte buffer size length first last next previous start stop open close read write load save cache server client session page view model test
config option default local remote version update delete insert create build source target input output event handler service manager factory context state""".split()
#: Random strings of each kind, identifiers of CODE_WORDS, numbers; documents (about) whose words stand for ordinary ones, and the letters such a word has at least.
RANDOM_STRINGS, IDENTIFIERS, NUMBERS, SAMPLE_DOCS, WORD = 1000, 9000, 3000, 2000, 4
#: A candidate is a secret if its log-likelihood ratio is at least MIN_LLR in all and MIN_MEAN per pair of characters. One sample in HELD is kept from training.
MIN_LLR, MIN_MEAN, HELD = 8.0, 0.3, 5


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body with name standing for value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def matches(text: str, pattern: str) -> Column:
    """All matches in text (an SQL expression) as structs (start, end, match), in code points: the pieces between them and they themselves are laid end to end. The
    running sum goes by blocks of the root of their number, as appending to one array copies it each time."""
    p = _lit(pattern)
    pieces = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (piece, hit) -> named_struct('gap', char_length(piece), 'hit', hit))"
    one = """aggregate(slice(ps, i * width + 1, width), named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,end:int,hit:string>>)), (acc, x) -> if(x.hit IS NULL, acc, named_struct(
          'at', acc.at + x.gap + char_length(x.hit), 'out', array_append(acc.out, named_struct('start', acc.at + x.gap, 'end', acc.at + x.gap + char_length(x.hit), 'hit', x.hit)))))"""
    blocks = f"transform(sequence(0, cast(ceil(size(ps) / width) AS int) - 1), i -> {one})"
    starts = "aggregate(blocks, named_struct('at', 0, 'out', cast(array() AS array<int>)), (acc, x) -> named_struct('at', acc.at + x.at, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"
    laid = f"flatten(zip_with(blocks, {starts}, (x, at) -> transform(x.out, m -> named_struct('start', m.start + at, 'end', m.end + at, 'hit', m.hit))))"
    return F.expr(_let(pieces, "ps", _let("cast(ceil(sqrt(size(ps))) AS int)", "width", _let(blocks, "blocks", laid))))


def pair_counts(strings: DataFrame) -> DataFrame:
    """strings (label, s) -> label, a, b (places in ALPHABET), n. Equal strings are taken apart once, with their number."""
    codes = f"filter(transform(split(s, ''), c -> instr('{ALPHABET}', c) - 1), c -> c >= 0)"
    distinct = strings.where("length(s) >= 2").groupBy("label", "s").agg(F.count("*").alias("n"))
    pairs = distinct.selectExpr("label", "n", f"{codes} AS c").selectExpr("label", "n", "explode_outer(transform(sequence(1, greatest(size(c) - 1, 1)), i -> struct(get(c, i - 1) AS a, get(c, i) AS b))) AS p")
    return pairs.where("p.a IS NOT NULL AND p.b IS NOT NULL").groupBy("label", "p.a", "p.b").agg(F.sum("n").alias("n"))


def _styled(words: str, pick: str) -> str:
    """Words (an SQL array) joined in one of nine ways that identifiers have."""
    caps = f"array_join(transform({words}, x -> initcap(x)), '')"
    low = lambda sep: f"lower(array_join({words}, '{sep}'))"
    ways = [low("_"), low("-"), caps, f"concat(lower(get({words}, 0)), substr({caps}, length(get({words}, 0)) + 1))", f"upper({low('_')})", low("/"), low(""), f"concat({low('_')}, '_', cast(pmod({pick}, 9973) AS string))", f"concat({low('-')}, '-v', cast(pmod({pick}, 30) AS string))"]
    return f"element_at(array({', '.join(ways)}), cast(pmod({pick}, {len(ways)}) AS int) + 1)"


def labelled_sample(spark: SparkSession, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """label (random or ordinary), kind, s. Random: strings over the alphabets of RANDOM, 16 to 63 characters long, from digests of numbers. Ordinary: identifiers of
    CODE_WORDS and of the words of about SAMPLE_DOCS documents (a bound; chosen by a hash of the id), these words themselves, and numbers, dates and rules."""
    parts = []
    for kind, alphabet in RANDOM.items():
        made = spark.range(RANDOM_STRINGS).selectExpr(f"sha2(concat('{kind}:', cast(id AS string)), 512) AS h", f"16 + cast(pmod(xxhash64('{kind}', id), 48) AS int) AS n")
        parts.append(made.selectExpr("'random' AS label", f"'{kind}' AS kind", f"array_join(transform(sequence(0, n - 1), i -> substr('{alphabet}', 1 + cast(conv(substr(h, 2 * i + 1, 2), 16, 10) AS int) % {len(alphabet)}, 1)), '') AS s"))
    known = "array(" + ", ".join(f"'{w}'" for w in CODE_WORDS) + ")"
    code = spark.range(IDENTIFIERS).selectExpr("xxhash64('way', id) AS pick", f"transform(sequence(1, 2 + cast(id % 4 AS int)), j -> element_at({known}, 1 + cast(pmod(xxhash64(id, j), {len(CODE_WORDS)}) AS int))) AS w")
    parts.append(code.selectExpr("'ordinary' AS label", "'identifier' AS kind", f"{_styled('w', 'pick')} AS s"))
    digits = "translate(sha2(concat('n:', cast(id AS string)), 256), 'abcdef', '012345')"
    dates = "concat_ws('-', cast(1990 + id % 40 AS string), lpad(cast(1 + id % 12 AS string), 2, '0'), lpad(cast(1 + id % 28 AS string), 2, '0'))"
    rows = f"array(substr({digits}, 1, 16 + cast(id % 8 AS int)), concat({dates}, '/', {dates}), repeat(element_at(array('=', '-', '_', '/', '+'), cast(id % 5 AS int) + 1), 16 + cast(id % 60 AS int)), concat_ws('-', substr({digits}, 1, 4), substr({digits}, 5, 4), substr({digits}, 9, 4), substr({digits}, 13, 4)), concat('+', substr({digits}, 1, 2), '-', substr({digits}, 3, 3), '-', substr({digits}, 6, 4), '-', substr({digits}, 10, 4)))"
    parts.append(spark.range(NUMBERS).selectExpr("'ordinary' AS label", "'number' AS kind", f"element_at({rows}, cast(id % 5 AS int) + 1) AS s"))
    total = docs.count()
    picked = docs.where((uniform(doc_id, seed=6) < SAMPLE_DOCS / max(total, 1)) & F.col(text).isNotNull())
    words = picked.select(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z]{{{WORD},}}(?![A-Za-z0-9+/_=-])"), F.lit(0)).alias("all"))
    own = words.selectExpr("explode(all) AS s")
    joined = words.selectExpr("all", "explode(sequence(0, greatest(size(all) - 2, 0), 3)) AS i").selectExpr("slice(all, i + 1, 2 + i % 4) AS w", "xxhash64(all, i) AS pick").where("size(w) > 1")
    parts += [own.selectExpr("'ordinary' AS label", "'word' AS kind", "s"), joined.selectExpr("'ordinary' AS label", "'words of documents' AS kind", f"{_styled('w', 'pick')} AS s")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def held_out(s: str = "s") -> Column:
    """Whether a sample is kept from training, by its hash alone."""
    return F.pmod(F.xxhash64(F.lit("held"), s), F.lit(HELD)) == 0


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random to ordinary, given the first: one row of ALPHABET's length per first character, half a count added to
    each pair, between -4 and 4. A character that repeats speaks for no string: random ones have few such pairs, and runs of any character are filler."""
    k = len(ALPHABET)
    n = {label: [[0.5] * k for _ in range(k)] for label in ("random", "ordinary")}
    for r in pair_counts(samples).collect():  # at most two rows a pair
        n[r["label"]][r["a"]][r["b"]] += r["n"]
    ratio = lambda label, a, b: math.log(n[label][a][b] / sum(n[label][a]))
    return [max(-4.0, min(0.0 if a == b else 4.0, ratio("random", a, b) - ratio("ordinary", a, b))) for a in range(k) for b in range(k)]


def is_secret(s: str, model: list[float]) -> str:
    """An SQL condition on a string of ALPHABET (an SQL expression): its ratio is large enough."""
    k = len(ALPHABET)
    table = f"from_json('{json.dumps([round(x, 6) for x in model])}', 'array<double>')"
    score = f"""aggregate(sequence(1, greatest(char_length({s}) - 1, 1)), named_struct('s', 0D, 'c', transform(split({s}, ''), c -> instr('{ALPHABET}', c) - 1)),
        (acc, i) -> named_struct('s', acc.s + coalesce({table}[acc.c[i - 1] * {k} + get(acc.c, i)], 0D), 'c', acc.c), acc -> acc.s)"""
    return f"{score} >= greatest({MIN_LLR}D, {MIN_MEAN}D * (char_length({s}) - 1))"


def evaluate(samples: DataFrame, model: list[float]) -> DataFrame:
    """label, kind, length (16, 20 or 28: the least of its bucket), n, flagged: how the model judges the samples that were held out and are long enough."""
    held = samples.where(held_out()).where(F.char_length("s") >= LEAST)
    length = F.when(F.char_length("s") < 20, 16).when(F.char_length("s") < 28, 20).otherwise(28).alias("length")
    return held.groupBy("label", "kind", length).agg(F.count("*").alias("n"), F.count_if(F.expr(is_secret("s", model))).alias("flagged"))


def scan(docs: DataFrame, model: list[float], text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with spans: an array of (kind, start, end), in code points, end exclusive, ordered by start, then kind as in RULES with markov last.

    The rules' matches are the leftmost that don't overlap, by kind, without those that are too short. markov adds strings of LEAST characters of ALPHABET and
    more which overlap none of them and whose likelihood as a random string exceeds that as an identifier. A null text is an empty one; very long texts are
    scanned whole; equal rows get equal spans, and spans that begin together go by kind; a column of docs named spans gives way. Nothing but text is read. No rows
    give no rows.
    """
    helper = no_clash(docs, "_text")[0]
    out = [c for c in docs.columns if c.lower() != spans.lower()]
    none = "cast(array() AS array<struct<start:int,end:int,hit:string>>)"
    df = docs.select(*out, F.coalesce(F.col(text), F.lit("")).alias(helper))

    def rule(rank: int, kind: str, pattern: str, least: int, value: int, test: str) -> Column:
        found = F.when(F.col(helper).contains(test) if test.isalnum() else F.col(helper).rlike(test), matches(helper, pattern)).otherwise(F.expr(none))
        if least:
            found = F.filter(found, lambda m: F.char_length(m["hit"]) >= least)
        if value:
            found = F.filter(found, lambda m: F.char_length(F.regexp_extract(m["hit"], pattern, 2)) >= value)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    kinds = no_clash(docs, *(f"_{kind}" for kind in RULES))
    cand = no_clash(docs, "_candidates")[0]
    df = df.select("*", *(rule(rank, kind, *how).alias(c) for c, (rank, (kind, how)) in zip(kinds, enumerate(RULES.items()))), F.when(F.col(helper).rlike(CANDIDATE), matches(helper, CANDIDATE)).otherwise(F.expr(none)).alias(cand))
    # A candidate overlaps a kind's matches, which lie in order and apart, if the last one that begins before its end ends after its start: a binary search.
    halve = "if(acc.lo < acc.hi, if(b[(acc.lo + acc.hi) div 2].start < m.end, named_struct('lo', cast((acc.lo + acc.hi) div 2 + 1 AS int), 'hi', acc.hi), named_struct('lo', acc.lo, 'hi', cast((acc.lo + acc.hi) div 2 AS int))), acc)"
    last = f"aggregate(sequence(0, length(bin(size(b)))), named_struct('lo', 0, 'hi', size(b)), (acc, i) -> {halve}, acc -> acc.lo)"
    apart = " AND ".join(f"(size({part}) = 0 OR {_let(part, 'b', _let(last, 'at', 'at = 0 OR b[greatest(at - 1, 0)].end <= m.start'))})" for part in kinds)
    more = f"transform(filter({cand}, m -> {apart} AND {is_secret('m.hit', model)}), m -> named_struct('start', m.start, 'rank', {len(RULES)}, 'end', m.end, 'kind', 'markov'))"
    base = f"concat({', '.join(kinds)})"
    df = df.withColumn(spans, F.expr(f"transform(array_sort(concat({base}, {more})), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))"))
    return df.select(*out, spans)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with spans, by models trained on labelled samples (see labelled_sample; those held out aren't used) and scan's rules."""
    return scan(docs, train(labelled_sample(docs.sparkSession, docs, doc_id, text).where(~held_out())), text)
