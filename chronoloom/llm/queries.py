"""The thin queries over the test tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, collision_search, fertility, importance, jaccard_join, language_id, line_dedup, mixing, packing, secrets, sharding, spelling, warc
from .common import scratch_path, table


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fertility.judge(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason", "chars_per_token", "byte_share", "entropy_share")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), mixing.word_count("text"), F.xxhash64("text"))


def op4_warc_zstandard(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    of = {kind: F.expr(f"filter(spans, s -> s.kind = '{kind}')") for kind in secrets.RULES}
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", *(F.size(x).cast("long").alias(f"n_{kind}") for kind, x in of.items()), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans")
    )


def op7_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("words"))
    rows = words.withColumn("weight", mixing.length_weight("words"))
    return mixing.mix(rows, F.col("words"), weight="weight").drop("source", "words", "weight")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "n_features", "weight", "score", "rank")


def op12_byte_pair_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_pairs.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    told = coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return byte_pairs.decode(told, keep=["doc_id", "n_tokens", "ids_sha256"]).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_sampled_splitters, op2_tokeniser_fertility, op3_best_fit_packing, op4_warc_zstandard, op5_collision_counting, op6_markov_secrets, op7_output_codes, op8_pareto_mixing, op9_line_dedup, op10_ngram_jaccard_join, op11_importance_resampling, op12_byte_pair_codes, op13_spelling_variants)}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _crc32(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a string's UTF-8 bytes, bit by bit: each byte is followed by eight shifts."""
    octet = f"CAST('0x' || substr(hex({text}), CAST(2 * i + 1 AS INT), 2) AS BIGINT)"
    steps = f"flatten(list_transform(range(strlen({text})), lambda i: list_prepend({octet}, [-1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


ORACLES: dict[str, str] = {
    "op4_warc_zstandard": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload, sha1(payload) AS h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
        max(page_id) OVER (PARTITION BY payload) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b""",
    "op8_pareto_mixing": r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('8:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM per),
roomy AS (SELECT *, 2.0 * source_size / weight AS room FROM weighed),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * (sum(source_size) OVER (ORDER BY room, source NULLS LAST ROWS UNBOUNDED PRECEDING) - source_size))
            / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM roomy),
lev AS (SELECT level FROM levels WHERE level <= room ORDER BY room, level DESC LIMIT 1),
t AS (SELECT source, source_size, CAST(least(coalesce((SELECT level FROM lev) * weight, 2.0 * source_size), 2.0 * source_size) AS DOUBLE) AS target FROM roomy),
sized AS (SELECT base.doc_id, base.size, base.u, t.*, CAST(round(16 * log2(CAST(length(bin(base.size)) AS DOUBLE))) AS INT) AS k FROM base JOIN t ON base.source IS NOT DISTINCT FROM t.source),
cls AS (SELECT source, source_size, target, k, pow(2.0, k / 16.0) AS w, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL),
odds AS (
  SELECT *, (target - 2.0 * (sum(words) OVER (PARTITION BY source ORDER BY k DESC ROWS UNBOUNDED PRECEDING) - words))
            / nullif(sum(words * w) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c
  FROM cls),
lead AS (SELECT *, arg_max(c, k) FILTER (WHERE c * w <= 2.0 * (1 + 1e-12)) OVER (PARTITION BY source) AS c0 FROM odds),
copied AS (SELECT *, CAST(floor(coalesce(CASE WHEN target >= 2.0 * source_size THEN 2.0 ELSE greatest(least(c0 * w, 2.0), 0.0) END, 0.0) * 1073741824.0 + 0.5) AS BIGINT) AS e FROM lead),
parts AS (SELECT source, k, e >> 30 AS whole, e & 1073741823 AS part, sum(CAST(e & 1073741823 AS HUGEINT) * words) OVER (PARTITION BY source) / 1073741824.0 AS rest FROM copied),
pq AS (SELECT sized.*, whole, part, rest, part / 1073741824.0 AS p FROM sized JOIN parts ON sized.source IS NOT DISTINCT FROM parts.source AND sized.k = parts.k),
ranked AS (
  SELECT *, sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY part = 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p), doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM pq),
c AS (SELECT *, CAST(whole + CASE WHEN part > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END AS INT) AS copies FROM ranked)
SELECT doc_id, size, source_size, target, copies, CAST(size * copies AS BIGINT) AS taken FROM c""",
    "op9_line_dedup": f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i FROM parts),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM (SELECT DISTINCT doc_id, k FROM keyed WHERE length(k) >= 20) GROUP BY k HAVING count(*) >= 3),
told AS (SELECT keyed.*, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[CAST(i AS INT):CAST(i + 4 AS INT)], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON b.g = a.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
sides AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, sides.y FROM r JOIN sides ON sides.x = r.reached),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN m ON m.node = n.doc_id""",
    "op11_importance_resampling": rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
bucket AS (SELECT w, {_crc32("w")} % 10000 AS b FROM (SELECT w FROM words UNION SELECT w FROM aims)),
held AS (SELECT doc_id, b, count(*) AS n FROM words JOIN bucket USING (w) GROUP BY ALL),
s AS (SELECT b, sum(n) AS s FROM held GROUP BY b), t AS (SELECT b, count(*) AS t FROM aims JOIN bucket USING (w) GROUP BY b),
all_s AS (SELECT coalesce(sum(s), 0) AS ss FROM s), all_t AS (SELECT coalesce(sum(t), 0) AS tt FROM t),
gains AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(ss AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(tt AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), all_s, all_t),
per AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS w FROM held JOIN gains USING (b) GROUP BY doc_id),
weighed AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (w - ((w % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
  (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM documents LEFT JOIN per USING (doc_id)),
scored AS (SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
low AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM runs) WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, n, {_crc32("(doc_id || ':' || w)")} AS h FROM low),
varied AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) + 2 AS INT)) ELSE w END AS word, n FROM hashed),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM varied WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i + 2 AS INT)) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN vocab b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN vocab b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
first AS (SELECT near.word, min(near) AS near FROM near JOIN best ON near.word = best.word AND near.m = best.m GROUP BY near.word),
told AS (SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * vocab.n THEN near END AS form, CASE WHEN m >= 5 * vocab.n THEN m END AS form_n
  FROM vocab LEFT JOIN best ON best.word = vocab.word LEFT JOIN first ON first.word = vocab.word),
path AS (SELECT word, word AS at FROM told UNION ALL SELECT path.word, told.form FROM path JOIN told ON told.word = path.at WHERE told.form IS NOT NULL)
SELECT told.word, told.form, path.at AS root, told.n, told.n_near, told.form_n FROM told JOIN path ON path.word = told.word JOIN told AS final ON final.word = path.at AND final.form IS NULL""",
}
