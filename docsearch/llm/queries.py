"""The registered queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch.llm import audio, chat, mixing, neardup, pieces, pii, planes, quality, runs, scans, spelling, topk, webtext
from docsearch.llm.common import table

#: The key of the registered query; a real run has a secret one of its own.
PII_KEY = "key of the registered query"
MIX = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(table(spark, sf_dir, "pages"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.report(table(spark, sf_dir, "documents"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.threads(table(spark, sf_dir, "conversations"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX)
    shares = [F.round(F.element_at("posteriors", k + 1), 6).alias(f"p_{d}") for k, d in enumerate(MIX)]
    return out.select("doc_id", "n_tokens", *shares, F.round("rate", 6).alias("rate"), "copies")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(table(spark, sf_dir, "documents"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), neardup.Setting(words=3, percent=85))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), F.array_join("pii_kinds", ",").alias("kinds"), F.array_join("pii_values", "\n").alias("pseudonyms"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_html_extraction, op2_secret_scans, op3_quotation_linking, op4_exact_topk, op5_mixing, op6_sentencepiece,
        op7_audio_features, op8_minhash_neardup, op9_pii, op10_quality, op11_token_planes, op12_spelling_variants, op13_periodic_runs, pipeline,
    )
    return {f.__name__: f for f in ops}


#: Finds the leftmost matches by cutting the text, as the Spark form does; places are code points.
_OP2 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
rules AS (
  SELECT * FROM (VALUES
    (0, 'assign', '(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 2, 12),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
    (2, 'hex', '[0-9a-f]{16,}', 0, 16)) v(k, kind, pattern, grp, least)),
hits AS (
  SELECT r, k, kind, least,
    CASE k WHEN 0 THEN regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 0)
           WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(text, '[0-9a-f]{16,}', 0) END AS m,
    CASE k WHEN 0 THEN regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 2)
           WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(text, '[0-9a-f]{16,}', 0) END AS g,
    CASE k WHEN 0 THEN string_split_regex(text, '(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))')
           WHEN 1 THEN string_split_regex(text, 'AKIA[A-Z0-9]+') ELSE string_split_regex(text, '[0-9a-f]{16,}') END AS gaps
  FROM t, rules),
each_hit AS (SELECT r, k, kind, least, m, g, gaps, unnest(generate_series(1, len(m))) AS i FROM hits WHERE len(m) > 0),
placed AS (
  SELECT r, k, kind, least, length(g[i]) AS size,
    coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s,
    length(m[i]) AS n
  FROM each_hit),
good AS (SELECT r, k, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM placed WHERE size >= least),
agg AS (
  SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM good GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM t LEFT JOIN agg USING (r)
"""

_OP4 = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.r <> x.r),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Brute force: all pairs of documents that share a shingle; components by repeated minima.
_OP8 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END) AS g FROM t),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM h x JOIN h y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 85 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _remainder(k: int, steps: int = 4) -> int:
    """What crc32's polynomial leaves of the low four bits."""
    return k if not steps else _remainder(k >> 1 ^ (0xEDB88320 if k & 1 else 0), steps - 1)


#: crc32 of a list of bytes, four bits at a time.
_CRC = f"nibble AS (SELECT {[_remainder(k) for k in range(16)]}::BIGINT[] AS t)"
_CRC_OF = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {0}), lambda s, b: xor(
  xor(xor(s, b) >> 4, t[(xor(s, b) & 15) + 1]) >> 4, t[(xor(xor(s, b) >> 4, t[(xor(s, b) & 15) + 1]) & 15) + 1])), 4294967295)"""
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), 128 + (ord(c) & 63)] END))"

#: Near words are equal but for one place, or one is what the other leaves without a letter.
_OP12 = (
    "WITH RECURSIVE "
    + _CRC
    + r""",
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{5,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT w, n, """
    + _CRC_OF.format(_BYTES.format("doc_id || ':' || w"))
    + r""" AS h FROM d, nibble),
x AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM x WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, k FROM less WHERE k IN (SELECT word FROM v) UNION SELECT k, word FROM less WHERE k IN (SELECT word FROM v)),
near AS (SELECT a, b, v.n AS m FROM p JOIN v ON v.word = b),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY m DESC, b) AS b, max(m) AS m FROM near GROUP BY a),
f AS (SELECT word, n, CASE WHEN m >= 2 * n THEN b END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n, coalesce(n_near, 0) AS n_near FROM v LEFT JOIN best ON a = word),
walk AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN f ON f.word = w.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""
)

#: Stretches of equal words at each distance; of equal stretches the smallest distance is the period.
_OP13 = (
    "WITH "
    + _CRC
    + r""",
t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, """
    + _CRC_OF.format(_BYTES.format("CAST(doc_id AS VARCHAR)"))
    + r""" AS h FROM t, nibble),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM c),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(generate_series(0, n - 1), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM q),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(generate_series(0, n - 1)) AS i FROM d WHERE n > 0),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS d FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, d, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS s, i FROM e),
z AS (SELECT doc_id, d, min(i) AS start, count(*) + d AS length FROM s GROUP BY doc_id, d, s),
r AS (SELECT doc_id, start, length, CAST(min(d) AS BIGINT) AS period FROM z WHERE length >= greatest(6, 4 * d) GROUP BY doc_id, start, length),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r),
m AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(generate_series(start + period, start + length - 1)) AS i FROM r)),
j AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, o.start AS start, o.length AS length, o.period AS period, 1000 * o.length // o.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN o ON o.doc_id = d.doc_id AND o.k = 1 LEFT JOIN j ON j.doc_id = d.doc_id
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scans": _OP2, "op4_exact_topk": _OP4, "op8_minhash_neardup": _OP8, "op12_spelling_variants": _OP12, "op13_periodic_runs": _OP13}
