
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch.functions import paths, patterns, text
from docsearch.operators import duplicates, filters, fuzzy, history, many_terms, near, positions, results, telemetry, tokens
from docsearch.plans.query import Near, Not, Regex, Settings, Term, all_of, any_of, compile_query, query_terms, search
from docsearch.plans.query import regex as regex_test
from docsearch.plans.query import term as term_test
from docsearch.sources import document, export, folders, ranges
from docsearch.sources.corpus import MAX_BYTES, corpus, fetch_content, limit_content, read_table, scan, union_scans, with_read_status
from docsearch.sources.history_store import HistoryStore
from docsearch.sources.scratch import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CORPUS = """corpus AS (SELECT doc_id, '/corpus/' || source || '/' || lang || '/doc_' || doc_id || '.' || (['txt','md','log','json'])[doc_id % 4 + 1] AS file_path,
  strlen(text) AS size, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS mtime, text AS content, lang, source FROM documents)"""
WORDS = "list_filter(regexp_extract_all({0}, '[A-Za-z0-9_À-ÿ]+'), lambda w: length(w) > 1)"
STRICT = Settings(fuzzy_terms=False, fuzzy_near=False)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def query(name: str, sql: str | None = None, with_corpus: bool = True) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            global c, p
            c, p = F.col("content"), F.col("file_path")  # columns need a running session, so they can't be made on import
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = (f"WITH {CORPUS} " if with_corpus else "") + sql
        return run

    return keep


def on_corpus(name: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a query over the corpus view."""

    def keep(f: Callable[[DataFrame], DataFrame]) -> Query:
        return query(name, sql)(lambda spark, sf_dir: f(corpus(spark, sf_dir)))

    return keep


#: The columns content and file_path; set when a query runs.
c: Column
p: Column


def filtered(name: str, test: Callable[[], Column], sql: str) -> None:
    """Registers a filter over the corpus: the ids that pass."""
    on_corpus(name, f"SELECT doc_id FROM corpus WHERE {sql}")(lambda d: d.filter(test()).select("doc_id"))


def computed(name: str, value: Callable[[], Column], sql: str, kind: str | None = None) -> None:
    """Registers a computed column over the corpus: doc_id and value."""
    column = (lambda: value().cast(kind)) if kind else value
    on_corpus(name, f"SELECT doc_id, {sql} AS value FROM corpus")(lambda d: d.select("doc_id", column().alias("value")))


# --- filters on metadata -------------------------------------------------------------------------------------------------------
filtered("f1_ext_in", lambda: filters.ext_in(p, ["txt", ".md"]), r"regexp_extract(file_path, '\.([^./]+)$', 1) IN ('txt', 'md')")
filtered("f2_exclude_file_globs", lambda: ~filters.file_excluded(p, ["doc_1?.*", "*.log"]), r"NOT regexp_matches(regexp_extract(file_path, '[^/]*$'), '^doc_1[^/]\.[^/]*$|^[^/]*\.log$')")
filtered("f3_exclude_file_regex", lambda: ~filters.file_excluded(p, [r"/doc_\d+5\./", "/JSON$/i"]), r"NOT regexp_matches(regexp_extract(file_path, '[^/]*$'), 'doc_\d+5\.|(?i:json$)')")
_FOLDER = "len(list_filter(string_split(lower(regexp_extract(file_path, '^(.*)/[^/]*$', 1)), '/'), lambda s: {0})) = 0"
for _id, _mode, _pattern, _test in (
    ("f4_folder_contains", "contains", "RC1", "contains(s, 'rc1')"),
    ("f5_folder_exact", "exact", "src1*", "regexp_matches(s, '^src1[^/]*$')"),
    ("f6_folder_starts_with", "startsWith", "Src2", "starts_with(s, 'src2')"),
    ("f7_folder_ends_with", "endsWith", "c3", "ends_with(s, 'c3')"),
):
    filtered(_id, lambda m=_mode, x=_pattern: ~filters.folder_excluded(paths.directory(p), [x], m), _FOLDER.format(_test))
filtered("f8_max_depth", lambda: filters.within_depth(p, "/corpus/src0", 2), "len(string_split(CASE WHEN starts_with(file_path, '/corpus/src0/') THEN substr(file_path, 14) ELSE file_path END, '/')) <= 2")
filtered("f9_modified_between", lambda: filters.modified_between(F.col("mtime"), "2024-01-05", "2024-01-20"), "mtime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
filtered("f10_size_between", lambda: filters.size_between(F.col("size"), 500, 2048), "size BETWEEN 500 AND 2048")
filtered(
    "f11_missing_stats_pass",
    lambda: filters.size_between(F.when(F.col("doc_id") % 7 != 0, F.col("size")), 500, 2048),
    "doc_id % 7 = 0 OR size BETWEEN 500 AND 2048",
)


@on_corpus("f12_matched_only", "SELECT doc_id, file_path FROM corpus WHERE contains(lower(content), 'ortion')")
def _f12(d: DataFrame) -> DataFrame:
    return filters.matched_only(search(d, Term("ortion"), STRICT), True).select("doc_id", "file_path")


@on_corpus(
    "f13_relevant_errors",
    """SELECT file_path, code FROM (SELECT '/corpus' AS root, file_path, CASE WHEN doc_id % 3 = 0 THEN 'EPERM' ELSE 'ENOENT' END AS code FROM corpus)
    WHERE NOT (code = 'EPERM' AND file_path <> root AND len(list_filter(string_split(lower(file_path), '/'), lambda s: contains(s, 'src0'))) > 0)""",
)
def _f13(d: DataFrame) -> DataFrame:
    errors = d.select(F.lit("/corpus").alias("search_path"), p.alias("error_path"), F.lit("cannot read").alias("message"), F.when(F.col("doc_id") % 3 == 0, "EPERM").otherwise("ENOENT").alias("code"))
    return filters.relevant_errors(errors, ["src0"]).select(F.col("error_path").alias("file_path"), "code")


@on_corpus("f14_max_content_length", "SELECT doc_id, length(content) <= 5000 AND contains(lower(content), 'the') AS matched, CASE WHEN length(content) > 5000 THEN 'contentTooLong:' || length(content) END AS error FROM corpus")
def _f14(d: DataFrame) -> DataFrame:
    matched, error = limit_content(term_test(c, "the"), c, 5000)
    return d.select("doc_id", matched.alias("matched"), error.alias("error"))


#: DuckDB's levenshtein counts bytes: lower-case letters beyond ASCII stand as one byte each.
_BYTE_EACH = f"translate({{0}}, '{''.join(map(chr, range(0xDF, 0x100)))}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+')"
_CLOSE = "length({0}) >= {lo} AND length({0}) <= {hi} AND (substr({0}, 1, 1) = '{a}' OR right({0}, 1) = '{z}') AND levenshtein(" + _BYTE_EACH + ", '{t}') <= {k}"


def _close_sql(word: str, t: str) -> str:
    import math

    n = len(t)
    return _CLOSE.format(word, lo=math.floor(0.7 * n + 1e-9), hi=math.ceil(1.3 * n - 1e-9), a=t[0], z=t[-1], t=t, k=math.floor(0.3 * n + 1e-9))


def _fuzzy_sql(t: str, column: str = "content") -> str:
    return f"len(list_filter({WORDS.format(f'lower({column})')}, lambda w: {_close_sql('w', t)})) > 0"


@on_corpus("f15_fuzzy_filter", f"""SELECT file_path, read_error, term FROM (SELECT file_path, CASE WHEN size > 3000 THEN 'fileTooLarge:' || size END AS read_error FROM corpus), (VALUES ('filetoolrage'), ('src1x')) t(term)
  WHERE contains(lower(file_path), term) OR contains(lower(coalesce(read_error, '')), term) OR (term = 'src1x' AND {_fuzzy_sql('src1x', 'file_path')}) OR (term = 'filetoolrage' AND coalesce({_fuzzy_sql('filetoolrage', 'read_error')}, false))""")  # fmt: skip
def _f15(d: DataFrame) -> DataFrame:
    """A term close to words of paths, and one close to words of read errors."""
    rows = with_read_status(d, 3000).select("file_path", "read_error")
    return union_all([fuzzy.fuzzy_filter(rows, t).withColumn("term", F.lit(t)) for t in ("filetoolrage", "src1x")])


filtered("f16_size_units", lambda: filters.size_between(F.col("size"), text.size_to_bytes(1, "KB"), text.size_to_bytes(0.0025, "MB")), "size BETWEEN 1024 AND 2621")
computed("f17_split_and_clean", lambda: F.array_join(text.split_and_clean(c), "|"), r"array_to_string(list_filter(list_transform(string_split_regex(content, '[\n,]+'), lambda x: trim(x)), lambda x: x <> ''), '|')")

_CLOSE_TERMS = ("ortoin", "threoa", "estoin", "andred", "ingtion", "thwhhe")
on_corpus("c14_fuzzy_by_vocabulary", " UNION ALL ".join(f"SELECT '{t}' AS term, doc_id FROM corpus WHERE {_fuzzy_sql(t)}" for t in _CLOSE_TERMS))(lambda d: fuzzy.documents_with(stored(fuzzy.postings(d)), list(_CLOSE_TERMS)))

# --- content predicates --------------------------------------------------------------------------------------------------------
filtered("c1_term", lambda: term_test(c, "Estion"), "contains(lower(content), 'estion')")
filtered("c2_term_case_sensitive", lambda: term_test(c, "Estion", case_sensitive=True), "contains(content, 'Estion')")
filtered("c3_quoted_term", lambda: compile_query(Term('"and the"'), settings=STRICT), "contains(lower(content), 'and the')")
filtered("c4_whole_word", lambda: term_test(c, "re", whole_word=True), "regexp_matches(lower(content), '(^|[^A-Za-z0-9_])re($|[^A-Za-z0-9_])')")
filtered("c5_regex", lambda: regex_test(c, "th[aeiou]n+d"), "regexp_matches(content, '(?i)th[aeiou]n+d')")
filtered("c6_regex_literal", lambda: compile_query(Term("/^the .*on/gim")), "regexp_matches(content, '(?im)^the .*on')")
filtered("c7_regex_from_pattern", lambda: c.rlike(patterns.regex_from_pattern("a.b|on", whole_word=True)), "regexp_matches(content, '(?i)(^|[^A-Za-z0-9_])(a.b|on)($|[^A-Za-z0-9_])')")
filtered("c8_and", lambda: compile_query(all_of(Term("the"), Term("and")), settings=STRICT), "contains(lower(content), 'the') AND contains(lower(content), 'and')")
filtered("c9_or", lambda: compile_query(any_of(Term("estion"), Term("ortion")), settings=STRICT), "contains(lower(content), 'estion') OR contains(lower(content), 'ortion')")
filtered("c10_not", lambda: compile_query(Not(Term("the")), settings=STRICT), "NOT coalesce(contains(lower(content), 'the'), false)")
filtered(
    "c11_nested_groups",
    lambda: compile_query(any_of(all_of(Term("the"), Not(any_of(Term("estion"), Regex("ing[.,]", "i")))), Term("ortion")), settings=STRICT),
    "(contains(lower(content), 'the') AND NOT (contains(lower(content), 'estion') OR regexp_matches(content, '(?i)ing[.,]'))) OR contains(lower(content), 'ortion')",
)
filtered(
    "c12_compile_tree",
    lambda: compile_query({"operator": "AND", "conditions": [{"type": "term", "value": "The", "caseSensitive": True}, {"type": "term", "value": " "}, {"operator": "OR", "conditions": [{"type": "regex", "value": "ou+r", "flags": ""}]}]}, settings=STRICT),
    "contains(content, 'The') AND regexp_matches(content, 'ou+r')",
)
filtered("c13_fuzzy_fallback", lambda: compile_query(Term("threoa")), f"contains(lower(content), 'threoa') OR {_fuzzy_sql('threoa')}")
filtered("c14_fuzzy", lambda: fuzzy.fuzzy_term(c, "ortoin"), _fuzzy_sql("ortoin"))
filtered("c15_fuzzy_short", lambda: fuzzy.fuzzy_term(c, "ßb"), "contains(lower(content), 'ßb')")
filtered(
    "c16_fuzzy_whole_word",
    lambda: compile_query(Term("threoa"), settings=Settings(whole_word=True)),
    f"regexp_matches(lower(content), '(^|[^A-Za-z0-9_])threoa($|[^A-Za-z0-9_])') OR {_fuzzy_sql('threoa')}",
)
computed("c17_fuzzy_score", lambda: fuzzy.fuzzy_score(c, "estoin"), f"CASE WHEN contains(lower(content), 'estoin') THEN 0.0::DOUBLE WHEN {_fuzzy_sql('estoin')} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END")


def _near_sql(test_a: str, test_b: str, d: int) -> str:
    return f"""SELECT DISTINCT a.doc_id FROM
      (SELECT doc_id, i, w FROM (SELECT doc_id, unnest({WORDS.format('lower(content)')}) AS w, generate_subscripts({WORDS.format('lower(content)')}, 1) AS i FROM corpus WHERE length(content) >= 10) WHERE {test_a}) a
      JOIN (SELECT doc_id, i, w FROM (SELECT doc_id, unnest({WORDS.format('lower(content)')}) AS w, generate_subscripts({WORDS.format('lower(content)')}, 1) AS i FROM corpus) WHERE {test_b}) b
      ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= {d}"""


ESTION_THE = ("contains(w, 'estion')", "contains(w, 'the')")
FOR_AND = ("contains(w, 'for')", "contains(w, 'and')")


def near_query(name: str, test: Callable[[], Column], sql: str | None) -> None:
    on_corpus(name, sql)(lambda d: d.filter(test()).select("doc_id"))


near_query("c18_near", lambda: near.near(c, "estion", "the", 3, fuzzy=False), _near_sql("contains(w, 'estion')", "contains(w, 'the')", 3))
near_query("c19_near_text_distance", lambda: near.near(c, "estion", "the", "2", fuzzy=False), _near_sql("contains(w, 'estion')", "contains(w, 'the')", 2))
near_query("c21_near_whole_word", lambda: near.near(c, "for", "and", 2, whole_word=True, fuzzy=False), _near_sql("w = 'for'", "w = 'and'", 2))
near_query(
    "c22_near_fuzzy",
    lambda: near.near(c, "threoa", "the", 4),
    f"""SELECT doc_id FROM (SELECT doc_id, CASE WHEN len(ea) > 0 THEN ea ELSE fa END AS a, CASE WHEN len(eb) > 0 THEN eb ELSE fb END AS b FROM (
      SELECT doc_id, list_filter(generate_series(1, len(ws)), lambda i: contains(ws[i], 'threoa')) AS ea, list_filter(generate_series(1, len(ws)), lambda i: contains(ws[i], 'the')) AS eb,
        list_filter(generate_series(1, len(ws)), lambda i: {_close_sql('ws[i]', 'threoa')}) AS fa, list_filter(generate_series(1, len(ws)), lambda i: {_close_sql('ws[i]', 'the')}) AS fb
      FROM (SELECT doc_id, {WORDS.format('lower(content)')} AS ws FROM corpus WHERE length(content) >= 10)))
      WHERE len(list_filter(a, lambda i: len(list_filter(b, lambda j: abs(i - j) <= 4)) > 0)) > 0""",
)
near_query(
    "c10_not_near",
    lambda: compile_query(all_of(Term("estion"), Not(Near("estion", "the", 3))), settings=STRICT),
    f"SELECT doc_id FROM corpus WHERE contains(lower(content), 'estion') AND doc_id NOT IN ({_near_sql(*ESTION_THE, 3)})",
)


@on_corpus("c24_query_terms", "SELECT 'estion' AS term, count(*) FILTER (contains(lower(content), 'estion')) AS documents FROM corpus UNION ALL SELECT 'the', count(*) FILTER (contains(lower(content), 'the')) FROM corpus")
def _c24(d: DataFrame) -> DataFrame:
    terms = query_terms(all_of(Term("Term: estion"), any_of(Near("the", "estion", 3), Term('"AND"'))))
    counts = d.agg(*(F.count_if(term_test(c, t)).alias(t) for t in terms))
    return counts.unpivot([], terms, "term", "documents")


filtered("c25_matcher", lambda: F.coalesce((F.length(c) % 2 == 0) & c.startswith("T"), F.lit(False)), "length(content) % 2 = 0 AND starts_with(content, 'T')")

# --- places --------------------------------------------------------------------------------------------------------------------
_CHARS = "(SELECT doc_id, content, string_split(lower(content), '') AS ch FROM corpus)"


def _places(t: str, more: str = "") -> str:
    """Places (from 0) of a term in the characters ch of a text."""
    same = " AND ".join(f"ch[i + {k}] = '{x}'" for k, x in enumerate(t))
    return f"list_transform(list_filter(generate_series(1, len(ch) - {len(t) - 1}), lambda i: {same}{more}), lambda i: i - 1)"


_WHOLE = " AND (i = 1 OR NOT regexp_matches(ch[i - 1], '[a-z0-9_]')) AND NOT regexp_matches(coalesce(ch[i + 2], ''), '[a-z0-9_]')"
on_corpus("d1_positions", f"SELECT doc_id, array_to_string({_places('ere')}, ',') AS value FROM {_CHARS}")(lambda d: d.select("doc_id", F.array_join(positions.positions(c, "ere").cast("array<string>"), ",").alias("value")))
on_corpus("d2_whole_word_positions", f"SELECT doc_id, array_to_string({_places('re', _WHOLE)}, ',') AS value FROM {_CHARS}")(
    lambda d: d.select("doc_id", F.array_join(positions.positions(c, "re", whole_word=True).cast("array<string>"), ",").alias("value"))
)
computed(
    "d3_regex_positions",
    lambda: F.array_join(positions.regex_positions(c, "th[aeiou]+").cast("array<string>"), ","),
    """coalesce(array_to_string(list_transform(generate_series(1, len(regexp_extract_all(content, 'th[aeiou]+'))), lambda i:
      CAST(list_sum(list_transform(string_split_regex(content, 'th[aeiou]+')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(content, 'th[aeiou]+')[1:i - 1], lambda x: length(x))), 0) AS BIGINT)), ','), '')""",
)


@on_corpus("d4_match_count", f"SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 0) AS documents FROM (SELECT len({_places('ere')}) AS n FROM {_CHARS})")
def _d4(d: DataFrame) -> DataFrame:
    n = positions.match_count(c, "ere")
    return d.agg(F.sum(n).alias("total"), F.count_if(n > 0).alias("documents"))


_TOKENS = f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS word_idx, w AS word FROM (SELECT doc_id, unnest({WORDS.format('content')}) AS w, generate_subscripts({WORDS.format('content')}, 1) AS i FROM corpus)"""
#: All runs of word characters with their places, for the twins of the positional operators.
_RUNS = """runs AS (SELECT doc_id, i, w, CAST(coalesce(sum(g + length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - length(w) AS INTEGER) AS start
  FROM (SELECT doc_id, unnest(regexp_extract_all(content, '[A-Za-z0-9_À-ÿ]+')) AS w, generate_subscripts(regexp_extract_all(content, '[A-Za-z0-9_À-ÿ]+'), 1) AS i,
    unnest(list_transform(string_split_regex(content, '[A-Za-z0-9_À-ÿ]+')[1:len(regexp_extract_all(content, '[A-Za-z0-9_À-ÿ]+'))], lambda x: length(x))) AS g FROM corpus)),
  toks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS word_idx, w AS word, start, CAST(start + length(w) - 1 AS INTEGER) AS "end" FROM runs WHERE length(w) > 1)"""


def on_tokens(name: str, sql: str | None) -> Callable[[Callable[[DataFrame, DataFrame], DataFrame]], Query]:
    def keep(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = corpus(spark, sf_dir)
            return f(d, tokens.tokens(d))

        return query(name, f"WITH {CORPUS}, {_RUNS} {sql}" if sql else None, with_corpus=False)(run)

    return keep


def _near_places_sql(places: str, word: str, d: int) -> str:
    """Documents in which a word with ``word`` is at most d words from one that holds one of the places (a query: doc_id, pos)."""
    return f""", hits AS ({places}), a AS (SELECT DISTINCT h.doc_id, max(t.word_idx) AS i FROM hits h JOIN toks t ON t.doc_id = h.doc_id AND t.start <= h.pos GROUP BY h.doc_id, h.pos)
      SELECT DISTINCT a.doc_id FROM a JOIN toks b ON a.doc_id = b.doc_id AND contains(lower(b.word), '{word}') AND abs(a.i - b.word_idx) <= {d} JOIN corpus ON corpus.doc_id = a.doc_id WHERE length(content) >= 10"""


_UPPER = "'[A-Z]{4,}'"
_UPPER_PLACES = f"""SELECT doc_id, unnest(list_transform(generate_series(1, len(regexp_extract_all(content, {_UPPER}))), lambda i:
  CAST(list_sum(list_transform(string_split_regex(content, {_UPPER})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(content, {_UPPER})[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS pos FROM corpus"""
on_tokens("c20_near_regex", _near_places_sql(_UPPER_PLACES, "the", 4))(lambda d, _: d.filter(near.near(c, "/[A-Z]{4,}/", "the", 4, fuzzy=False)).select("doc_id"))
on_tokens("c23_near_phrase", _near_places_sql(f"SELECT doc_id, unnest({_places('of the')}) AS pos FROM {_CHARS}", "and", 3))(lambda d, _: d.filter(near.near(c, "of the", "and", 3, fuzzy=False)).select("doc_id"))


@on_tokens("d5_fuzzy_positions", f"SELECT doc_id, word, start FROM toks WHERE {_close_sql('lower(word)', 'threoa')}")
def _d5(d: DataFrame, t: DataFrame) -> DataFrame:
    return fuzzy.fuzzy_positions(t, "threoa").select("doc_id", "word", "start")


@on_tokens("d6_tokens", 'SELECT doc_id, word_idx, word, start, "end" FROM toks')
def _d6(d: DataFrame, t: DataFrame) -> DataFrame:
    return t


_HITS = f"hits AS (SELECT doc_id, CAST(unnest({_places('estion')}) AS INTEGER) AS pos FROM {_CHARS})"


@on_tokens("d7_word_index_at", f", {_HITS} SELECT h.doc_id, h.pos, coalesce(max(t.word_idx), -1) AS word_idx FROM hits h LEFT JOIN toks t ON t.doc_id = h.doc_id AND t.start <= h.pos GROUP BY h.doc_id, h.pos")
def _d7(d: DataFrame, t: DataFrame) -> DataFrame:
    return tokens.word_index_at(positions.positions_table(d, positions.positions(c, "estion")), t)


@on_tokens(
    "d8_word_distance",
    f", {_HITS}, idx AS (SELECT h.doc_id, h.pos, coalesce(max(t.word_idx), -1) AS word_idx FROM hits h LEFT JOIN toks t ON t.doc_id = h.doc_id AND t.start <= h.pos GROUP BY h.doc_id, h.pos) "
    "SELECT doc_id, CASE WHEN min(word_idx) < 0 OR max(word_idx) < 0 THEN -1 ELSE max(word_idx) - min(word_idx) END AS distance FROM idx GROUP BY doc_id",
)
def _d8(d: DataFrame, t: DataFrame) -> DataFrame:
    at = tokens.word_index_at(positions.positions_table(d, positions.positions(c, "estion")), t)
    ends = at.groupBy("doc_id").agg(F.min("word_idx").alias("i"), F.max("word_idx").alias("j"))
    return ends.select("doc_id", tokens.word_distance(F.col("i"), F.col("j")).alias("distance"))


_SPLIT = r"list_filter(string_split_regex(lower(content), '\s+'), lambda w: w <> '')"
_LEAST = f"""(SELECT doc_id, coalesce(min(abs(i - j)), -1) AS d FROM (SELECT doc_id,
  unnest(CASE WHEN len(a) = 0 THEN [NULL] ELSE a END) AS i, b FROM (SELECT doc_id, list_filter(generate_series(1, len(ws)), lambda i: contains(ws[i], 'estion')) AS a, list_filter(generate_series(1, len(ws)), lambda i: contains(ws[i], 'the')) AS b
  FROM (SELECT doc_id, {_SPLIT} AS ws FROM corpus))), LATERAL (SELECT unnest(CASE WHEN len(b) = 0 THEN [NULL] ELSE b END) AS j) GROUP BY doc_id)"""
on_corpus("d9_min_term_distance", f"SELECT doc_id, CAST(d AS INTEGER) AS value FROM {_LEAST}")(lambda d: d.select("doc_id", tokens.nearest_words(c, "estion", "the").alias("value")))
on_corpus("d10_within_distance", f"SELECT doc_id FROM {_LEAST} WHERE d BETWEEN 0 AND 4")(lambda d: d.filter(tokens.within_distance(c, "estion", "the", 4)).select("doc_id"))
_LINES = """(SELECT doc_id, i - 1 AS line_no, ls[i] AS line, coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS start
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM corpus)))"""
on_corpus("d11_matched_lines", f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, CAST(start AS INTEGER) AS start FROM {_LINES} WHERE contains(lower(line), 'estion')")(lambda d: positions.matched_lines(d, lambda x: F.lower(x).contains("estion")))
_AT = "(instr(lower(content), 'estion') - 1)"


def at_first(name: str, value: Callable[[Column], Column], sql: str) -> None:
    """Of the first hit in every document; null where there is none."""
    on_corpus(name, f"SELECT doc_id, CASE WHEN contains(lower(content), 'estion') THEN {sql.replace('@', _AT)} END AS value FROM corpus")(
        lambda d: d.select("doc_id", F.when(F.lower("content").contains("estion"), value(F.instr(F.lower("content"), "estion") - 1)).alias("value"))
    )


at_first("d12_snippet", lambda at: text.snippet(c, at, 6), "CASE WHEN @ > 50 THEN '...' ELSE '' END || substr(content, greatest(@ - 50, 0) + 1, least(@ + 56, length(content)) - greatest(@ - 50, 0)) || CASE WHEN @ + 56 < length(content) THEN '...' ELSE '' END")
at_first("d13_line_number", lambda at: text.line_number(c, at), r"CAST(len(string_split_regex(substr(content, 1, @), '\r?\n')) AS INTEGER)")
at_first("d13_column_number", lambda at: text.column_number(c, at), r"CAST(length(string_split_regex(substr(content, 1, @), '\r?\n')[-1]) + 1 AS INTEGER)")
computed("d14_truncate", lambda: text.truncate(c, 80), "CASE WHEN length(content) <= 80 THEN content ELSE substr(content, 1, 77) || '...' END")
computed("d14_preview", lambda: text.preview(c, 80), "CASE WHEN length(content) <= 80 THEN content ELSE substr(content, 1, 80) || '...' END")
computed("d14_first_lines", lambda: text.first_lines(c, 3), "array_to_string(string_split(content, chr(10))[1:3], chr(10))")
computed("d15_highlight", lambda: positions.highlight(c, ["estion", "the"]), r"regexp_replace(content, '(?i)(estion|the)', '<mark>\1</mark>', 'g')")
#: All words of two and of four letters from a to j: 10,100 terms.
_MANY = ["".join(x) for n in (2, 4) for x in product("abcdefghij", repeat=n)]
_MANY_SQL = "(?i:[a-j]{4}|[a-j]{2})"
on_corpus("d15_many_terms", f"SELECT doc_id, len(regexp_extract_all(content, '{_MANY_SQL}')) AS spans, md5(regexp_replace(content, '({_MANY_SQL})', '<mark>\\1</mark>', 'g')) AS md5 FROM corpus")(
    lambda d: many_terms.highlight_many(d, _MANY).select("doc_id", F.size("spans").cast("long").alias("spans"), F.md5("marked").alias("md5"))
)
on_corpus("c24_many_terms", f"SELECT lower(m) AS term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(content, '{_MANY_SQL}')) AS m FROM corpus) GROUP BY 1")(lambda d: many_terms.match_counts(d, _MANY))
_SPAN_PLACES = "list_filter(generate_series(1, len(ch) - 5), lambda i: {0})".format(" OR ".join("(" + " AND ".join(f"ch[i + {k}] = '{x}'" for k, x in enumerate(t)) + ")" for t in ("estion", "ortion")))
#: The two terms have one length and can't overlap, so every place is a span.
on_corpus("d15_highlight_spans", f"SELECT doc_id, CAST(s - 1 AS INTEGER) AS start, CAST(s + 5 AS INTEGER) AS \"end\", substr(content, s, 6) AS term FROM (SELECT doc_id, content, unnest({_SPAN_PLACES}) AS s FROM {_CHARS})")(lambda d: d.select("doc_id", F.explode(positions.highlight_spans(c, ["estion", "ortion"])).alias("s")).select("doc_id", "s.start", "s.end", "s.term"))


#: Text nodes and tags alternate; the first term that a node holds is marked in it.
_TAGS = r"""'<!--[\s\S]*?-->|<[!?][^>]*>|<(?i:script)[\s>][\s\S]*?</(?i:script)[^>]*>|<(?i:style)[\s>][\s\S]*?</(?i:style)[^>]*>|</?[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>'"""
_MARKED = r"CASE WHEN contains(lower(t), 'the') THEN regexp_replace(t, '(?i)(the)', '<mark>\1</mark>', 'g') WHEN contains(lower(t), 'tion') THEN regexp_replace(t, '(?i)(tion)', '<mark>\1</mark>', 'g') ELSE t END"


@query(
    "d16_highlight_html",
    f"""WITH n AS (SELECT page_id, string_split_regex(html, {_TAGS}) AS texts, regexp_extract_all(html, {_TAGS}) AS tags FROM pages),
    each AS (SELECT page_id, i, texts[i] AS t, coalesce(tags[i], '') AS tag FROM (SELECT *, unnest(generate_series(1, len(texts))) AS i FROM n))
    SELECT page_id, string_agg({_MARKED} || tag, '' ORDER BY i) AS html FROM each GROUP BY page_id""",
    with_corpus=False,
)
def _d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", positions.highlight_html(F.col("html"), ["the", "tion"]).alias("html"))


on_corpus(
    "d17_chunks",
    "SELECT doc_id, CAST(s // 900 AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start, substr(content, s + 1, 1000) AS chunk FROM (SELECT doc_id, content, unnest(generate_series(0, length(content) - 1, 900)) AS s FROM corpus WHERE length(content) > 0)",
)(lambda d: positions.chunks(d, 1000, 100))
_BACK = "instr(reverse(substr(content, i * 1000 - 199, 200)), chr(10)) - 1"
_AHEAD = "instr(substr(content, i * 1000 + 1, 200), chr(10))"
on_corpus(
    "d18_line_safe_chunks",
    f"""SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start, substr(content, s + 1, e - s) AS chunk FROM (
      SELECT doc_id, content, unnest(b) AS s, unnest(list_append(b[2:], length(content))) AS e, unnest(generate_series(1, len(b))) AS k FROM (
        SELECT doc_id, content, list_prepend(0, list_filter(list_transform(generate_series(1, (length(content) - 1) // 1000), lambda i:
          CASE WHEN {_BACK} >= 0 AND ({_AHEAD} = 0 OR {_BACK} <= {_AHEAD}) THEN i * 1000 - ({_BACK}) WHEN {_AHEAD} > 0 THEN i * 1000 + {_AHEAD} ELSE i * 1000 END), lambda x: x < length(content))) AS b
        FROM corpus WHERE length(content) > 0))""",
)(lambda d: positions.line_safe_chunks(d, 1000, 200))


on_corpus(
    "d17_chunk_flags",
    "SELECT doc_id, CAST(s // 900 AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start, contains(lower(substr(content, s + 1, 1000)), 'estion') AND NOT contains(lower(substr(content, s + 1, 1000)), 'ortion') AS matched FROM (SELECT doc_id, content, unnest(generate_series(0, length(content) - 1, 900)) AS s FROM corpus WHERE length(content) > 0)",
)(lambda d: positions.chunk_flags(d, lambda x: compile_query(all_of(Term("estion"), Not(Term("ortion"))), x, STRICT), 1000, 100))


def _one_file(spark: SparkSession, sf_dir: str) -> str:
    """All texts as the lines of one file, by doc_id."""
    path = new_path(spark)
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("value"))
    document.write(rows, f"{path}/all.txt", ["doc_id"])
    return f"{path}/all.txt"


_ONE = "one AS (SELECT string_agg(replace(coalesce(text, ''), chr(10), ' '), chr(10) ORDER BY doc_id) AS t FROM documents)"


@query("d17_positions_of_one_file", f"WITH {_ONE}, g AS (SELECT string_split(lower(t), 'estion') AS g FROM one), s AS (SELECT unnest(g) AS g, unnest(generate_series(1, len(g))) AS i, len(g) AS n FROM g) SELECT pos FROM (SELECT CAST(sum(length(g)) OVER (ORDER BY i) + 6 * (i - 1) AS BIGINT) AS pos, i, n FROM s) WHERE i < n", with_corpus=False)
def _d17_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus as one file, searched in ranges of 10,000 bytes by many tasks."""
    rows = ranges.ranges(spark, _one_file(spark, sf_dir), size=10_000, overlap=100, task_bytes=200_000)
    return ranges.places(rows, "estion", 100).select("pos")


@query("d17_flags_of_one_file", f"WITH {_ONE} SELECT contains(lower(t), 'estion') AS whole, CAST(strlen(t) AS BIGINT) AS bytes, CAST(length(t) AS BIGINT) AS chars FROM one", with_corpus=False)
def _d17_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranges.flags(ranges.ranges(spark, _one_file(spark, sf_dir), size=10_000, overlap=100, task_bytes=200_000), Term("estion"), STRICT)
    own = F.substring("chunk", F.lit(1), F.col("own_chars"))
    return rows.agg(F.bool_or("matched").alias("whole"), F.sum(F.octet_length(own).cast("long")).alias("bytes"), F.sum("own_chars").alias("chars"))


_TWISTED = "CASE WHEN doc_id % 4 = 0 AND length(content) > 2400 THEN substr(content, 1, 600) || '#' || substr(content, 602) ELSE content END"


@on_corpus("d21_duplicate_groups", f"""SELECT id, grp AS "group", copies FROM (SELECT id, min(id) OVER (PARTITION BY content) AS grp, count(*) OVER (PARTITION BY content) AS copies
  FROM (SELECT doc_id AS id, content FROM corpus UNION ALL SELECT doc_id + 10000000, {_TWISTED} FROM corpus WHERE doc_id % 2 = 0)) WHERE copies > 1""")  # fmt: skip
def _d21_groups(d: DataFrame) -> DataFrame:
    """The corpus with copies of every other document, of which half differ in a place that no sample sees."""
    n = F.length("content")
    twisted = F.when((F.col("doc_id") % 4 == 0) & (n > 2400), F.concat(F.substring("content", 1, 600), F.lit("#"), F.substring("content", F.lit(602), n))).otherwise(F.col("content"))
    copies = d.filter("doc_id % 2 = 0").select((F.col("doc_id") + 10_000_000).alias("id"), twisted.alias("content"))
    return duplicates.duplicate_groups(d.select(F.col("doc_id").alias("id"), "content").unionByName(copies), "id")


@on_tokens("d19_boundaries", 'SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, start AS pos FROM toks UNION ALL SELECT doc_id, "end" + 1 FROM toks)')
def _d19(d: DataFrame, t: DataFrame) -> DataFrame:
    return tokens.boundary_positions(d)


at_first("d19_is_whole_word", lambda at: positions.whole_word_at(c, at, 6), "NOT ((@ > 0 AND regexp_matches(substr(content, @, 1), '[A-Za-z0-9_]')) OR regexp_matches(substr(content, @ + 7, 1), '[A-Za-z0-9_]'))")
computed("d20_normalise_lines", lambda: text.join_lines(F.transform(text.split_lines(c), text.normalise)), r"array_to_string(list_transform(string_split_regex(content, '\r?\n'), lambda x: lower(trim(x))), chr(10))")
computed("d21_fingerprint", lambda: text.fingerprint(c), "substr(md5(content), 1, 16)")
computed(
    "d21_sampled_fingerprint",
    lambda: text.sampled_fingerprint(c),
    "substr(md5(CASE WHEN length(content) < 1000 THEN content ELSE substr(content, 1, 500) || substr(content, length(content) // 2 - 250 + 1, 500) || right(content, 500) END), 1, 16)",
)

# --- scalar functions ----------------------------------------------------------------------------------------------------------
computed("x1_normalise_path", lambda: paths.normalised(F.replace(p, F.lit("/"), F.lit("\\"))), "file_path")
on_corpus(
    "x2_path_parts",
    r"""SELECT doc_id, lower(regexp_extract(file_path, '\.([^./]+)$', 1)) AS ext, regexp_extract(file_path, '[^/]*$') AS base, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]*$', '') AS stem,
    regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, substr(file_path, 9) AS rel, lower(regexp_extract(file_path, '\.([^./]+)$', 1)) = 'md' AS is_md FROM corpus""",
)(lambda d: d.select("doc_id", paths.extension(p).alias("ext"), paths.base_name(p).alias("base"), paths.stem(p).alias("stem"), paths.directory(p).alias("dir"), paths.relative(p, "/corpus").alias("rel"), paths.has_extension(p, ".MD").alias("is_md")))
_EXT = "(['txt','md','log','json'])[doc_id % 4 + 1]"
#: Every extension of the two fixed tables, and one of neither: the documents are named by these in turn.
_ALL_EXT = sorted({e for kinds in (paths.LANGUAGES, paths.CATEGORIES) for exts in kinds.values() for e in exts.split()} | {"zzz"})
_NAMED = f"(SELECT doc_id, {_ALL_EXT}[doc_id % {len(_ALL_EXT)} + 1] AS ext FROM corpus)"


def _named(d: DataFrame) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _ALL_EXT)), (F.col("doc_id") % len(_ALL_EXT) + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("/x/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_path"))


def _kind_sql(kinds: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN ext IN ({', '.join(map(repr, exts.split()))}) THEN '{kind}'" for kind, exts in kinds.items()) + f" ELSE '{other}' END"


on_corpus("x3_language", f"SELECT doc_id, {_kind_sql(paths.LANGUAGES, 'plaintext')} AS value FROM {_NAMED}")(lambda d: _named(d).select("doc_id", paths.language(p).alias("value")))
on_corpus("x4_category", f"SELECT doc_id, {_kind_sql(paths.CATEGORIES, 'other')} AS category FROM {_NAMED}")(lambda d: paths.categories(_named(d)).select("doc_id", "category"))
computed(
    "x5_format_file_size",
    lambda: text.format_file_size(F.col("size")),
    r"""CASE WHEN size = 0 THEN '0 Bytes' WHEN size < 1024 THEN size || ' Bytes' ELSE regexp_replace(regexp_replace(CAST(CAST(round(size / 1024.0::DOUBLE, 2) AS DECIMAL(38, 2)) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '') || ' KB' END""",
)
computed(
    "x6_format_duration",
    lambda: text.format_duration(F.col("size") * 997),
    """CASE WHEN size * 997 < 1000 THEN size * 997 || 'ms' WHEN size * 997 // 1000 < 60 THEN size * 997 // 1000 || 's'
    WHEN size * 997 // 60000 < 60 THEN size * 997 // 60000 || 'm ' || (size * 997 // 1000) % 60 || 's'
    ELSE size * 997 // 3600000 || 'h ' || (size * 997 // 60000) % 60 || 'm ' || (size * 997 // 1000) % 60 || 's' END""",
)


@query("x7_safe_json", "SELECT event_id, coalesce(CAST(json_extract(CASE WHEN event_id % 10 = 0 THEN '{' ELSE props END, '$.k') AS BIGINT), -1) AS k FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 10 = 0", with_corpus=False)
def _x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 10 == 0, "{").otherwise(F.col("props"))
    parsed = text.parse_json(broken, "k long", F.lit(None).cast("struct<k:bigint>"))
    return read_table(spark, sf_dir, "events").select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


@query("x8_leading_number", "SELECT event_id, round(abs(value), 2) AS value FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 0.0 FROM events WHERE event_id % 2 = 0", with_corpus=False)
def _x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.round(F.abs("value"), 2).cast("decimal(18,2)").cast("string")
    label = F.when(F.col("event_id") % 2 == 1, F.concat(shown, F.lit(" ms"))).otherwise(F.concat(F.lit("-"), shown))
    return read_table(spark, sf_dir, "events").select("event_id", text.leading_number(label).alias("value"))


# --- sources, exports, result sets ---------------------------------------------------------------------------------------------
def _searched_sql(most: int) -> str:
    return f""", searched AS (SELECT doc_id, file_path, mtime, size, lang, content AS whole, CASE WHEN size > {most} THEN NULL ELSE content END AS content,
  CASE WHEN size > {most} THEN 'fileTooLarge:' || size END AS read_error, coalesce(size <= {most} AND contains(lower(content), 'estion'), false) AS matched FROM corpus)"""


def on_results(name: str, sql: str | None, most: int = MAX_BYTES) -> Callable[[Callable[[DataFrame, DataFrame], DataFrame]], Query]:
    """Registers a query over the corpus and the result of a search in it, files over ``most`` bytes being read errors."""

    def keep(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = with_read_status(corpus(spark, sf_dir), most)
            return f(d, search(d, Term("estion"), STRICT))

        return query(name, f"{_searched_sql(most)} {sql}" if sql else None)(run)

    return keep


@query("s1_scan_files", "SELECT 'lang=' || lang || '/source=' || source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1", with_corpus=False)
def _s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as text files in folders, and found again by a scan of these files."""
    path = new_path(spark)
    read_table(spark, sf_dir, "documents").filter("text is not null").select("lang", "source", "text").write.partitionBy("lang", "source").text(path)
    found = scan(spark, path, ["txt"])
    return found.groupBy(F.regexp_extract("file_path", "(lang=[^/]*/source=[^/]*)/[^/]*$", 1).alias("folder")).agg(F.sum(F.octet_length("content")).alias("bytes"))


#: Documents as files: hidden, with an underscore, empty, in upper case; by rule from doc_id.
_NAME_SQL = """lang || '/' || CASE doc_id % 5 WHEN 0 THEN '.hidden_' WHEN 1 THEN '_under_' ELSE 'doc_' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.TXT' WHEN doc_id % 3 = 1 THEN '.md' ELSE '' END"""
_KEPT_SQL = "CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END"


def _as_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the documents written as files under these names."""
    ending = F.when(F.col("doc_id") % 3 == 0, ".TXT").when(F.col("doc_id") % 3 == 1, ".md").otherwise("")
    begin = F.when(F.col("doc_id") % 5 == 0, ".hidden_").when(F.col("doc_id") % 5 == 1, "_under_").otherwise("doc_")
    name = F.concat("lang", F.lit("/"), begin, F.col("doc_id").cast("string"), ending)
    rows = read_table(spark, sf_dir, "documents").filter("text is not null").select(name.alias("name"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("content"))
    folder = new_path(spark)
    export.write_files(rows, folder)
    return folder


@query("s1_hidden_and_empty_files", f"SELECT name, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS md5, name LIKE '%.TXT' AS txt FROM (SELECT {_NAME_SQL} AS name, {_KEPT_SQL} AS content FROM documents WHERE text IS NOT NULL)", with_corpus=False)
def _s1_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own; the scan finds hidden and empty ones, with their sizes."""
    found = folders.files(spark, _as_files(spark, sf_dir)).filter("mtime > timestamp '2000-01-01'")
    return found.select(F.regexp_extract("file_path", "([^/]+/[^/]+)$", 1).alias("name"), "size", F.md5("content").alias("md5"), (F.col("ext") == "txt").alias("txt"))


@query("s1_pushed_filters", f"SELECT name, CAST(strlen(content) AS BIGINT) AS size FROM (SELECT {_NAME_SQL} AS name, {_KEPT_SQL} AS content FROM documents WHERE text IS NOT NULL) WHERE name LIKE '%.TXT' AND strlen(content) BETWEEN 500 AND 5000", with_corpus=False)
def _s1_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folder by extension and size: answered by the listing."""
    found = folders.files(spark, _as_files(spark, sf_dir), content=False).filter((F.col("ext") == "txt") & (F.col("size") >= 500) & (F.col("size") <= 5000) & (F.col("depth") == 2))
    return found.select(F.regexp_extract("file_path", "([^/]+/[^/]+)$", 1).alias("name"), "size")


@query("s4_causes", f"""SELECT name, CASE doc_id % 4 WHEN 0 THEN 'fileNotFoundDuringRead' WHEN 1 THEN 'pathIsDir' END AS error, CASE WHEN doc_id % 4 > 1 THEN md5(content) END AS md5
  FROM (SELECT doc_id, {_NAME_SQL} AS name, {_KEPT_SQL} AS content FROM documents WHERE text IS NOT NULL)""", with_corpus=False)  # fmt: skip
def _s4_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's file is asked for, a quarter by a path that is gone, a quarter by the path of its folder."""
    folder = _as_files(spark, sf_dir)
    id_ = F.regexp_extract("file_path", "_([0-9]+)[^/]*$", 1).cast("long")
    wanted = folders.files(spark, folder, content=False).select(F.regexp_extract("file_path", "([^/]+/[^/]+)$", 1).alias("name"), "file_path", id_.alias("id"))
    asked = F.when(F.col("id") % 4 == 0, F.concat("file_path", F.lit(".gone"))).when(F.col("id") % 4 == 1, F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)).otherwise(F.col("file_path"))
    named = stored(wanted.select("name", asked.alias("file_path")))
    got = folders.fetch(spark, named.select("file_path").distinct()).select("file_path", "error", F.md5("content").alias("md5"))
    return named.join(got, "file_path").select("name", "error", "md5")


@query("f13_errors_of_reads", """SELECT lang || '/' || doc_id || '.gone' AS name, 'ENOENT' AS code FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL""", with_corpus=False)
def _f13_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error table of roots that aren't there, one for every other document, filtered as errors of a search are."""
    folder = new_path(spark)
    gone = F.concat(F.lit(f"{folder}/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".gone"))
    wanted = read_table(spark, sf_dir, "documents").filter("doc_id % 2 = 0 and text is not null").select(gone.alias("file_path"))
    errors = folders.fetch(spark, wanted).filter("error = 'fileNotFoundDuringRead'").select(F.lit(folder).alias("search_path"), F.col("file_path").alias("error_path"), F.col("error").alias("message"), F.lit("ENOENT").alias("code"))
    return filters.relevant_errors(errors, ["en"]).select(F.regexp_extract("error_path", "([^/]+/[^/]+)$", 1).alias("name"), "code")


@on_corpus("s2_scan_many", "SELECT file_path, size FROM corpus WHERE lang IN ('en', 'de') OR size > 3000")
def _s2(d: DataFrame) -> DataFrame:
    return union_scans([d.filter("lang = 'en'"), d.filter("lang = 'de'"), d.filter("size > 3000")]).select("file_path", "size")


@on_results("s3_read_status", "SELECT file_path, matched, read_error FROM searched", most=8000)
def _s3(d: DataFrame, r: DataFrame) -> DataFrame:
    return r.select("file_path", "matched", "read_error")


@on_corpus(
    "s4_fetch_content",
    "SELECT w.file_path, c.content, CASE WHEN c.file_path IS NULL THEN 'fileNotFoundDuringRead' END AS error FROM (SELECT file_path || CASE WHEN size % 5 = 0 THEN '.gone' ELSE '' END AS file_path FROM corpus) w LEFT JOIN corpus c USING (file_path)",
)
def _s4(d: DataFrame) -> DataFrame:
    wanted = d.select(F.concat(p, F.when(F.col("size") % 5 == 0, ".gone").otherwise("")).alias("file_path"))
    return fetch_content(wanted, d)


_EXPORTED = """, exported AS (SELECT file_path, CASE WHEN read_error IS NOT NULL THEN 'Read Error' WHEN matched THEN 'Matched' ELSE 'Not Matched' END AS status,
  CASE WHEN read_error IS NOT NULL THEN 'Initial Read Error: ' || read_error WHEN matched THEN content END AS details FROM searched)"""
_SHOWN = "CASE WHEN status = 'Read Error' THEN 'Error: ' || details ELSE coalesce(details, 'No content.') END"
on_results("s5_export_rows", f"{_EXPORTED} SELECT * FROM exported")(lambda d, r: export.export_rows(r, d))
_FIELD = """CASE WHEN {0} IS NULL THEN '' WHEN regexp_matches({0}, '[,"\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""
on_results("s6_csv", f"{_EXPORTED} SELECT {_FIELD.format('file_path')} || ',' || {_FIELD.format('status')} || ',' || {_FIELD.format('details')} AS value FROM exported")(lambda d, r: export.csv_rows(export.export_rows(r, d)))
on_results("s7_json", f"{_EXPORTED} SELECT CAST(to_json({{'filePath': file_path, 'status': status, 'details': details}}) AS VARCHAR) AS value FROM exported")(lambda d, r: export.json_rows(export.export_rows(r, d)))
on_results("s8_markdown", f"{_EXPORTED} SELECT '## ' || file_path || ' (Status: ' || status || ')' || chr(10) || chr(10) || '```' || chr(10) || {_SHOWN} || chr(10) || '```' || chr(10) AS value FROM exported")(lambda d, r: export.markdown_rows(export.export_rows(r, d)))
on_results("s9_txt", f"{_EXPORTED} SELECT file_path || ' (Status: ' || status || ')' || chr(10) || {_SHOWN} || chr(10) AS value FROM exported")(lambda d, r: export.text_rows(export.export_rows(r, d)))
on_results("s10_path_list", "SELECT file_path FROM searched WHERE matched")(lambda d, r: export.path_list(r, r.filter("matched")))
_ENTRY = """CASE WHEN {0} IS NULL THEN 'null' ELSE CAST(to_json({0}) AS VARCHAR) END"""
_DOCUMENTS = {
    "csv": ("'FilePath,Status,Details' || chr(10)", f"{_FIELD.format('file_path')} || ',' || {_FIELD.format('status')} || ',' || {_FIELD.format('details')}", "chr(10)", "''"),
    "json": ("'[' || chr(10)", "'  {' || chr(10) || '    \"filePath\": ' || " + f"{_ENTRY.format('file_path')} || ',' || chr(10) || '    \"status\": ' || {_ENTRY.format('status')} || ',' || chr(10) || '    \"details\": ' || {_ENTRY.format('details')} || chr(10) || '  }}'", "',' || chr(10)", "chr(10) || ']'"),
    "markdown": ("''", f"'## ' || file_path || ' (Status: ' || status || ')' || chr(10) || chr(10) || '```' || chr(10) || {_SHOWN} || chr(10) || '```' || chr(10)", "chr(10) || '---' || chr(10) || chr(10)", "''"),
    "txt": ("''", f"file_path || ' (Status: ' || status || ')' || chr(10) || {_SHOWN} || chr(10)", "chr(10) || repeat('-', 40) || chr(10) || chr(10)", "''"),
}
_DOCUMENTS_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, entries, CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM (SELECT count(*) AS entries, {head} || string_agg({entry}, {between} ORDER BY file_path) || {tail} AS t FROM exported)"
    for kind, (head, entry, between, tail) in _DOCUMENTS.items()
)


@on_results("s6_to_s9_documents", f"{_EXPORTED} {_DOCUMENTS_SQL}", most=8000)
def _s6_to_s9(d: DataFrame, r: DataFrame) -> DataFrame:
    """Each format's one file, in order, by its number of entries, bytes and digest."""
    path, exported, out = new_path(d.sparkSession), stored(export.export_rows(r, d)), None
    for kind in _DOCUMENTS:
        export.write_document(exported, kind, f"{path}/export.{kind}")
        row = document.described(d, f"{path}/export.{kind}").select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_COPIES = """, one AS (SELECT regexp_extract(file_path, '[^/]*$') AS name, min(file_path) AS first, max(file_path) AS last FROM searched WHERE matched GROUP BY 1)"""


@on_results("s11_materialise", f"""{_COPIES}, old AS (SELECT name FROM one WHERE CAST(regexp_extract(name, '[0-9]+') AS BIGINT) % 3 = 0)
  SELECT 'first' AS load, 'copied' AS outcome, count(*) AS names FROM old UNION ALL
  SELECT 'skip', CASE WHEN name IN (FROM old) THEN 'skipped' ELSE 'copied' END, count(*) FROM one GROUP BY 2 UNION ALL
  SELECT 'replace', 'replaced', count(*) FROM one UNION ALL
  SELECT 'found', 'bytes', CAST(sum(strlen(content)) AS BIGINT) FROM one JOIN searched ON file_path = last UNION ALL SELECT 'found', 'files', count(*) FROM one""")  # fmt: skip
def _s11(d: DataFrame, r: DataFrame) -> DataFrame:
    """A third of the names is copied first; then all with skip, then all with replace; then what the folder holds is read."""
    folder = new_path(d.sparkSession)
    old = F.regexp_extract(paths.base_name(p), "[0-9]+", 0).cast("long") % 3 == 0
    loads = [("first", r.filter(old), "skip"), ("skip", r, "skip"), ("replace", r, "replace")]
    parts = [export.materialise(some, d, folder, how).groupBy("outcome").agg(F.count("*").alias("names")).select(F.lit(load).alias("load"), "outcome", "names") for load, some, how in loads]
    there = stored(folders.files(d.sparkSession, folder).agg(F.sum(F.octet_length("content").cast("long")).alias("bytes"), F.count("*").alias("files")))
    parts.append(there.unpivot([], ["bytes", "files"], "outcome", "names").select(F.lit("found").alias("load"), "outcome", "names"))
    return union_all(parts)


on_results(
    "s11_named_copies",
    "SELECT regexp_extract(file_path, '[^/]*$') AS name, min(file_path) AS file_path FROM searched WHERE matched GROUP BY 1",
)(lambda d, r: export.named_copies(r, d).select("name", "file_path"))
on_results("a1_search_summary", "SELECT count(*) AS files_found, count(*) FILTER (read_error IS NULL) AS files_processed, count(*) FILTER (matched AND read_error IS NULL) AS files_matched, count(*) FILTER (read_error IS NOT NULL) AS errors FROM searched")(lambda d, r: results.summary(r))
_DIRS = "list_filter(list_transform(generate_series(1, len(string_split(file_path, '/')) - 1), lambda n: array_to_string(string_split(file_path, '/')[1:n], '/')), lambda d: d <> '')"
on_results("a13_directory_rollup", f"SELECT directory, bool_or(matched) AS matched, count(*) AS files, count(*) FILTER (matched) AS matched_files FROM (SELECT unnest({_DIRS}) AS directory, matched FROM searched) GROUP BY directory")(lambda d, r: results.directory_rollup(r))
on_results(
    "a14_tree_edges",
    f"SELECT DISTINCT nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS parent, path, is_directory FROM (SELECT unnest({_DIRS}) AS path, true AS is_directory FROM searched UNION ALL SELECT file_path, false FROM searched)",
)(lambda d, r: results.tree_edges(r))
on_results("o1_sort_by_matched", "SELECT file_path, matched FROM searched ORDER BY matched AND read_error IS NULL DESC, file_path")(lambda d, r: results.sort_results(r, "matched", True).select("file_path", "matched"))
on_results("o2_limit", "SELECT file_path, size FROM searched ORDER BY size DESC, file_path LIMIT 100")(lambda d, r: results.limit(r, 100, "size", True).select("file_path", "size"))
on_results("j2_selected_or_all", "SELECT file_path FROM searched WHERE matched")(lambda d, r: results.selected_or_all(r, r.filter("matched")).select("file_path"))
on_results("u2_toggle", "SELECT file_path FROM searched WHERE matched <> (lang = 'en')")(lambda d, r: results.toggle(r.filter("matched"), r.filter("lang = 'en'")))
on_results("u2_deselect", "SELECT file_path FROM searched WHERE lang = 'en' AND NOT matched")(lambda d, r: results.deselect(r.filter("lang = 'en'"), r.filter("matched")))
on_results("u2_select_all", "SELECT file_path FROM searched WHERE lang = 'en' OR matched")(lambda d, r: results.select_all(r.filter("lang = 'en'"), r.filter("matched")))

# --- line counts ---------------------------------------------------------------------------------------------------------------
_METRICS = r""", metrics AS (SELECT doc_id, file_path, total, blank, comment, total - blank - comment AS code FROM (SELECT doc_id, file_path, len(ls) AS total, len(list_filter(ls, lambda x: x = '')) AS blank,
  len(list_filter(ls, lambda x: regexp_matches(x, '^(//|/\*|\*|#)'))) AS comment FROM (SELECT doc_id, file_path, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM corpus)))"""
_SUMMED = "count(*) AS files, CAST(sum(total) AS BIGINT) AS total, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(code) AS BIGINT) AS code"
on_corpus("a2_line_metrics", f"{_METRICS} SELECT * FROM metrics")(telemetry.line_metrics)
on_corpus("a3_line_metrics_by_ext", rf"{_METRICS} SELECT lower(regexp_extract(file_path, '\.([^./]+)$', 1)) AS ext, {_SUMMED} FROM metrics GROUP BY 1")(lambda d: telemetry.line_metrics_by_extension(telemetry.line_metrics(d)))
on_corpus("a4_line_metrics_by_dir", f"{_METRICS} SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, {_SUMMED} FROM metrics GROUP BY 1")(lambda d: telemetry.line_metrics_by_directory(telemetry.line_metrics(d)))
on_corpus(
    "a5_line_metrics_total",
    f"{_METRICS} SELECT *, CAST(round(blank * 100.0 / total) AS BIGINT) AS blank_percent, CAST(round(comment * 100.0 / total) AS BIGINT) AS comment_percent, CAST(round(code * 100.0 / total) AS BIGINT) AS code_percent FROM (SELECT {_SUMMED} FROM metrics)",
)(lambda d: telemetry.line_metrics_total(telemetry.line_metrics(d)))
on_corpus("a5_line_metrics_rollup", rf"{_METRICS} SELECT lower(regexp_extract(file_path, '\.([^./]+)$', 1)) AS ext, {_SUMMED} FROM metrics GROUP BY ROLLUP (lower(regexp_extract(file_path, '\.([^./]+)$', 1)))")(lambda d: telemetry.line_metrics_rollup(telemetry.line_metrics(d)))
on_corpus("a12_content_size_stats", "SELECT CAST(sum(length(content)) AS BIGINT) AS total, count(content) AS docs, CAST(min(length(content)) AS INTEGER) AS minimum, CAST(max(length(content)) AS INTEGER) AS maximum, avg(length(content)) AS average FROM corpus")(telemetry.content_size_stats)

# --- telemetry over events, orders and lineitem ---------------------------------------------------------------------------------


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("name"), F.col("value").alias("duration"), (F.col("value") - 50).alias("memory_delta"), "user_id")


def on_ops(name: str, sql: str | None) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a query over the events as named operations."""

    def keep(f: Callable[[DataFrame], DataFrame]) -> Query:
        head = "WITH ops AS (SELECT event_id AS id, ts, event_type AS name, value AS duration, value - 50 AS memory_delta, user_id FROM events)"
        return query(name, f"{head} {sql}" if sql else None, with_corpus=False)(lambda spark, sf_dir: f(_ops(spark, sf_dir)))

    return keep


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 4) for n in names})


on_ops("a6_op_summary", "SELECT name, round(sum(duration), 4) AS total, count(*) AS calls, round(avg(duration), 4) AS average, round(sum(duration) * 100 / (SELECT sum(duration) FROM ops), 4) AS percent FROM ops GROUP BY name ORDER BY sum(duration) DESC, name LIMIT 10")(
    lambda o: _rounded(telemetry.op_summary(o), "total", "average", "percent")
)


@query("a7_percent_of_parent", "SELECT l_orderkey AS parent, l_linenumber AS id, round(CASE WHEN o_totalprice <> 0 THEN l_extendedprice * 100 / o_totalprice ELSE 0 END, 4) AS percent FROM lineitem JOIN orders ON l_orderkey = o_orderkey", with_corpus=False)
def _a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("id"), F.col("l_extendedprice").alias("duration"))
    parents = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("duration"))
    return _rounded(telemetry.percent_of_parent(children, parents).select("parent", "id", "percent"), "percent")


on_ops("a8_op_stats", "SELECT name, count(*) AS calls, round(sum(duration), 4) AS total, min(duration) AS minimum, max(duration) AS maximum FROM ops GROUP BY name")(lambda o: _rounded(telemetry.op_stats(o), "total"))
_HALVES = "b AS (SELECT name, avg(duration) AS before FROM ops WHERE id % 2 = 0 AND name <> 'view' GROUP BY name), a AS (SELECT name, avg(duration) AS after FROM ops WHERE id % 2 = 1 AND name <> 'click' GROUP BY name)"
_COMPARED = "SELECT name, before, after, CASE WHEN before = 0 THEN 0 ELSE (after - before) / before * 100 END AS change, CASE WHEN before IS NULL THEN 'after' WHEN after IS NULL THEN 'before' ELSE 'both' END AS side FROM b FULL JOIN a USING (name)"


def _compared(o: DataFrame) -> DataFrame:
    return telemetry.compare(o.filter("id % 2 = 0 AND name <> 'view'"), o.filter("id % 2 = 1 AND name <> 'click'"))


on_ops("a9_compare", f", {_HALVES} SELECT name, round(before, 4) AS before, round(after, 4) AS after, round(change, 4) AS change, side FROM ({_COMPARED})")(lambda o: _rounded(_compared(o), "before", "after", "change"))
on_ops("a9_overall_change", f", {_HALVES} SELECT round(avg(change), 4) AS overall_change, count(*) AS names FROM ({_COMPARED}) WHERE side = 'both'")(lambda o: _rounded(telemetry.overall_change(_compared(o)), "overall_change"))


def _reports(o: DataFrame) -> DataFrame:
    part = o.withColumn("report", F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")))
    return part.groupBy("report", "name").agg(F.sum(F.col("duration") * (F.col("id") % 7)).alias("percent")).filter("NOT (report = 'r0' AND name = 'view')")


on_ops(
    "a10_compare_reports",
    """, r AS (SELECT 'r' || (user_id % 3) AS report, name, sum(duration * (id % 7)) AS percent FROM ops WHERE NOT (user_id % 3 = 0 AND name = 'view') GROUP BY 1, 2),
    w AS (SELECT name, coalesce(max(percent) FILTER (report = 'r0'), 0) AS r0, coalesce(max(percent) FILTER (report = 'r1'), 0) AS r1, coalesce(max(percent) FILTER (report = 'r2'), 0) AS r2 FROM r GROUP BY name)
    SELECT name, round(r0, 4) AS r0, round(r1, 4) AS r1, round(r2, 4) AS r2, CASE WHEN r0 = 0 AND r2 > 10 THEN 'new' WHEN r0 > 0 AND r2 > r0 * 1.5 THEN 'slower' WHEN r2 > 0 AND r0 > r2 * 1.5 THEN 'faster' ELSE 'none' END AS flag FROM w""",
)(lambda o: _rounded(telemetry.compare_reports(_reports(o), ["r0", "r1", "r2"]), "r0", "r1", "r2"))
on_ops(
    "a11_hot_ops",
    """, t AS (SELECT name, sum(duration) * 100 / (SELECT sum(duration) FROM ops) AS percent, avg(duration) AS average, count(*) AS calls FROM ops GROUP BY name)
    SELECT name, 'share' AS reason FROM t WHERE percent > 20 UNION ALL SELECT name, 'slow' FROM t WHERE average > 50 UNION ALL SELECT name, 'frequent' FROM t WHERE calls > 1000""",
)(lambda o: telemetry.hot_ops(telemetry.op_totals(o)))
on_ops("a15_memory_by_op", "SELECT name, round(sum(memory_delta), 4) AS memory FROM ops GROUP BY name HAVING sum(memory_delta) <> 0 ORDER BY abs(sum(memory_delta)) DESC, name LIMIT 10")(lambda o: _rounded(telemetry.memory_by_op(o), "memory"))


@query("a16_complexity", "SELECT l_orderkey AS file, count(*) AS functions, round(avg(l_quantity), 4) AS mean, round(sum(l_quantity), 4) AS total, count(*) FILTER (l_quantity >= 10) AS high_count FROM lineitem GROUP BY l_orderkey", with_corpus=False)
def _a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("function"), F.col("l_quantity").alias("value"))
    return _rounded(telemetry.complexity(functions), "mean", "total")


on_ops(
    "w1_latest_of_frequent",
    ", top AS (SELECT name FROM ops GROUP BY name ORDER BY count(*) DESC, name LIMIT 5) SELECT id, name, duration FROM ops WHERE name IN (SELECT name FROM top) QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, id DESC) <= 100",
)(lambda o: telemetry.latest_of_frequent(o).select("id", "name", "duration"))
on_ops("w2_newest", "SELECT id, name FROM ops ORDER BY ts DESC, id DESC LIMIT 1000")(lambda o: telemetry.newest(o).select("id", "name"))
on_ops(
    "w3_level_changes",
    """, l AS (SELECT name AS key, ts, id, duration, CASE WHEN duration / 100 >= 0.85 THEN 'high' WHEN duration / 100 >= 0.70 THEN 'medium' ELSE 'low' END AS level FROM ops),
    c AS (SELECT *, lag(level) OVER (PARTITION BY key ORDER BY ts, id) AS before FROM l) SELECT key, id, level FROM c WHERE before IS NULL OR before <> level""",
)(lambda o: telemetry.level_changes(o.select(F.col("name").alias("key"), "ts", "id", (F.col("duration") / 100).alias("ratio"))).select("key", "id", "level"))

# --- search history over events --------------------------------------------------------------------------------------------------
_HISTORY = """WITH h AS (SELECT event_id AS id, ts, CASE WHEN event_id % 11 = 0 THEN 'saved ' || event_type END AS name, event_id % 11 = 0 AS fav,
  CASE WHEN event_id % 2 = 0 THEN 'md, txt' ELSE 'md, txt' END AS exts, event_type AS term, user_id % 50 AS u FROM events)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches made from events: the type is the term, the user the folder, and extensions come in two orders."""
    e = read_table(spark, sf_dir, "events")
    fields = {
        "search_paths": F.array(F.concat(F.lit("/home/u"), (F.col("user_id") % 50).cast("string"))),
        "extensions": F.when(F.col("event_id") % 2 == 0, F.array(F.lit("txt"), F.lit("md"))).otherwise(F.array(F.lit("md"), F.lit("txt"))),
        "content_search_term": F.col("event_type"),
        "structured_query": F.col("event_id").cast("string"),
    }
    params = F.struct(*(fields.get(n, F.lit(None)).alias(n) for n in (*history.ARRAYS, *history.VALUES, "structured_query"))).cast(history.PARAMS)
    name = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("saved "), "event_type"))
    return e.select(F.col("event_id").alias("id"), "ts", name.alias("name"), (F.col("event_id") % 11 == 0).alias("is_favorite"), params.alias("params"))


def on_history(name: str, sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    def keep(f: Callable[[DataFrame], DataFrame]) -> Query:
        return query(name, f"{_HISTORY} {sql}", with_corpus=False)(lambda spark, sf_dir: f(_history(spark, sf_dir)))

    return keep


on_history("w4_history_dedupe", "SELECT first(id ORDER BY ts, id) AS id, max(ts) AS ts, first(name ORDER BY ts, id) AS name, first(fav ORDER BY ts, id) AS is_favorite FROM h GROUP BY term, u")(lambda h: history.dedupe(h).select("id", "ts", "name", "is_favorite"))
on_history("w5_history_cap", "SELECT id, name FROM h ORDER BY ts DESC, id DESC LIMIT 50")(lambda h: history.cap(h).select("id", "name"))
on_history("w6_history_order", "SELECT id, fav AS is_favorite FROM h ORDER BY fav DESC, ts DESC, id DESC")(lambda h: history.order(h).select("id", "is_favorite"))
on_history("w7_history_search", "SELECT id FROM h WHERE contains(lower(concat_ws(' ', coalesce(name, ''), '/home/u' || u, '', '', '', term)), 'u7')")(lambda h: history.search(h, "U7").select("id"))


@query("w8_history_update", f"{_HISTORY} SELECT id, CASE WHEN id % 5 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 5 = 0 THEN true ELSE fav END AS is_favorite FROM h", with_corpus=False)
def _w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    patches = h.filter("id % 5 = 0").select("id", F.lit("renamed").alias("name"), F.lit(True).alias("is_favorite"))
    return history.update(h, patches).select("id", "name", "is_favorite")


@query("w4_history_store", f"{_HISTORY}, e AS (SELECT first(id ORDER BY ts, id) AS id, max(ts) AS ts, first(name ORDER BY ts, id) AS name, first(fav ORDER BY ts, id) AS is_favorite FROM h GROUP BY term, u) SELECT id, ts, CASE WHEN id % 3 = 0 THEN 'renamed' ELSE name END AS name, is_favorite OR id % 3 = 0 AS is_favorite FROM e", with_corpus=False)
def _w4_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history in two loads by time, the second twice, then a patch: equal to a rebuild from all of it."""
    h, store = _history(spark, sf_dir), HistoryStore(spark, new_path(spark))
    middle = h.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    late = F.unix_micros(F.col("ts").cast("timestamp")) > middle
    for part in (h.filter(~late), h.filter(late), h.filter(late)):
        store.load(part.withColumn("ts", F.col("ts").cast("timestamp")))
    ids = store.read().filter("id % 3 = 0").select("id", F.lit("renamed").alias("name"), F.lit(True).alias("is_favorite"))
    store.patch(ids)
    return store.read().select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "name", "is_favorite")


# --- streams ---------------------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = 8) -> DataFrame:
    from docsearch.streaming import search as streaming

    # a pattern that matches the table alone: a stream's source takes patterns, but no single file
    return streaming.read_documents(spark, f"{sf_dir}/[{name[0]}]{name[1:]}.parquet", read_table(spark, sf_dir, name).schema, files_per_batch=files_per_batch)


def _to_end(stream: DataFrame, mode: str) -> DataFrame:
    from docsearch.streaming import search as streaming

    return streaming.run_to_table(stream, mode)


@query("r1_stream_search", f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE contains(lower(content), 'estion') AND doc_id IN ({_near_sql(*ESTION_THE, 3)})", with_corpus=False)
def _r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsearch.streaming import search as streaming

    found = streaming.stream_search(_stream(spark, sf_dir, "documents"), all_of(Term("estion"), Near("estion", "the", 3)), STRICT, "text")
    return _to_end(found.filter("matched").select("doc_id"), "append")


@query("r2_stream_progress", "SELECT contains(lower(text), 'estion') AS matched, count(*) AS documents FROM documents GROUP BY 1", with_corpus=False)
def _r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsearch.streaming import search as streaming

    return _to_end(streaming.progress(streaming.stream_search(_stream(spark, sf_dir, "documents"), Term("estion"), STRICT, "text")), "complete")


@query("r3_stream_level_changes", "WITH l AS (SELECT event_type AS key, ts, event_id AS id, CASE WHEN value / 100 >= 0.85 THEN 'high' WHEN value / 100 >= 0.70 THEN 'medium' ELSE 'low' END AS level FROM events), c AS (SELECT *, lag(level) OVER (PARTITION BY key ORDER BY ts, id) AS before FROM l) SELECT key, id, level FROM c WHERE before IS NULL OR before <> level", with_corpus=False)
def _r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsearch.streaming import search as streaming

    folder, events = new_path(spark), read_table(spark, sf_dir, "events")
    events.repartition(8, F.xxhash64("event_id")).write.parquet(folder)  # files in no order of time: most points come late
    points = streaming.read_documents(spark, folder, events.schema, files_per_batch=3)
    points = points.select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("value") / 100).alias("ratio"))
    return streaming.run_level_changes(points).select("key", "id", "level")


@query("r4_windowed_op_stats", "SELECT date_trunc('hour', ts) AS start, event_type AS name, count(*) AS calls, round(sum(value), 4) AS total, min(value) AS minimum, max(value) AS maximum FROM events GROUP BY ALL", with_corpus=False)
def _r4_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsearch.streaming import search as streaming

    ops = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.col("value").alias("duration"))
    return _rounded(_to_end(streaming.windowed_op_stats(ops), "complete"), "total").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r4_stream_op_stats", "SELECT event_type AS name, count(*) AS calls, round(sum(value), 4) AS total, min(value) AS minimum, max(value) AS maximum FROM events GROUP BY 1", with_corpus=False)
def _r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsearch.streaming import search as streaming

    ops = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("duration"))
    return _rounded(_to_end(streaming.stream_op_stats(ops), "complete"), "total")


# --- the flagship ------------------------------------------------------------------------------------------------------------------

FLAGSHIP = all_of(Term("the"), any_of(Term("ortion"), Not(Term("estion"))), Near("for", "and", 5))


@query(
    "q1_flagship_search",
    f"""SELECT doc_id, file_path, size FROM corpus WHERE regexp_extract(file_path, '\\.([^./]+)$', 1) IN ('txt', 'md') AND size BETWEEN 200 AND 20000
    AND len(list_filter(string_split(lower(regexp_extract(file_path, '^(.*)/[^/]*$', 1)), '/'), lambda s: contains(s, 'src13'))) = 0
    AND contains(lower(content), 'the') AND (contains(lower(content), 'ortion') OR NOT contains(lower(content), 'estion'))
    AND doc_id IN ({_near_sql(*FOR_AND, 5)})""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by extension, folder and size, with a boolean query that holds a NEAR, sorted by path."""
    d = corpus(spark, sf_dir)
    some = d.filter(filters.ext_in(p, ["txt", "md"]) & ~filters.folder_excluded(paths.directory(p), ["src13"]) & filters.size_between(F.col("size"), 200, 20_000))
    found = filters.matched_only(search(some, FLAGSHIP, STRICT), True).withColumn("read_error", F.lit(None).cast("string"))
    return results.sort_results(found).select("doc_id", "file_path", "size")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
