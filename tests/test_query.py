import time

import pytest
from pyspark.sql import functions as F

from docsearch.functions.patterns import QueryError
from docsearch.operators import fuzzy, near, positions, tokens
from docsearch.plans.query import Group, Matcher, Near, Not, Regex, Settings, Term, all_of, any_of, check, compile_query, query_terms, search, simplify

STRICT = Settings(fuzzy_terms=False, fuzzy_near=False)


def run(spark, content, column):
    return spark.createDataFrame([(content,)], "content string").select(column).first()[0]


@pytest.mark.parametrize(
    ("content", "tree", "settings", "match"),
    [
        ("This is a SAMPLE text.", Term("sample"), STRICT, True),
        ("This is a SAMPLE text.", Term("sample", True), STRICT, False),
        ("first\ntest string.", Term("/^test/m"), STRICT, True),
        ("This is a test with example content.", any_of(all_of(Term('"test"'), Term("example")), all_of(Term("nonexistent"), Term("missing"))), STRICT, True),
        ("This is a test.", Not(Term("nonexistent")), STRICT, True),
        (None, Not(Term("x")), STRICT, True),
        (None, Term("x"), STRICT, False),
        ("anything", None, STRICT, True),
        ("anything", Group("AND", (Term(" "), Group("OR", ()))), STRICT, True),
        ("tested words", Term("test"), Settings(whole_word=True, fuzzy_terms=False), False),
        ("a test.", Term("test"), Settings(whole_word=True, fuzzy_terms=False), True),
        ("exmaple here", Term("example"), Settings(), True),
        ("ABC", Regex("b", "i"), STRICT, True),
        ("ABC", Regex("b"), STRICT, False),
        ("ABC", Matcher(lambda c: F.length(c) == 3), STRICT, True),
        ("test\n\n\n\nexample", {"operator": "AND", "conditions": [{"type": "near", "term1": "test", "term2": "example", "distance": 4}]}, STRICT, True),
    ],
)
def test_trees(spark, content, tree, settings, match):
    assert run(spark, content, compile_query(tree, settings=settings)) is match


def test_query_errors(spark):
    with pytest.raises(QueryError):
        check(spark, any_of(Term("a"), Regex("a(b")))
    with pytest.raises(QueryError):
        simplify({"operator": "XOR", "conditions": []})
    with pytest.raises(QueryError):
        simplify({"type": "near", "term1": "a"})


def test_query_terms():
    tree = all_of(Term('Term: "a"'), Term("AND"), any_of(Regex("b+", "i"), Near("c", "a", 2)), Not(Term("d")))
    assert query_terms(tree) == ["a", "/b+/i", "c", "d"]


FAR = "start " + "filler " * 1000 + "middle " + "filler " * 1000 + "end"


@pytest.mark.parametrize(
    ("content", "one", "two", "d", "match"),
    [
        ("This is a test example with some words between test and example.", "test", "example", 5, True),
        ("This is a test. And many words later we find an example.", "test", "example", 3, False),
        ("word1 word2 word3 word4 word5 word6", "word1", "word6", 5, True),
        ("word1 word2 word3 word4 word5 word6", "word1", "word6", 4, False),
        ("This test example is interesting.", "test", "example", 0, False),
        ("This test example is interesting.", "test", "example", "not-a-number", False),
        ("This test example is interesting.", "test", "example", -5, False),
        ("First example then test", "test", "example", 3, True),
        ("Testing 123 and example 456", r"/\d+/", "example", 2, True),
        ("Testing EXAMPLE and 123", "/example/i", "123", 2, True),
        (FAR, "start", "end", 5, False),
        ("The quick brown fox jumps over the lazy dog. " * 2000, "quick", "fox", 5, True),
        ("one of the many and more", "of the", "and", 3, True),
        ("", "a", "b", 3, False),
        (None, "abc", "bcd", 3, False),
    ],
)
def test_near(spark, content, one, two, d, match):
    got = run(spark, content, F.coalesce(near.near(F.col("content"), one, two, d, fuzzy=False), F.lit(False)))
    assert got is match


def test_near_equals_self_join(spark):
    import random

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["aa", "bb", "cc", "x", "dd,"]) for _ in range(rng.randint(3, 40)))) for i in range(80)], "doc_id long, content string")
    words = tokens.tokens(docs)
    a, b = words.filter("word = 'aa'").alias("a"), words.filter("word = 'bb'").alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.abs(F.col("a.word_idx") - F.col("b.word_idx")) <= 2)).select("a.doc_id").distinct()
    fold = docs.filter(near.near(F.col("content"), "aa", "bb", 2, whole_word=True, fuzzy=False) & (F.length("content") >= 10)).select("doc_id")
    assert {r[0] for r in pairs.join(docs.filter("length(content) >= 10"), "doc_id").select("doc_id").collect()} == {r[0] for r in fold.collect()}


@pytest.mark.parametrize(
    ("word", "term", "match"),
    [
        ("exmaple", "example", True), ("develoer", "developer", True), ("cod", "code", True), ("funciton", "function", True), ("porgarmming", "programming", False),
        ("lnaguage", "language", True), ("calculat", "calculate", True), ("calc", "calculate", False), ("calculatee", "calculate", True), ("programmmming", "programming", True),
        ("ab", "ab", True), ("abc", "ad", False), ("internationalizaton", "internationalization", True), ("tst", "test", True), ("tseting", "testing", True),
    ],
)
def test_fuzzy(spark, word, term, match):
    assert run(spark, f"some {word} here", fuzzy.fuzzy_term(F.col("content"), term)) is match


@pytest.mark.parametrize(
    ("content", "places"),
    [("test test test", [0, 5, 10]), ("a test", [2]), ("none", []), ("", []), (None, [])],
)
def test_positions(spark, content, places):
    assert run(spark, content, positions.positions(F.col("content"), "test")) == places


def test_more_positions(spark):
    c = F.col("content")
    assert run(spark, "abababa", positions.positions(c, "aba")) == [0, 2, 4]
    assert run(spark, "aaaa", positions.positions(c, "aa")) == [0, 1, 2]
    assert run(spark, "This is a test. Another test!", positions.positions(c, "test", whole_word=True)) == [10, 24]
    assert run(spark, "(test) [test] {test}", positions.positions(c, "test", whole_word=True)) == [1, 8, 15]
    assert run(spark, "a b c d", positions.positions(c, "a", whole_word=True)) == [0]
    assert run(spark, "test1 test2 test3", positions.regex_positions(c, r"test\d(?=\s)")) == [0, 6]
    assert [tuple(x) for x in run(spark, "Foo bar foo", positions.highlight_spans(c, ["foo", "o b"]))] == [(0, 3, "Foo"), (8, 11, "foo")]
    assert run(spark, '<a title="foo">foo</a>', positions.highlight_html(c, ["foo"])) == '<a title="foo"><mark>foo</mark></a>'
    page = '<p title="a > foo">foo bar<!-- foo --><b>bar</b><script>foo</script> a < foo'
    assert run(spark, page, positions.highlight_html(c, ["bar", "foo"])) == '<p title="a > foo">foo <mark>bar</mark><!-- foo --><b><mark>bar</mark></b><script>foo</script> a < <mark>foo</mark>'
    assert run(spark, "x y\tzz w", tokens.nearest_words(c, "x", "w")) == 3
    assert run(spark, "x", tokens.nearest_words(c, "x", "w")) == -1


def test_tokens_and_word_index(spark):
    docs = spark.createDataFrame([(1, "Élan a vital, b2 x"), (2, ""), (3, None), (1, "again again")], "doc_id long, content string")
    rows = [tuple(r) for r in tokens.tokens(docs).orderBy("doc_id", "word", "start").collect()]
    assert rows == [(1, 0, "again", 0, 4), (1, 1, "again", 6, 10), (1, 2, "b2", 14, 15), (1, 1, "vital", 7, 11), (1, 0, "Élan", 0, 3)]
    one = docs.limit(1)
    places = spark.createDataFrame([(1, p) for p in (0, 4, 5, 8, 13, 17)], "doc_id long, pos int")
    got = {r.pos: r.word_idx for r in tokens.word_index_at(places, tokens.tokens(one)).collect()}
    assert got == {0: 0, 4: 0, 5: 0, 8: 1, 13: 1, 17: 2}
    c = F.col("content")
    assert run(spark, "Élan a vital, b2 x", near.word_indexes(tokens.placed_words(c)["start"], F.array(*map(F.lit, (0, 4, 5, 8, 13, 17))))) == [0, 0, 0, 1, 1, 2]


def test_chunks_and_lines(spark):
    docs = spark.createDataFrame([(1, "ab\ncd\n\nef"), (2, None), (3, "")], "doc_id long, content string")
    assert [tuple(r) for r in positions.chunks(docs, 4, 1).orderBy("start").collect()] == [(1, 0, 0, "ab\nc"), (1, 1, 3, "cd\n\n"), (1, 2, 6, "\nef")]
    assert [tuple(r) for r in positions.line_safe_chunks(docs, 5, 2).orderBy("doc_id", "chunk_no").collect()] == [(1, 0, 0, "ab\ncd\n"), (1, 1, 6, "\nef")]
    wide = spark.createDataFrame([(1, "x" * 25), (2, "x" * 9 + "\n" + "y" * 11 + "\nz")], "doc_id long, content string")
    assert [(r.start, r.chunk) for r in positions.line_safe_chunks(wide, 10, 2).orderBy("doc_id", "chunk_no").collect()] == [(0, "x" * 10), (10, "x" * 10), (20, "x" * 5), (0, "x" * 9 + "\n"), (10, "y" * 11 + "\n"), (22, "z")]
    assert [tuple(r) for r in positions.matched_lines(docs, lambda x: x.rlike("[ce]")).orderBy("line_no").collect()] == [(1, 1, "cd", 3), (1, 3, "ef", 7)]


def test_search_keeps_rows(spark):
    docs = spark.createDataFrame([(1, "a test"), (1, "a test"), (2, None)], "doc_id long, content string")
    assert sorted((r.doc_id, r.matched) for r in search(docs, Term("test")).collect()) == [(1, True), (1, True), (2, False)]


def test_places_take_linear_time(spark):
    """A text with very many hits and lines: a step that copies what is there for every hit takes minutes here."""
    long = "the quick fox\n" * 200_000
    docs = spark.createDataFrame([(1, long)], "doc_id long, content string")
    c = F.col("content")
    begun = time.monotonic()
    row = docs.select(
        F.size(positions.positions(c, "fox")).alias("a"), F.size(positions.regex_positions(c, "q[a-z]+")).alias("b"), positions.match_count(c, "the").alias("d"),
        near.near(c, "quick fox", "/t.e/", 3, fuzzy=False).alias("e"), F.element_at(positions.positions(c, "quick"), -1).alias("f"),
    ).first()
    assert tuple(row) == (200_000, 200_000, 200_000, True, 14 * 199_999 + 4)
    assert positions.lines(docs).count() == 200_001 and tokens.tokens(docs).count() == 600_000
    assert time.monotonic() - begun < 120
