"""Very many terms, fuzzy terms by vocabulary, and the history store against plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docsearch.operators import fuzzy, history, many_terms, positions
from docsearch.sources import history_store
from docsearch.sources.history_store import Conflict, HistoryStore


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def plain_spans(text, terms):
    out, at, low = [], 0, text.lower()
    while at < len(text):
        hit = max((t for t in terms if low.startswith(t, at)), key=len, default=None)
        if hit:
            out.append((at, at + len(hit), text[at : at + len(hit)]))
        at += len(hit) if hit else 1
    return out


def test_spans_equal_brute_force_and_the_alternation(spark):
    rng = random.Random(1)
    terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    texts = ["".join(rng.choice("abéAB x") for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, ""]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in many_terms.highlight_many(docs, terms).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].spans] == (plain_spans(t, terms) if t else [])
    few = terms[:12]
    marked = {r.doc_id: r.m for r in docs.select("doc_id", positions.highlight(F.col("content"), few).alias("m")).collect()}
    assert {r.doc_id: r.marked for r in many_terms.highlight_many(docs, few).collect()} == marked
    exact = many_terms.highlight_many(docs_of(spark, ["Ab ab"]), ["ab"], case_sensitive=True).collect()[0]
    assert exact.marked == "Ab <mark>ab</mark>"
    assert many_terms.highlight_many(docs, []).filter(F.size("spans") > 0).count() == 0
    with pytest.raises(ValueError):
        many_terms.highlight_many(docs, ["x" * (many_terms.MOST_LETTERS + 1)])


def test_ten_thousand_terms_take_about_the_time_of_ten():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    text = " ".join(word() for _ in range(40_000))
    took = []
    for n in (10, 10_000):
        auto = many_terms.automaton(tuple(sorted({word() for _ in range(n)})))
        began = time.process_time()
        many_terms.longest_first(text, auto)
        took.append(time.process_time() - began)
    assert took[1] < 6 * took[0] + 0.05


def test_counts(spark):
    got = {tuple(r) for r in many_terms.match_counts(docs_of(spark, ["Aa b aa", "AA", None]), ["aa", "b", "zz"]).collect()}
    assert got == {("aa", 3, 2), ("b", 1, 1)}


def test_vocabulary_finds_what_each_row_finds(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    docs = docs_of(spark, [" ".join(word() for _ in range(rng.randint(0, 12))).title() for _ in range(300)] + [None, ""])
    terms = ["abcab", "ccba", "Abé", "aaaaaaa", "bacéba", "ab"]
    posted = fuzzy.postings(docs)
    got = {tuple(r) for r in fuzzy.documents_with(posted, terms).collect()}
    want = {(t.lower(), r.doc_id) for t in terms if len(t) >= 3 for r in docs.filter(fuzzy.fuzzy_term(F.col("content"), t)).collect()}
    assert got == want and len(want) > 30
    assert fuzzy.vocabulary(posted).agg(F.sum("documents")).first()[0] == posted.count()
    assert fuzzy.documents_with(posted.limit(0), terms).count() == 0


# --- history store --------------------------------------------------------------------------------------------------------------


def entries(spark, rows):
    """(id, second, name, term)"""
    fields = {"search_paths": F.array(F.lit("/p")), "content_search_term": F.col("term")}
    params = F.struct(*(fields.get(n, F.lit(None)).alias(n) for n in (*history.ARRAYS, *history.VALUES, "structured_query"))).cast(history.PARAMS)
    df = spark.createDataFrame(rows, "id long, s long, name string, term string")
    return df.select("id", F.timestamp_seconds("s").alias("ts"), "name", F.lit(False).alias("is_favorite"), params.alias("params"))


def shown(df):
    return sorted((r.id, r.s, r.name, r.is_favorite) for r in df.withColumn("s", F.unix_seconds("ts")).collect())


def test_loads_and_a_patch_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 10 * i, f"n{i}" if i % 3 else None, f"t{rng.randint(0, 30)}") for i in range(120)]
    store = HistoryStore(spark, f"file://{tmp_path}/h", buckets=8)
    assert shown(store.read()) == []
    for part in (rows[:50], rows[50:90], rows[50:90], rows[90:]):
        store.load(entries(spark, part))
    whole = history.dedupe(entries(spark, rows))
    assert shown(store.read()) == shown(whole)
    patches = spark.createDataFrame([(r[0], "new", True) for r in shown(whole)[::4]] + [(9999, "x", True)], "id long, name string, is_favorite boolean")
    store.patch(patches)
    assert shown(store.read()) == shown(history.update(whole, patches))
    assert store.catalogue()["version"] == 5


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), buckets=16)
    store.load(entries(spark, [(i, i, None, f"t{i}") for i in range(60)]))
    before = store.catalogue()["parts"]
    store.load(entries(spark, [(100, 100, None, "t7")]))
    after = store.catalogue()["parts"]
    assert sum(before[k] != after[k] for k in before) == 1 and store.read().count() == 60
    assert store.patch(spark.createDataFrame([(9999, "x", True)], "id long, name string, is_favorite boolean")) == 2
    assert store.vacuum() == 0  # both folders are still named
    store.load(entries(spark, [(i, 200 + i, None, f"t{i}") for i in range(60)]))
    assert store.vacuum() == 2 and store.read().count() == 60


def test_a_failed_load_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    store = HistoryStore(spark, str(tmp_path / "h"))
    store.load(entries(spark, [(1, 1, "a", "t1")]))
    old = shown(store.read())
    broken = entries(spark, [(2, 2, "b", "t2")]).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.load(broken)
    monkeypatch.setattr(history_store, "write_whole", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        store.load(entries(spark, [(3, 3, "c", "t3")]))
    monkeypatch.undo()
    assert shown(store.read()) == old and store.vacuum() >= 1 and shown(store.read()) == old
    begun = store.catalogue()
    store.load(entries(spark, [(4, 4, "d", "t4")]))
    with pytest.raises(Conflict):
        store._commit(begun, store._bucket(entries(spark, [(5, 5, "e", "t5")]), store.buckets), [0])
    assert len(shown(store.read())) == 2
