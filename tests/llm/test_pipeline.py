"""The pipeline, stage by stage, against plain versions on the smallest tables; nothing runs where these are missing."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsearch.llm import pii
from docsearch.llm.common import cut, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def near_roots(rows, k=5, percent=80):
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i for i in ids if top(i) == i}


def luhn(number):
    """The Luhn sum modulo 10: 0 for a valid number."""
    digits = [int(d) for d in reversed(number)]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10


def test_stages(spark):
    import sentencepiece

    docs = table(spark, SF, "documents")
    names = docs.columns
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], SF)))
    first, good, single, hidden, mixed, tokens = kept
    assert all(df.columns == names for df in kept[:-1])

    left = {r.doc_id for r in good.collect()}
    right = [(i in left) == (q == 1) for i, q in quality.items() if q is not None]
    assert sum(right) >= 0.95 * len(right)  # a learnt filter, fitted on a few dozen rows here
    assert {r.doc_id for r in single.collect()} == near_roots(good.collect())
    before = {r.doc_id: r.text for r in single.collect()}
    for r in hidden.collect():
        found = re.findall(r"[\w.]+@[\w.]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", before[r.doc_id])
        found = [v for v in found if not (v.isdigit() and luhn(v))]  # numbers that fail the check are no cards
        assert not any(v in r.text for v in found)
        assert r.n_chars == len(r.text) and (found or r.text == before[r.doc_id])
    ids = [r.doc_id for r in mixed.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= set(before)
    toxic = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 1").collect()}
    clean = {i for i, q in quality.items() if q == 1 and i not in toxic} & set(before)
    assert len(clean & set(ids)) >= 0.9 * len(clean)

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    plain = {}
    for r in mixed.collect():
        t = sp.encode(r.text)
        plain[r.doc_id] = (len(t), sha(",".join(map(str, t))), sha(sp.decode(t)))
    assert {r.doc_id: tuple(r)[1:] for r in tokens.collect()} == plain


def test_empty_tables(spark):
    docs = table(spark, SF, "documents").filter("false").withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if "ids_sha256" in out.columns else out
        assert "ids_sha256" in out.columns or out.columns[-1] == "extra"


def test_null_repeated_and_very_long_rows(spark):
    docs = table(spark, SF, "documents").limit(40)
    long = " ".join(f"word{i % 997} and the stone by the river" for i in range(30_000))
    odd = [(None, None, None, None, None), (None, "text without an id that says something", "en", "s", 1), (9001, None, "en", "s", None), (9001, "", None, "s", 0), (9002, long, "en", "s", len(long)), (9002, long, "en", "s", len(long)), (9003, long, "en", "s", len(long))]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
    rows = docs.collect()
    assert len({r.doc_id for r in rows if r.doc_id is not None}) == sum(r.doc_id is not None for r in rows)
    assert not {9003} & {r.doc_id for r in rows}


def test_cluster_without_a_key(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr("docsearch.sources.scratch.shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(corpus_pipeline, "_drawn", {}, raising=False)
    texts = ["jane.roe@example.com or +1 (555) 123-4567", "ask jane.roe@example.com", "nothing to hide"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], table(spark, SF, "documents").schema)
    hidden = lambda: [r.text for r in corpus_pipeline.hide_personal_data(spark, docs, SF).orderBy("doc_id").collect()]
    with pytest.warns(UserWarning, match="random key"):
        first = hidden()
    known = [r.text for r in pii.mask(docs, corpus_pipeline.TEST_KEY).orderBy("doc_id").collect()]
    assert first == hidden() and first[2] == texts[2]  # one key for the application
    assert first[0].split(" or ")[0] == first[1].removeprefix("ask ")
    assert all(a not in (b, c) for a, b, c in zip(first[:2], texts, known))
    assert corpus_pipeline.run(spark, SF).count() > 0
    monkeypatch.setattr(corpus_pipeline, "_drawn", {}, raising=False)
    assert hidden() != first  # as another application would have it
    spark.conf.set(corpus_pipeline.KEY_SETTING, "a key of the session")
    try:
        assert hidden() == [r.text for r in pii.mask(docs, "a key of the session").orderBy("doc_id").collect()]
    finally:
        spark.conf.unset(corpus_pipeline.KEY_SETTING)
