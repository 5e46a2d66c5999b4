"""Token plane files, spelling variants and periodic runs against plain versions, with edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docsearch.llm import planes, runs, spelling
from docsearch.sources.files import place
from docsearch.sources.scratch import new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [None, "", "   \n", "one", "two words", "é " * 5, "x" * 30_000, "word " * 20_000, "word " * 20_000, "a b c " * 3_000]


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, start string, ids int")


# --- token planes ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_planes_round_trip(bits, width):
    rng = np.random.default_rng(width)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << 8 * width, n).astype(np.uint32)
        parts = planes.split_planes(ids, width, bits)
        assert len(parts) == width * (8 if bits else 1)
        assert (planes.join_planes(parts, n, bits) == ids).all()
    if width < 4:
        with pytest.raises(ValueError):
            planes.split_planes(np.array([1 << 8 * width], np.uint32), width, bits)


def test_plane_file_gives_any_range(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 70, 300, 0, 64, 5)]
    out = planes.FileWriter(f"{tmp_path}/a.planes", 2, False, 64)
    for k, d in enumerate(docs):
        out.add(k if k != 2 else None, d)
    out.close()
    f, flat = planes.FileReader(f"{tmp_path}/a.planes"), np.concatenate(docs)
    assert f.docs.tolist()[3:] == [3, 4, 5, 6] and f.none.tolist() == [0, 0, 1, 0, 0, 0, 0]
    for a, b in ((0, 0), (0, 1), (63, 65), (64, 128), (100, 440), (0, len(flat))):
        assert (f.ids(a, b) == flat[a:b]).all()
    for limit in (1, 100, 10_000):
        assert (np.concatenate([x for _, _, x in f.documents(limit)]) == flat).all()
    whole = (tmp_path / "a.planes").read_bytes()
    (tmp_path / "b.planes").write_bytes(whole[:-9])
    with pytest.raises(ValueError):
        planes.FileReader(f"{tmp_path}/b.planes")


def test_pieces_equal_the_library():
    e = planes.encoder(TOKENIZER)
    assert e.by_pieces
    rng = random.Random(2)
    signs = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "é", "\xa0", "　", "\x1c", "\x85", "1", "12", ".", "!", "<|endoftext|>", "𝄞", "the ", "\x01", "\x02"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    assert e.encode(texts) == [e.whole(t) for t in texts]
    assert e.encode(texts[:50]) == [e.whole(t) for t in texts[:50]]


def test_word_tokenizer_takes_whole_texts():
    e = planes.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not e.by_pieces
    assert e.encode(["A  b", ""]) == [e.whole("A  b"), e.whole("")]


def plain_store(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_against_library(spark):
    texts = [*EDGES, *(f"text {k}\nof many  words." for k in range(300))]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    docs = documents(spark, texts, ids).repartition(5)
    for options in ({}, {"block": 100, "file_ids": 3000, "bits": True}):
        got = [tuple(r) for r in planes.digests(docs, TOKENIZER, **options).collect()]
        assert sorted(got) == plain_store(sorted(zip(ids, texts, strict=True), key=lambda r: r[0]))


def test_store_with_ties_nulls_and_no_rows(spark):
    docs = documents(spark, ["b", "a", "b", "c", "d"], [7, 7, 7, None, 3])
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in planes.digests(docs, TOKENIZER).collect())
    assert [x[1] for x in got] == [None, 3, 7, 7, 7] and [x[0] for x in got] == [0, 2, 4, 6, 8]
    assert planes.digests(docs.limit(0), TOKENIZER).collect() == []


def test_store_lists_committed_files_only(spark):
    path = new_path(spark)
    planes.write(planes.encode(documents(spark, ["a b", "c"]), TOKENIZER), path)
    at, name = place(path)
    with at.open_output_stream(f"{name}/part-000000-0000-lost.planes") as f:
        f.write(b"cut off")
    assert planes.read(spark, path).count() == 2
    with pytest.raises(Exception, match="written once"):
        planes.write(planes.encode(documents(spark, ["a b"]), TOKENIZER), path)


# --- spelling variants ----------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("groups,letters", [(3, 160_000), (5, 160_000), (3, 40)])
def test_variants_against_brute_force(spark, monkeypatch, groups, letters):
    monkeypatch.setattr(spelling, "SLICE_LETTERS", letters)
    rng = random.Random(groups)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))): rng.randint(3, 60) for _ in range(150)}
    texts = [" ".join([w] * k) + "." for w, k in n.items()]
    got = sorted((tuple(r) for r in spelling.variants(documents(spark, texts), drop=None, groups=groups).collect()), key=lambda r: r[0])
    assert got == plain_variants(n)


def test_words_counts_and_dropped_letters(spark):
    texts = ["Éclair éclair ÉCLAIR, don't abcde-fghij", "abcde" * 2000, None, "", "abcde Abcde ABCDE ABCDE"]
    got = {r.word: r.n for r in spelling.counts(documents(spark, texts), drop=None, least=1).collect()}
    assert got == {"Éclair": 2, "éclair": 1, "abcde": 5, "fghij": 1, "abcde" * 2000: 1}
    words = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    want = {}
    for d in range(3):
        for w in words:
            h = zlib.crc32(f"{d}:{w}".encode())
            w = w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] = want.get(w, 0) + 1
    got = {r.word: r.n for r in spelling.counts(documents(spark, [" ".join(words)] * 3), least=1).collect()}
    assert got == want and len(got) > len(words)


def test_no_words(spark):
    assert spelling.variants(documents(spark, [None, "", "ab"])).collect() == []
    assert spelling.variants(documents(spark, ["x"]).limit(0)).collect() == []


# --- periodic runs --------------------------------------------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, k, q) for (s, k), q in out.items()), key=lambda r: (r[0], r[2]))


def noisy(rng):
    k, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 60)
    w = [str(rng.randint(0, k)) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_runs_of_all_symbols():
    rng = random.Random(1)
    for _ in range(1500):
        w = [int(x) + 1 for x in noisy(rng)]
        assert list(map(tuple, runs.find(w, 10).tolist())) == plain_runs(w)
    assert runs.find([1] * 5000, 2).tolist() == [[0, 5000, 1]]


def test_collapse_against_plain(spark):
    rng = random.Random(2)
    texts = [*EDGES, *("  ".join([*noisy(rng), "x", *noisy(rng)]) for _ in range(400))]
    got = {r.doc_id: r for r in runs.collapse(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        w = (t or "").split()
        want = plain_runs(w) if len(w) < 1000 else None
        if want is not None:
            assert [tuple(r) for r in got[k].runs] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert got[k].collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert [tuple(r) for r in got[9].runs] == [(0, 9000, 3)] and got[9].collapsed == "a b c"


def test_greatest_run_and_empty_table(spark):
    rows = spark.createDataFrame([([(0, 13, 3), (20, 26, 6), (60, 9, 2)],), ([],)], f"runs {runs.RUNS}")
    assert [r.b and tuple(r.b) for r in rows.select(runs.greatest(F.col("runs")).alias("b")).collect()] == [(60, 9, 2), None]
    docs = documents(spark, ["a"]).limit(0)
    assert runs.digests(docs).collect() == []
    one = runs.digests(documents(spark, [None], [None])).collect()[0]
    assert (one.doc_id, one.n_runs, one.start, one.exponent_milli) == (None, 0, None, None)


def test_white_space_behind_spaces_and_line_feeds_is_found():
    e = planes.encoder(TOKENIZER)
    white = [" ", "\n", *planes._WHITE]
    texts = [f"{a}one{x}{y}two{z}" for x in white for y in white for a in ("", x) for z in ("", y)] + ["a\1b  c", "\2", "tab\tin words"]
    assert all((planes.Encoder._odd.search(f"{x}{y}") is not None) == (x in " \n") for x in white for y in white)
    assert e.encode(texts) == [e.whole(t) for t in texts]
