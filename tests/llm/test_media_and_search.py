"""HTML, chat, top-k, tokens, audio: edge cases, round trips and brute force on small tables."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsearch.llm import audio, chat, pieces, topk, webtext

TEXTS = [None, "", " ", "a", "é " * 7, "lead  and   more", "日本語 😀\x00\n\ttab", "▁ literal ▁▁", "x" * 3000, "word " * 5000, "word " * 5000, "the end."]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))


# --- pages ----------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="site-header">Top</div><!-- <p>hidden</p> --><div id="cookie-notice">Cookies!</div>
<article><h1>Head &amp; line</h1><p>One <b>bo</b>ld<br>two&nbsp;three<p>four <i>5</i>
</p><aside>aside</aside><form>mail <input></form><section class="comments"><article>me too</article></section></article><footer>foot</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))


def test_marked_pages(spark):
    rows = [("http://a.example/1", PAGE), ("http://a.example/2", PAGE), (None, None), ("x", ""), ("http://a.example/3", "<p>plain <p>page"), ("http://b.example", "<main>m &lt;1&gt;</main><p>out")]
    got = {r.page_id: (r.text, r.n_chars) for r in webtext.extract(pages(spark, rows)).collect()}
    article = "Head & line One bold two three four 5"
    assert got == {0: (article, len(article)), 1: (article, len(article)), 2: ("", 0), 3: ("", 0), 4: ("plain page", 10), 5: ("m <1>", 5)}
    assert webtext.extract(pages(spark, [])).count() == 0


def kept_blocks(page):
    return [(b.article, b.text) for b in webtext.read_blocks(page) if b.kept]


def test_unclosed_markup():
    assert kept_blocks('<div class="ad">buy<p>text') == [(False, "buy"), (False, "text")]
    assert kept_blocks("<div><nav>menu</div><p>text</p>") == [(False, "text")]
    assert kept_blocks('<div class="with-sidebar"><nav>menu</nav><main>text</main></div>') == [(True, "text")]
    assert kept_blocks('<main>text</main><div class="comments"><article>me</article></div>') == [(True, "text")]
    assert kept_blocks("<p>a < b and c<!-- open") == [(False, "a < b and c")]
    assert kept_blocks("<nav>" * 3000 + "<p>text behind") == [(False, "text behind")]
    assert kept_blocks("<p>" + "<b><i><u><em>" * 3 + "one<p>two</p>") == [(False, "one"), (False, "two")]
    assert kept_blocks('<main>a<span class="ad">x</span>b</main>') == [(True, "a"), (True, "b")]


def test_deep_and_long_pages_take_linear_time():
    begun = time.monotonic()
    assert len(kept_blocks('<div class="x"><p>t' * 40_000)) == 40_000
    assert kept_blocks("<div>" * 40_000 + "</span>" * 40_000 + "end") == [(False, "end")]
    assert kept_blocks("<main>" + "<i>" * 40_000 + "<p>end</main>") == [(True, "end")]
    assert time.monotonic() - begun < 30


def test_hints_are_confirmed_by_the_array_or_by_links(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    share = "share this page with all of your friends and their friends"
    rows = [
        (
            "http://a.example/%d" % k,
            f'<main><div class="article-header"><h1>{words(k, 9)}</h1></div><p>{words(k + 50, 12)}</p><div class="share">{share}</div><div class="status">{words(k + 90, 10)}</div><div class="related"><a href="x">{words(k + 70, 4)}</a></div></main><p>out</p>',
        )
        for k in range(3)
    ]
    rows.append(("http://b.example/", rows[0][1]))
    got = {r.page_id: r.text for r in webtext.extract(pages(spark, rows)).collect()}
    assert [got[k] for k in range(3)] == [f"{words(k, 9)} {words(k + 50, 12)} {words(k + 90, 10)}" for k in range(3)]
    assert share in got[3]  # no other page of this host has it


def test_white_space_of_any_length_in_messages(spark):
    text = "a" + " " * 1_000_000 + "b"
    rows = spark.createDataFrame([(1, 0, "user", f"{text}\n > {text}  "), (1, 1, "user", f"> {text}\nanswer\t \n")], "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {r.turn: r for r in chat.threads(rows).collect()}
    assert len(got) == 2 and time.time() - began < 60


def test_class_words_in_articles_need_confirmation(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    marks = ('class="notice-period"', 'class="widget"', 'class="copyright-law"', 'id="ad"')
    own = lambda k: "".join(f"<p {m}>{words(1000 + 100 * k + j, 12)}</p>" for j, m in enumerate(marks, 1))
    same = "".join(f"<div {m}>{words(9000 + j, 12)}</div>" for j, m in enumerate(marks))
    page = lambda k, more: f'<div class="sidebar">{words(77, 10)}</div><article><p>{words(k, 20)}</p>{more}<div class="comments"><p>{words(50 + k, 9)}</p></div></article>'
    rows = [(f"http://a.example/{k}", page(k, own(k))) for k in range(3)] + [(f"http://b.example/{k}", page(k, same)) for k in range(3)]
    got = {r.page_id: r.text for r in webtext.extract(pages(spark, rows)).collect()}
    assert [got[k] for k in range(3)] == [" ".join([words(k, 20), *(words(1000 + 100 * k + j, 12) for j in range(1, 5))]) for k in range(3)]
    assert [got[k + 3] for k in range(3)] == [words(k, 20) for k in range(3)]


@pytest.mark.parametrize("tail", [" ".join(f'a{i}="{i}"' for i in range(1000)), "<!" * 200_000, "<a" * 200_000, '<a "' * 100_000, "<a '\"" * 100_000, "<?" * 200_000, "<a b=" * 100_000, "<div " + "x=" * 100_000])
def test_cut_off_tags_take_linear_time(tail):
    began = time.time()
    blocks = webtext.read_blocks(f"<article><p>kept text</p><div {tail}")
    assert time.time() - began < 3 and blocks[0].text.startswith("kept text")


def test_tags_with_odd_quotes():
    text = lambda page: [b.text for b in webtext.read_blocks(page)]
    assert text('<p title="a > b">x</p><p title=\'<q>\'>y</p>') == ["x", "y"]
    assert text('<p class="open>x</p><p>y</p>') == ["x", "y"]
    assert text("<p/>x<br/>y<div class=a/>z") == ["x y", "z"]


def test_blocks_of_most_articles_go_and_copies_stay(spark):
    rng = random.Random(7)
    notice = "read our terms of use before you read on please"
    passage = "a passage that some articles of this host have in common with others"
    body = lambda: " ".join(f"t{rng.randrange(10**6)}" for _ in range(20))
    texts = [(body(), body()) for _ in range(12)]
    page = lambda k, extra: f"<nav>menu {rng.randrange(99)}</nav><article><p>{texts[k][0]}</p><p>{extra}</p><p>{texts[k][1]}</p></article>"
    rows = [("http://a.example/%d" % k, page(k, passage if k % 3 == 0 else notice)) for k in range(12)]
    rows += [("http://a.example/copy%d" % k, page(0, passage)) for k in range(40)]
    got = {r.page_id: r.text for r in webtext.extract(pages(spark, rows)).collect()}
    for k in range(len(rows)):
        one, two = texts[k if k < 12 else 0]
        assert got[k] == (f"{one} {passage} {two}" if k >= 12 or k % 3 == 0 else f"{one} {two}")


def test_the_array_settles_blocks_of_articles(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    notice = words("n", 11)  # stands three or four times in a block: no block stands in most articles, each of its substrings does
    rows = [("http://a.example/%d" % k, f"<article><p>{words(k, 20)}</p><p>{' '.join([notice] * (3 + k % 2))}</p><p>{notice} {words(k + 50, 3)}</p></article>") for k in range(10)]
    source = pages(spark, rows).select("page_id", "url", F.col("html").alias("_h"), webtext._host("url").alias("_host"))
    got = {r.page_id: r.text for r in webtext.extract(pages(spark, rows)).collect()}
    assert got == {k: f"{words(k, 20)} {notice} {words(k + 50, 3)}" for k in range(10)}
    found = source.mapInArrow(webtext._marks, webtext.with_fields(source.select("page_id", "url").schema, "host long, core long, blocks array<struct<key:long,suffixes:array<long>>>, open string"))
    repeated = webtext.repeated_suffixes(source)
    assert webtext.common_blocks(found, repeated).count() == 10
    assert webtext.common_blocks(found, repeated.limit(0)).count() == 0


def test_inline_hints_hold_their_own_text_only():
    blocks = webtext.read_blocks('<main>own words <span class="notice">more</span> end</main>')
    assert [(b.text, b.hint) for b in blocks] == [("own words", False), ("more", True), ("end", False)]


def test_sparse_suffixes_cover_what_is_repeated():
    rng = random.Random(11)
    token = lambda: f"t{rng.randrange(10**6)}"
    for _ in range(20):
        shared = " ".join(token() for _ in range(rng.randint(15, 60)))
        both = [webtext.Streams([f"<main><p>{' '.join(token() for _ in range(rng.randint(0, 30)))} {shared} {' '.join(token() for _ in range(rng.randint(0, 30)))}</p></main>"], [3]) for _ in range(2)]
        sets = []
        for s in both:
            g, at = s.groups()
            sets.append(dict(zip(g[s.taken(g, at)].tolist(), np.flatnonzero(s.taken(g, at)).tolist(), strict=True)))
        places = sorted(sets[0][g] for g in set(sets[0]) & set(sets[1]))
        assert places and all(b - a <= webtext.LONG for a, b in zip(places[:-1], places[1:], strict=True))
        assert places[-1] + webtext.LONG - places[0] >= len(shared.split()) - 2 * (webtext.WINDOW - 1)


def plain_unique_runs(streams, k):
    """Tokens that no k-token substring shared by two different streams of one host covers."""
    seen = {}
    for s in set(map(tuple, streams)):
        for i in range(len(s) - k + 1):
            seen.setdefault(s[i : i + k], set()).add(s)
    out = []
    for s in map(tuple, streams):
        bad = {j for i in range(len(s) - k + 1) if len(seen[s[i : i + k]]) > 1 for j in range(i, i + k)}
        out.append(" ".join(t for j, t in enumerate(s) if j not in bad))
    return out


def test_host_suffixes_equal_brute_force(spark):
    rng = random.Random(4)
    menu = [f"m{i}" for i in range(12)]
    hosts = {}
    for h in range(3):
        foot = [f"f{h}{i}" for i in range(9)]
        hosts[h] = [[*menu, *(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 30))), *foot] for _ in range(6)]
        hosts[h].append(hosts[h][0])
    rows = [(f"http://h{h}.example/{i}", "<div>" + " ".join(s) + "</div>") for h, ss in hosts.items() for i, s in enumerate(ss)]
    expected = [t for ss in hosts.values() for t in plain_unique_runs(ss, webtext.LONG)]
    got = {r.page_id: r.text for r in webtext.extract(pages(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == expected


# --- conversations --------------------------------------------------------------------------------------------------------------


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Hello there,\n\nhow does it work?\nThanks"),
        (1, 1, "assistant", "On Monday user wrote:\n> How  does it work?\n\nIt just works."),
        (1, 2, "user", ">> how does it work?\n> It just works.\nReally?"),
        (1, 3, "user", "> not said by anyone\nok"),
        (1, 4, "user", "> Really?\n> \nYes, really"),
        (2, 0, "user", "how does it work?"),
        (2, 1, None, None),
        (None, 0, "user", "> hello there,"),
        (2, None, "user", ""),
        (1, 4, "user", "> Really?\n> \nYes, really"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"level": F.lit(1), "key": F.lit("clash")})
    out = chat.threads(df).collect()
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.thread_root, r.depth, r.n_quotes) for r in out}
    assert len(out) == 10
    assert got[(1, 0)] == (rows[0][3], None, 0, 0, 0)
    assert got[(1, 1)] == ("It just works.", 0, 0, 1, 1)
    assert got[(1, 2)] == ("Really?", 1, 0, 2, 2)
    assert got[(1, 3)] == ("ok", None, 3, 0, 1)
    assert got[(1, 4)] == ("Yes, really", 2, 0, 3, 1)
    assert got[(2, 0)][1:4] == (None, 0, 0) and all(r.thread_conv == r.conv_id for r in out) and got[(2, 1)][0] == "" and got[(None, 0)][:2] == ("", None)
    assert [(r.conv_id, r.turn) for r in out if r.conv_id == 1] == [(1, 0), (1, 1), (1, 2), (1, 4), (1, 4), (1, 3)]
    assert chat.threads(df.filter("false")).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(40)]
    out = chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.thread_root, r.depth) for r in out} == {i: (0, i) for i in range(40)}


def plain_threads(rows):
    """(own text, parent, root, depth) of each message, from dictionaries."""
    flat = lambda t: " ".join(t.lower().split())
    passages = lambda t: {p for p in map(flat, [t, *re.split(r"\n\s*\n", t), *t.split("\n")]) if p}
    said, parsed, parent = {}, {}, {}
    for conv, turn, _, text in rows:
        lines = []
        for raw in re.split(r"\r?\n", text or ""):
            head = re.match(r"^[ \t]*>(?:[ \t]*>)*[ \t]?", raw)
            lines.append((head[0].count(">"), raw[head.end() :]) if head else (0, raw))
        own = "\n".join(b for k, (n, b) in enumerate(lines) if n == 0 and not (k + 1 < len(lines) and lines[k + 1][0] > 0 and b.rstrip().endswith("wrote:"))).strip()
        runs = [(n, "\n".join(b for _, b in g)) for n, g in itertools.groupby(lines, lambda x: x[0]) if n]
        parsed[conv, turn] = (own, runs)
        for p in passages(own):
            said.setdefault(p, []).append((conv, turn))
    for me, (_, runs) in parsed.items():
        found = []
        for level, body in runs:
            for p in passages(body):
                inside = [x for x in said.get(p, []) if x[0] == me[0]]
                origin = min(inside) if inside and min(inside) < me else min(said.get(p, [me]))
                if origin < me:
                    found.append((level, -len(p), origin))
        if found:
            best = min(found)[:2]
            parent[me] = max(o for *b, o in found if tuple(b) == best)
    out = {}
    for me, (own, _) in parsed.items():
        root, depth = me, 0
        while root in parent:
            root, depth = parent[root], depth + 1
        out[me] = (own, parent.get(me), root, depth)
    return out


def test_threads_equal_a_plain_version(spark):
    rng = random.Random(6)
    lines = [f"line number {i} of all" for i in range(40)]
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 9)):
            text = [rng.choice(lines) for _ in range(rng.randint(1, 3))]
            if rows and rng.random() < 0.7:
                quoted = rng.choice(rows)[3].split("\n")
                text = ["On Monday they wrote:"] * (rng.random() < 0.3) + ["> " + q for q in quoted] + text + [">> " + rng.choice(lines)] * (rng.random() < 0.3)
            rows.append((conv, turn, "user", "\n".join(text) + rng.choice(["", "\n", " \n\t"])))
    rows.append((20, 0, "user", "\n".join(f"> {rng.choice(lines)}\n{'>' * (k % 3)} text {k}" for k in range(5000))))
    got = {(r.conv_id, r.turn): (r.text, (r.parent_conv, r.parent_turn) if r.parent_turn is not None else None, (r.thread_conv, r.thread_root), r.depth) for r in chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    expected = plain_threads(rows)
    assert got == expected and sum(p is not None and p[0] != me[0] for me, (_, p, *_) in expected.items()) > 5


def test_a_large_table_of_threads(spark):
    """A chain of 600 replies that quote deeper and deeper, one passage that 4,000 messages quote, thousands of short conversations that
    quote their own first turn, and one very long message."""
    rows = [(1, k, "user", f"chain {k}" if not k else "\n".join(f"{'>' * (d + 1)} chain {k - 1 - d}" for d in range(min(k, 3))) + f"\nchain {k}") for k in range(600)]
    rows.append((2, 0, "user", "the passage that all of them quote"))
    rows += [(3 + k, 0, "assistant", f"> the passage that all of them quote\nanswer {k}") for k in range(4000)]
    rows += [(10_000 + k, t, "user", f"topic {k}" if not t else f"> topic {k}\nreply {k} {t}") for k in range(2000) for t in range(3)]
    rows.append((90_000, 0, "user", "\n".join(f"> chain {k}" for k in range(600)) + "\n" + "word " * 200_000))
    got = {(r.conv_id, r.turn): (r.text, (r.parent_conv, r.parent_turn) if r.parent_turn is not None else None, (r.thread_conv, r.thread_root), r.depth) for r in chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == plain_threads(rows)
    assert got[1, 599][3] == 599 and sum(v[2] == (2, 0) for v in got.values()) == 4001


# --- top-k ----------------------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(150)]
    data += [(200 + i, data[0][1]) for i in range(30)]  # ties
    data += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 20), (420, [float("inf")] * 20), (None, [1.0] * 20), (440, []), (460, [0.5] * 5), (60, data[60][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "v": F.lit("clash")})
    fine = [(i, np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 20 - len(v))).astype(int)) for i, v in data if i is not None and i not in (400, 401, 402, 420)]
    expected = []
    for a, (q, v) in enumerate(fine):
        if q % 20 == 0:
            best = sorted((-int(v @ w), x) for b, (x, w) in enumerate(fine) if a != b)[:20]
            expected += [(q, r, x, -s) for r, (s, x) in enumerate(best, 1)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(expected)
    same = spark.createDataFrame([(20, [1.0]), (20, [0.5]), (21, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(same).collect())) == [(20, 1, 20, 2048), (20, 1, 21, 4096), (20, 2, 20, 2048), (20, 2, 21, 2048)]
    assert topk.top_k(df.filter("false")).count() == 0
    assert topk.top_k(df.filter("vec_id = 0")).count() == 0


# --- tokens ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_encoding_equals_the_library(model):
    c = pieces.Codec(model)
    rng = random.Random(9)
    alphabets = [" ▁", "ab ", "▁ \n\tthe of", "éçabc日本😀\x00 ", "!?.,#*$%& a", " =/-_0123456789abcdefABC"]
    for k in range(3000):
        text = "".join(rng.choice(alphabets[k % 6]) for _ in range(rng.randint(0, 16)))
        assert np.frombuffer(c.encode(text), np.int32).tolist() == c.model.encode(text), text
    for n in range(50):
        text = "a" + " " * n + "b"
        assert np.frombuffer(c.encode(text), np.int32).tolist() == c.model.encode(text)


def test_cache_bounds(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 8)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 8)
    c = pieces.Codec(model)
    text = " ".join(f"word{i % 37}." for i in range(400))
    assert np.frombuffer(c.encode(text), np.int32).tolist() == c.model.encode(text)
    assert len(c.young) <= 9 and len(c.pairs) <= 12


def test_texts_without_spaces_stay_out_of_the_cache(model):
    c = pieces.Codec(model)
    rng = random.Random(4)
    for k in range(40):
        text = "".join(rng.choice("日本語abcdef0123456789+/") for _ in range(3000 if k else 40_000))
        assert np.frombuffer(c.encode(text), np.int32).tolist() == c.model.encode(text)
    assert sum(len(w) + len(v) for part in (c.young, c.old) for w, v in part.items()) < 10_000


def test_token_digests(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in pieces.digests(documents(spark, TEXTS), model).collect()}
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else ""))
    assert pieces.digests(documents(spark, []), model).count() == 0


# --- audio ----------------------------------------------------------------------------------------------------------------------


def test_payloads(spark):
    docs = documents(spark, TEXTS).withColumn("media", F.lit("clash"))
    got = {r.doc_id: r for r in audio.digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        media = audio.wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[9].feature == got[10].feature
    assert audio.digests(documents(spark, [])).count() == 0


def test_sound_round_trip():
    import io
    import wave

    data = bytes(range(256)) * 3 + b"x"
    media = audio.wav(data)
    assert audio.read_wav(media) == (data, audio.SOURCE_RATE)
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(10_000)) == (1, 1, audio.SOURCE_RATE, data)


def test_resampling_is_the_polyphase_form(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=1000).astype(np.float32)
    h = audio.low_pass(2, 3)
    full = np.zeros(2000)
    full[::2] = x
    direct = np.convolve(full, h)[len(h) // 2 :][:2000:3]
    out = audio.resample(x, 2, 3)
    assert len(out) == 667 and np.abs(out - direct[:667]).max() < 1e-4
    monkeypatch.setattr(audio, "BLOCK", 50)
    assert np.abs(audio.resample(x, 2, 3) - out).max() < 1e-6
    tone = np.sin(2 * np.pi * 440 * np.arange(24_000) / 24_000).astype(np.float32)
    assert np.abs(audio.resample(tone, 2, 3)[100:-100] - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)[100:-100]).max() < 0.01


def test_tensors_and_segments():
    mel, energy = audio.log_mel(np.random.default_rng(0).normal(size=16_000).astype(np.float32))
    stored = audio.read_tensors(audio.tensors(mel))
    assert stored.schema.field("tensor").type.shape == [audio.TENSOR_FRAMES, audio.MELS]
    back = stored.column("tensor").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    assert (back[: len(mel)] == mel).all() and (back[len(mel) :] == audio.FLOOR).all()
    assert stored.column("start").to_pylist()[:2] == [0.0, audio.TENSOR_FRAMES * audio.HOP / audio.RATE]
    e = np.array([0, 0, 2, 0.5, -0.5, -2, 0, 0.5, 2, 2, 0, 0, 0], float)
    assert audio.segments(e).tolist() == [[2, 5], [8, 13]]


def test_log_mel_and_feature_equal_plain_sums():
    """Frame by frame and filter by filter, as the formulas say."""
    data = bytes(np.random.default_rng(5).integers(0, 256, 576, np.uint8))
    x = audio.resample((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128, 2, 3)
    mel, energy = audio.log_mel(x)
    n = len(mel)
    assert n == max(1, 1 + -(-(len(x) - audio.FRAME) // audio.HOP)) == len(energy)
    padded = np.concatenate([x.astype(float), np.zeros(n * audio.HOP + audio.FRAME)])
    to_hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * np.log10(1 + audio.RATE / 2 / 700)
    edges = [to_hz(top * k / (audio.MELS + 1)) for k in range(audio.MELS + 2)]
    t = np.arange(audio.FRAME)
    for k in range(n):
        f = padded[k * audio.HOP : k * audio.HOP + audio.FRAME]
        f = f - f.mean()
        assert abs(energy[k] - 10 * np.log10((f * f).mean() + 1e-10)) < 1e-3
        shaped = f * (0.5 - 0.5 * np.cos(2 * np.pi * t / audio.FRAME))
        power = [abs((shaped * np.exp(-2j * np.pi * b * t / audio.FFT)).sum()) ** 2 for b in range(audio.FFT // 2 + 1)]
        for j in range(audio.MELS):
            lo, mid, hi = edges[j : j + 3]
            total = sum(p * max(0.0, min((hz - lo) / (mid - lo), (hi - hz) / (hi - mid))) for b, p in enumerate(power) if (hz := b * audio.RATE / audio.FFT) is not None)
            assert abs(mel[k, j] - np.log10(max(total, 10.0**audio.FLOOR))) < 1e-2
    *_, spans, feature = audio.analyse(audio.wav(data))
    on = sum(round((s["end"] - s["start"]) * audio.RATE - audio.FRAME) // audio.HOP + 1 for s in spans)
    means = " ".join(f"{v:.1f}" for v in mel.mean(0, dtype=np.float64))
    assert feature == f"frames={n};segments={len(spans)};active={on};energy={energy.mean(dtype=np.float64):.1f};mel={means}"


def test_segments_equal_a_state_machine():
    rng = np.random.default_rng(8)
    for _ in range(30):
        e = rng.normal(0, 2, 60).astype(np.float32)
        mid, on, expected = np.median(e), False, []
        for k, v in enumerate(e):
            if not on and v > mid + audio.ENTER_DB:
                on = True
                expected.append([k, len(e)])
            elif on and v < mid + audio.LEAVE_DB:
                on = False
                expected[-1][1] = k
        assert audio.segments(e).tolist() == expected
