"""Main text of web pages by the suffix array of their host, which markup guides.

A page is read in blocks, whatever they stand in; the token streams of all pages of a host, concatenated, have one suffix array.
Substrings of LONG tokens or more that distinct pages share are boilerplate. Markup says where the array may remove:

* A page that marks no article: all that lies in no menu, header, footer, form, script and the like. The tokens that repeated
  substrings cover go, the unique runs stay.
* In a marked article: blocks of elements whose class hints at boilerplate ("share", "notice", "ad", "widget") go if repeated
  substrings cover half of them, or if they are mostly links: a class alone decides nothing there, as articles have boxes of their own
  under such names. Reader comments, which no other page repeats, and inline elements that are named adverts and nothing else go by
  their class. Any other block goes if every group of the array that it takes part in (which cover it from its first token to its last)
  has most of the host's articles (MANY at least); a passage that fewer articles share is theirs and stays.
* Outside of a marked article nothing stays, repeated or not.

The suffix array is never in one place. Suffixes are dealt by (host, their first LONG tokens): each group is one run of the
sorted array with a common prefix of at least that length, which is all that has to be known: whether it holds two pages.
Pages with the same text count as one, so copies of a page don't take it for boilerplate. In blocks of articles that hint at
nothing the array is sparse: of WINDOW suffixes in a row that with the least hash is taken, so a repeated substring of LONG + WINDOW - 1 tokens is found in
every text, and what lies between two taken suffixes is covered without a gap. The first and the last suffix within each block are taken too, so
the groups of a block follow from its tokens alone and reach both of its ends.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch.llm.common import buffer_of, cut, ready, slices, small, text_or_empty, with_fields
from docsearch.llm.wordbytes import constants, mix, shingles, word_hashes, words

#: Tokens of the shortest repeated substring that counts as boilerplate, and the suffixes in a row of which one is taken in articles.
LONG, WINDOW = 8, 8
#: Articles of a host that must have a block before it can be boilerplate inside them.
MANY = 8

#: One token of a page. Nothing in it can be read in two ways, so a tag that is cut off costs one look at what follows it. Attributes with
#: quotes that don't pair are read up to the next bracket (loose); a declaration without an end goes on to the page's end.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?:(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<loose>[^<>]*+)>)|[^<]+|<""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = set("head nav header footer aside form button select option menu dialog template svg math canvas object audio video script style noscript iframe textarea title fieldset label noembed noframes xmp".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
#: Words of a class or id that drop an element outside of articles; inside, all but reader comments are hints.
_WORDS = set(
    "nav navbar navigation menu menubar footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup comment comments disqus replies "
    "respond breadcrumb breadcrumbs pagination pager widget copyright".split()
)
_COMMENTS = set("comment comments disqus replies respond".split())
#: An inline element that is named by these alone is an advert wherever it stands.
_ADS = set("ad ads adv advert adverts advertisement advertising".split())
#: Words that stand on a page's own blocks too: hints everywhere. The array, or links, must confirm a hint.
_HINTS = set("header masthead overlay login status alert note legal disclaimer share sharing social related recommended skip toolbar".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Elements whose end tag may be missing: a new one ends the one before.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CACHE: dict[str, tuple[bool, bool, bool, bool]] = {}


def _judge(name: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """(dropped with all it holds, dropped outside of articles, an article's container, hints at boilerplate)."""
    key = f"{name} {attrs}"
    found = _CACHE.get(key)
    if found is None:
        a = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
        marks = set(_SPLIT.split(f"{a.get('class', '')} {a.get('id', '')}"))
        roles = set(a.get("role", "").split())
        whole = name in ("body", "html", "article", "main")
        drop = name in _DROPPED or bool(roles & _ROLES) or "hidden" in a or a.get("aria-hidden") == "true" or (not whole and bool(marks & _COMMENTS))
        drop = drop or (name in _INLINE and bool(marks & _ADS) and marks - {""} <= _ADS)
        drop = drop or (name == "article" and bool(marks & {"comment", "comments", "ad", "ads", "advert", "related", "promo"}))
        body = name in ("article", "main") or bool(roles & {"main", "article"}) or "articlebody" in a.get("itemprop", "").split()
        named = not whole and bool(marks & _WORDS)
        hint = not drop and not body and not whole and (name not in _INLINE or named) and bool((marks | roles) & (_HINTS | _WORDS))
        found = (drop, drop or named, body and not drop, hint)
        if len(_CACHE) > 50_000:
            _CACHE.clear()
        _CACHE[key] = found
    return found


@dataclass
class Block:
    """text; kept: in no dropped element; article: in an article; hint: below an element there that hints at boilerplate; linked:
    characters in links."""

    text: str
    kept: bool
    article: bool
    hint: bool
    linked: int


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in page order, dropped ones too, read in one pass with a stack.

    Dropped elements that are never closed are taken as closed where the element around them closes; those open at the page's end
    drop nothing. If the first article of a page stands in dropped elements (a page frame of class "with-sidebar") and no other
    article does not, these elements drop nothing either. What an element drops is settled at the page's end."""
    stack: list[tuple] = []  # name, drop and article that were innermost before, hints before
    drops: list[int] = []  # of each dropped element the one around it, or -1
    bodies: list[tuple[int, int]] = []  # of each article's container the one around it, and the dropped element around it
    drop, body, hints = -1, -1, 0
    opened: Counter[str] = Counter()
    found: list[tuple[str, int, int, bool, int]] = []
    run: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                found.append((text, drop, body, hints > 0, linked))
            run.clear()
        linked = 0

    def close(height: int) -> None:
        nonlocal drop, body, hints, links
        while len(stack) > height:
            name, drop_before, body_before, hints_before = stack.pop()
            if (drop, body, hints) != (drop_before, body_before, hints_before):
                flush()
            drop, body, hints = drop_before, body_before, hints_before
            opened[name] -= 1
            links -= name == "a"

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m["name"]
        if name is None:
            t = m.group()
            if t[0] != "<" or t == "<":
                run.append(t)
                linked += len(t) if links > 0 else 0
            continue
        name, attrs = name.lower(), m["loose"] if m["attrs"] is None else m["attrs"]
        own = attrs.endswith("/")
        if m["end"]:
            if opened[name] > 0:
                h = next(h for h in range(len(stack) - 1, -1, -1) if stack[h][0] == name)
                if name not in _INLINE:
                    flush()
                close(h)
            continue
        if name == "br" or name == "hr":
            run.append(" ")
            continue
        if name in _VOID or own and name not in _RAW and name not in _DROPPED and name not in ("p", "div", "article", "main", "section", "span"):
            if name not in _INLINE:
                run.append(" ")
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if name in _ENDS:
            for h in range(len(stack) - 1, -1, -1):
                if stack[h][0] in _ENDS[name]:
                    flush()
                    close(h)
                    break
                if stack[h][0] not in _INLINE:
                    break
        inside, outside, contains, hint = _judge(name, attrs.removesuffix("/"))
        dropped = inside if body >= 0 else outside
        contains = contains and not dropped
        if name not in _INLINE or dropped or hint:
            flush()
        stack.append((name, drop, body, hints))
        opened[name] += 1
        links += name == "a"
        if dropped:
            drops.append(drop)
            drop = len(drops) - 1
        if contains:
            bodies.append((body, drop))
            body, hints = len(bodies) - 1, 0
        hints += hint
    flush()
    lost = [False] * len(drops)
    k = drop
    while k >= 0:
        lost[k] = True
        k = drops[k]

    def settled() -> list[Block]:
        free = []
        for k, outer in enumerate(drops):
            free.append(lost[k] and (outer < 0 or free[outer]))
        fine = []
        for outer, d in bodies:
            fine.append(d < 0 or free[d] or outer >= 0 and fine[outer])
        return [Block(t, d < 0 or free[d], b >= 0 and fine[b] and (d < 0 or free[d]), h, w) for t, d, b, h, w in found]

    blocks = settled()
    if bodies and not any(b.article for b in blocks):
        k = bodies[0][1]
        while k >= 0:
            lost[k] = True
            k = drops[k]
        blocks = settled()
    return blocks


_PLACE = constants(1, 21)[0]


def _sequence_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each sequence of token hashes h[first:last]; the sequences follow each other and are all of h."""
    n = (last - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(1, len(h) + 1, dtype=np.uint64) - np.repeat(first, last - first).astype(np.uint64)
        placed = mix(h + place * _PLACE)
        upto = np.concatenate([[np.uint64(0)], np.cumsum(placed)])
        return mix(upto[last] - upto[first] + n).view(np.int64)


class Streams:
    """The token streams of some pages, all their blocks included. ``blocks``: those of each page; ``block_at``: the number of a page's
    first block (and of the end) in the flat list; ``word_at``: the number of a block's first token in ``hashes``; ``own``: the
    page's own blocks, which are those of its article, or where none is marked, those that nothing drops."""

    def __init__(self, pages: list[str], hosts: list[int]):
        self.hosts = np.array(hosts, np.int64).view(np.uint64)
        self.blocks = [read_blocks(p) for p in pages]
        flat = [b for blocks in self.blocks for b in blocks]
        self.block_at = np.concatenate([[0], np.cumsum([len(b) for b in self.blocks])]).astype(np.int64)
        self.marked = [any(b.article for b in blocks) for blocks in self.blocks]
        self.article = np.array([b.article for b in flat], bool)
        self.sparse = np.array([b.article and not b.hint for b in flat], bool)
        self.own = np.array([b.article if m else b.kept for blocks, m in zip(self.blocks, self.marked, strict=True) for b in blocks], bool)
        raw = [b.text.encode() for b in flat]
        offs = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        buf = np.frombuffer(b"\n".join(raw) + b"\n" * bool(raw), np.uint8)
        starts, ends, self.word_at = words(buf, offs)
        self.hashes = word_hashes(buf, starts, ends, lower=False)
        self.page_at = self.word_at[self.block_at]

    def open(self) -> list[bool]:
        """Which pages have something that the array is to settle."""
        return [any(b.hint and b.article for b in blocks) if m else any(b.kept for b in blocks) for blocks, m in zip(self.blocks, self.marked, strict=True)]

    def cores(self) -> np.ndarray:
        """A hash of each page's own tokens, by which pages are told apart."""
        mine = np.repeat(self.own, np.diff(self.word_at))
        at = np.concatenate([[0], np.cumsum(mine)])[self.page_at]
        return _sequence_hashes(self.hashes[mine], at[:-1], at[1:])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of LONG tokens or more its group, a hash of the host and the first LONG tokens, in the order of the pages;
        and the number of the first one of each page (and of the end)."""
        n = np.maximum(np.diff(self.page_at) - LONG + 1, 0)
        at = np.concatenate([[0], np.cumsum(n)])
        short = np.flatnonzero(n == 0)
        flat, offs = shingles(self.hashes, self.page_at, LONG)
        keep = np.ones(len(flat), bool)
        keep[offs[short][offs[short] < offs[short + 1]]] = False  # the one shingle of a page of fewer tokens
        with np.errstate(over="ignore"):
            return (flat[keep] + np.repeat(self.hosts, n)).view(np.int64), at

    def taken(self, groups: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which suffixes the array has: the least of WINDOW in a row, and all that begin in blocks that it may settle, which are those
        outside of articles and those of hints."""
        n = np.diff(at)
        page = np.repeat(np.arange(len(n)), n)
        word = np.arange(len(groups)) - at[page] + self.page_at[page]
        out = ~np.repeat(self.sparse, np.diff(self.word_at))[word] if len(groups) else np.zeros(0, bool)
        out |= (n < WINDOW)[page]
        if len(groups) >= WINDOW:
            windows = np.lib.stride_tricks.sliding_window_view(groups, WINDOW)
            first = np.flatnonzero(page[: len(windows)] == page[WINDOW - 1 :])
            out[first + np.argmin(windows[first], 1)] = True
        out[self.settling(groups, at)[1]] = True
        return out

    def settling(self, groups: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that settle each block of ``whole``: the first and the last within it, and the least of WINDOW in a row within it. For each
        block where its part begins (and the end), and the numbers of the suffixes."""
        which = self.whole()[0]
        page = np.searchsorted(self.block_at, which, "right") - 1
        n = np.diff(self.word_at)[which] - LONG + 1
        ends = np.cumsum(n)
        inside = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)
        number = np.repeat(at[page] + self.word_at[which] - self.page_at[page], n) + inside
        picked = np.zeros(len(number), bool)
        picked[ends - n] = picked[ends - 1] = True
        if len(number) >= WINDOW:
            windows = np.lib.stride_tricks.sliding_window_view(groups[number], WINDOW)
            first = np.flatnonzero(inside + WINDOW <= np.repeat(n, n))
            picked[first + np.argmin(windows[first], 1)] = True
        return np.concatenate([[0], np.cumsum(picked)])[np.concatenate([[0], ends])], number[picked]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of articles of LONG tokens or more (their numbers in the flat list), and a hash of the host and all their tokens."""
        which = np.flatnonzero(self.article & (np.diff(self.word_at) >= LONG))
        keys = _sequence_hashes(self.hashes, self.word_at[:-1], self.word_at[1:])[which].view(np.uint64)
        page = np.searchsorted(self.block_at, which, "right") - 1
        with np.errstate(over="ignore"):
            return which, (keys + self.hosts[page]).view(np.int64)

    def text(self, shared: np.ndarray, common: set[int]) -> str:
        """Of one page the main text, by the repeated suffix groups among its suffixes and the common blocks among its blocks."""
        n = np.diff(self.word_at)
        bad = np.flatnonzero(np.isin(self.groups()[0], shared))
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edge, bad, 1)
        np.add.at(edge, bad + LONG, -1)
        covered = np.cumsum(edge)[:-1] > 0
        gone = {k for k, key in zip(*(x.tolist() for x in self.whole()), strict=True) if key in common}
        out = []
        for k, b in enumerate(self.blocks[0]):
            if not self.own[k] or k in gone or b.hint and 2 * b.linked >= len(b.text):
                continue
            mine = covered[self.word_at[k] : self.word_at[k + 1]]
            if not self.marked[0]:
                out += [t for t, c in zip(_TOKENS.split(b.text), mine.tolist(), strict=True) if not c]
            elif not (b.hint and 2 * mine.sum() >= n[k]):
                out.append(b.text)
        return " ".join(out)


#: Tokens are cut where ``words`` cuts them; all other white space has become one space before, or stands inside a token.
_TOKENS = re.compile(r"[\x20\x09-\x0d]+")
_NONE = np.zeros(0, np.int64)


def _pages(batches: Iterator[pa.RecordBatch], html_at: int, host_at: int) -> Iterator[tuple[pa.RecordBatch, Streams]]:
    """Some pages at once, so that numbers are worked on in bulk and texts stay bounded."""
    for b in batches:
        for i, j in slices(buffer_of(b.column(html_at))[1]):
            part = b.slice(i, j - i)
            yield part, Streams(part.column(html_at).to_pylist(), part.column(host_at).to_pylist())


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(html, host) -> the taken suffixes of all pages: (suffix, core)."""
    for _, streams in _pages(batches, 0, 1):
        groups, at = streams.groups()
        keep = streams.taken(groups, at)
        core = np.repeat(streams.cores() & 0x7FFFFFFF, np.diff(at))
        yield pa.RecordBatch.from_arrays([pa.array(groups[keep]), pa.array(core[keep].astype(np.int32))], ["suffix", "core"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, host) -> host, core, the article's blocks with the suffixes that settle them, and the page itself where something is
    open."""
    for b, streams in _pages(batches, 2, 3):
        which, keys = streams.whole()
        groups, suffix_at = streams.groups()
        parts, numbers = streams.settling(groups, suffix_at)
        suffixes = pa.ListArray.from_arrays(pa.array(parts.astype(np.int32)), pa.array(groups[numbers]))
        blocks = pa.StructArray.from_arrays([pa.array(keys), suffixes], ["key", "suffixes"])
        at = np.searchsorted(which, streams.block_at).astype(np.int32)
        page = pa.array([h if is_open else None for h, is_open in zip(b.column(2).to_pylist(), streams.open(), strict=True)], pa.string())
        columns = [b.column(0), b.column(1), b.column(3), pa.array(streams.cores()), pa.ListArray.from_arrays(pa.array(at), blocks), page]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "core", "blocks", "open"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, html, host) of open pages -> (row, suffix), all of their suffixes."""
    for b, streams in _pages(batches, 1, 2):
        groups, at = streams.groups()
        rows = np.repeat(b.column(0).to_numpy(), np.diff(at))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(groups)], ["row", "suffix"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, host, shared, common) -> page_id, url, text."""
    for b in batches:
        lists = zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)
        texts = [Streams([page], [host]).text(np.array(s or [], np.int64), set(c or [])) for page, host, s, c in lists]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _with_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, host) -> page_id, url, host, core, the article's blocks and their hashes (0 for short ones), for pages
    where nothing is open: of these blocks those go that the array has found to be common."""
    for b, streams in _pages(batches, 2, 3):
        named = dict(zip(*(x.tolist() for x in streams.whole()), strict=True))
        rows = [k for k, is_open in enumerate(streams.open()) if not is_open]
        own = [[i for i, x in enumerate(streams.blocks[k]) if x.article] for k in rows]
        texts = [[streams.blocks[k][i].text for i in mine] for k, mine in zip(rows, own, strict=True)]
        keys = [[named.get(int(streams.block_at[k]) + i, 0) for i in mine] for k, mine in zip(rows, own, strict=True)]
        some = pa.array(rows, pa.int64())
        columns = [*(b.column(k).take(some) for k in (0, 1, 3)), pa.array(streams.cores()).take(some), pa.array(texts, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "core", "texts", "keys"])


def repeated_suffixes(pages: DataFrame) -> DataFrame:
    """(suffix): the groups of the hosts' suffix arrays that hold pages of different text. ``pages``: _h, _host."""
    every = pages.select("_h", "_host").mapInArrow(_suffixes, "suffix long, core int")
    return every.groupBy("suffix").agg(F.min("core").alias("a"), F.max("core").alias("b")).filter("a <> b").select("suffix")


def common_blocks(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """(host, core, common): for the pages with blocks that the array finds in most of the host's articles, and in MANY, these blocks.

    ``found``: host, core, blocks (key, suffixes); ``repeated``: the groups of the array that hold more than one page. A group counts the articles
    (pages of equal text once) whose blocks it settles; a block is common if each of its groups has enough of them."""
    articles = found.filter(F.size("blocks") > 0)
    each = articles.select("host", "core", F.explode("blocks").alias("b")).select("host", "core", "b.key", F.array_distinct("b.suffixes").alias("s"))
    each = each.select("host", "core", "key", F.size("s").alias("size"), F.explode("s").alias("suffix"))
    members = cut(each.join(small(repeated), "suffix", "left_semi").distinct())
    counts = members.select("host", "core", "suffix").distinct().groupBy("host", "suffix").agg(F.count("*").alias("n")).filter(F.col("n") >= MANY)
    sizes = articles.select("host", "core").distinct().groupBy("host").agg(F.count("*").alias("all"))
    most = cut(counts.join(sizes, "host").filter(2 * F.col("n") > F.col("all")).select("suffix"))
    held = members.select("key", "size", "suffix").distinct().join(small(most), "suffix", "left_semi")
    gone = cut(held.groupBy("key", "size").agg(F.count("*").alias("n")).filter("n = size").select("key"))
    return members.select("host", "core", "key").join(small(gone), "key").groupBy("host", "core").agg(F.collect_set("key").alias("common"))  # at most a page's own blocks


def _host(url: str) -> Column:
    return F.xxhash64(F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html; others are ignored).

    Null and empty pages, and pages with nothing but boilerplate, have an empty text. Pages with a null or broken address share
    one host. Repeated rows stay, with equal results; an empty table gives an empty result. Pages are read anew in each step: that
    is cheaper than to store or shuffle their texts. Only pages with something open, which are few, are stored."""
    ready(pages.sparkSession)
    source = pages.select("page_id", "url", text_or_empty("html").alias("_h"), _host("url").alias("_host"))
    ids = T.StructType([source.schema["page_id"], source.schema["url"]])
    repeated = cut(repeated_suffixes(source))
    found = cut(source.mapInArrow(_marks, with_fields(ids, "host long, core long, blocks array<struct<key:long,suffixes:array<long>>>, open string")))
    common = cut(common_blocks(found, repeated))
    done = source.mapInArrow(_with_blocks, with_fields(ids, "host long, core long, texts array<string>, keys array<long>")).join(small(common), ["host", "core"], "left")
    listed = F.coalesce("common", F.array().cast("array<long>"))
    text = F.transform(F.filter(F.arrays_zip("texts", "keys"), lambda x: ~F.array_contains(listed, x["keys"])), lambda x: x["texts"])
    out = done.select("page_id", "url", F.array_join(text, " ").alias("text"))
    open_pages = found.filter("open is not null").select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "open", "host", "core")
    if not open_pages.isEmpty():
        open_pages = cut(open_pages)
        asked = open_pages.select("row", "open", "host").mapInArrow(_asked, "row long, suffix long")
        shared = asked.join(repeated, "suffix", "left_semi").groupBy("row").agg(F.collect_set("suffix").alias("shared"))  # at most a page's own suffixes
        settled = open_pages.join(shared, "row", "left").join(small(common), ["host", "core"], "left").select("page_id", "url", "open", "host", "shared", "common")
        out = out.unionByName(settled.mapInArrow(_texts, with_fields(ids, "text string")))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
