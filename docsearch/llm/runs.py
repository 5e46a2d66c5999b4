"""Periodic runs of words, and texts without the repeats.

A run is a stretch of words with smallest period q, at least LEAST words and TIMES periods long, that no neighbouring word extends.
They are found in a document's suffix tree: Ukkonen's trees of the document and of its reversal, walked once each, answer "how far do
these two places agree", to the right and to the left, by one range minimum over the tour. Every run begins with the longest
Lyndon word at some place, for one of the two orders of the symbols; so the longest Lyndon words of all places are the candidates,
and each is extended both ways.

Trees are built for the words that can be in a run at all. Any three neighbouring words of a run occur at least three times in it, and
each of its words at least four times; what fails this (counted by hash, so that a collision keeps a word more, never less) can't
be in a run, and what is left in stretches shorter than LEAST can't either. The rest of the document stands as one separator
for each gap, found nowhere else, that no run crosses. The filter needs LEAST >= 6 and TIMES >= 4.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.llm.common import buffer_of, ready, slices, text_or_empty

LEAST, TIMES = 6, 4
#: Bytes of text whose words are filtered at once.
SLICE = 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class Tree:
    """Ukkonen's suffix tree of ``symbols`` (1 to size - 1), to which 0 is added as the end. Nodes carry their depth in symbols; a leaf's
    suffix is known by its depth."""

    def __init__(self, symbols: list[int], size: int):
        text = [*symbols, 0]
        self.n = n = len(text)
        self.size = size
        start, end, link, depth = [0], [0], [0], [0]
        below: dict[int, int] = {}  # node * size + symbol -> child
        node, edge, length, left = 0, 0, 0, 0
        get = below.get
        for i, c in enumerate(text):
            waits = 0
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * size + text[edge]
                child = get(key)
                if child is None:
                    below[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    depth.append(n - i + left - 1)
                    if waits:
                        link[waits] = node
                    waits = node
                else:
                    begin = start[child]
                    span = end[child] - begin
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[begin + length] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    fork = len(start)
                    below[key] = fork
                    start += (begin, i)
                    end += (begin + length, n)
                    link += (0, 0)
                    depth += (left - 1, n - i + left - 1)
                    below[fork * size + c] = fork + 1
                    start[child] = begin + length
                    below[fork * size + text[begin + length]] = child
                    if waits:
                        link[waits] = fork
                    waits = fork
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                else:
                    node = link[node]
        del start, end, link
        self.depth = np.array(depth, np.int32)
        keys = np.fromiter(below.keys(), np.int64, len(below))
        self.child = np.fromiter(below.values(), np.int32, len(below))
        self.parent, self.symbol = keys // size, keys % size
        inner = np.zeros(len(depth), bool)
        inner[self.parent] = True
        self.suffix = np.where(inner, -1, n - self.depth)

    def walk(self, descending: bool = False) -> np.ndarray:
        """The nodes in the order in which a tour meets them first; children by symbol, or by falling symbol behind the end."""
        by = np.where(self.symbol > 0, self.size - self.symbol, 0) if descending else self.symbol
        order = np.lexsort((-by, self.parent))
        kids = self.child[order].tolist()
        at = np.searchsorted(self.parent[order], np.arange(len(self.depth) + 1)).tolist()
        out, stack = [], [0]
        pop, put = stack.pop, out.append
        while stack:
            v = pop()
            put(v)
            a, b = at[v], at[v + 1]
            if a < b:
                stack += kids[a:b]
        return np.array(out, np.int32)

    def ranks(self, walked: np.ndarray) -> list[int]:
        """The place of each suffix in the order of the walk."""
        leaves = self.suffix[walked]
        leaves = leaves[leaves >= 0]
        out = np.empty(self.n, np.int64)
        out[leaves] = np.arange(self.n)
        return out.tolist()

    def agree(self, walked: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j (unlike places) have in common: the depth of their lowest common ancestor, which is
        the smallest depth that the tour steps down from between the two leaves."""
        came = np.zeros(len(self.depth), np.int32)
        came[self.child] = self.depth[self.parent]
        levels = [came[walked]]
        width = 1
        while 2 * width <= len(walked):
            levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
            width *= 2
        place = np.empty(self.n, np.int64)
        leaf = self.suffix[walked]
        met = np.flatnonzero(leaf >= 0)
        place[leaf[met]] = met
        a, b = place[i], place[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(levels[k][a[at]], levels[k][b[at] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next place whose suffix is smaller; the last suffix is the smallest."""
    n = len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, r = i + 1, rank[i]
        while rank[j] > r:
            j = out[j]
        out[i] = j
    return np.array(out[:-1], np.int64)


def find(symbols: list[int], size: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """The runs of a list of symbols (1 to size - 1) as rows of start, length, period, by start, then period."""
    n = len(symbols)
    if n < least:
        return np.zeros((0, 3), np.int64)
    tree = Tree(symbols, size)
    walked = tree.walk()
    at = np.arange(n)
    roots = [(at, _next_smaller(tree.ranks(walked)) - at), (at, _next_smaller(tree.ranks(tree.walk(True))) - at)]
    key = np.unique(np.concatenate([i * (n + 1) + p for i, p in roots]))
    i, p = key // (n + 1), key % (n + 1)
    fits = (times * p <= n) & (i + p < n)
    i, p = i[fits], p[fits]
    if not len(i):
        return np.zeros((0, 3), np.int64)
    right = tree.agree(walked, i, i + p)
    del tree, walked
    back = Tree(symbols[::-1], size)
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = back.agree(back.walk(), n - i[inner], n - i[inner] - p[inner])
    length = left + p + right
    good = length >= np.maximum(least, times * p)
    if not good.any():
        return np.zeros((0, 3), np.int64)
    return np.unique(np.stack([(i - left)[good], p[good], length[good]], 1), axis=0)[:, [0, 2, 1]]


def _often(keys: np.ndarray, least: int) -> np.ndarray:
    """Which keys occur at least so often; a collision may add one."""
    bits = max(10, int(8 * len(keys)).bit_length())
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(slot, minlength=1 << bits)[slot] >= least


_A, _B, _C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def may_repeat(h: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Which words (by hash, with the number of the document) can be in a run. Repeats both tests among what is left."""
    live = np.arange(len(h))
    with np.errstate(over="ignore"):
        salt = document.astype(np.uint64) * _C
        while len(live) >= LEAST:
            k, d = h[live], document[live]
            joined = np.zeros(len(live), bool)  # three words in a row that stand side by side in one document
            joined[:-2] = (live[2:] - live[:-2] == 2) & (d[2:] == d[:-2])
            first = np.flatnonzero(joined)
            three = ((k[first] * _A + k[first + 1]) * _B + k[first + 2] ^ salt[live[first]]) * _A
            first = first[_often(three, 3)]
            keep = np.zeros(len(live), bool)
            for step in range(3):
                keep[first + step] = True
            at = np.flatnonzero(keep)
            at = at[_often((k[at] ^ salt[live[at]]) * _A, TIMES)]
            left = live[at]
            if len(left):
                gap = (np.diff(left) != 1) | (np.diff(document[left]) != 0)
                edge = np.concatenate([[0], np.flatnonzero(gap) + 1, [len(left)]])
                long = np.diff(edge) >= LEAST
                left = left[np.repeat(long, np.diff(edge))]
            if len(left) == len(live):
                break
            live = left
    out = np.zeros(len(h), bool)
    if len(live) >= LEAST:
        out[live] = True
    return out


def _runs_of(words: list[bytes], live: np.ndarray) -> np.ndarray:
    """The runs of a document whose words at ``live`` (rising places) can be in one."""
    known: dict[bytes, int] = {}
    numbers = [known.setdefault(words[i], len(known) + 1) for i in live.tolist()]
    gaps = np.flatnonzero(np.diff(live) > 1) + 1
    count = len(known) + 1
    symbols = np.insert(np.array(numbers, np.int64), gaps, count + np.arange(len(gaps)))
    place = np.insert(live, gaps, 0)
    runs = find(symbols.tolist(), count + len(gaps))
    if len(runs):
        runs[:, 0] = place[runs[:, 0]]
    return runs


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Without what a run repeats after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def collapse(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed (the words that no run repeats, joined by one space) for every row of
    ``docs`` (columns doc_id, text; others are ignored). Words are ``[^\\x20\\x09-\\x0D]+``; ``rewrite`` gets doc_id and the words and returns
    those to use. Null, empty and blank texts have no runs and an empty collapsed text; repeated rows and ties of doc_id stay
    rows of their own; an empty table gives an empty one. A very long text needs memory in proportion to its words, and some 500
    bytes for each word that may be in a run. One pass without a shuffle."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffer_of(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in slices(offs, SLICE):
                texts = [buf[offs[k] : offs[k + 1]].tobytes().split() for k in range(i, j)]
                if rewrite:
                    texts = [rewrite(d, w) for d, w in zip(ids[i:j], texts, strict=True)]
                at = np.cumsum([0, *map(len, texts)])
                h = np.fromiter((x for w in texts for x in map(hash, w)), np.int64, at[-1]).view(np.uint64)
                live = np.flatnonzero(may_repeat(h, np.repeat(np.arange(j - i), np.diff(at))))
                cut = np.searchsorted(live, at)
                found, out = [], []
                for k, words in enumerate(texts):
                    runs = np.zeros((0, 3), np.int64)
                    if cut[k] < cut[k + 1]:
                        runs = _runs_of(words, live[cut[k] : cut[k + 1]] - at[k])
                        words = _kept(words, runs)
                    found.append(runs)
                    out.append(b" ".join(words))
                flat = np.concatenate(found)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_t")).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The registered query's words: in one document of ten (by crc32 of its id) a tail repeats its first words."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def greatest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equals the first by start, then period. Null without runs."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(more(x, best), x).otherwise(best))


def digests(docs: DataFrame, rewrite: Rewrite | None = planted) -> DataFrame:
    """doc_id, n_runs, the greatest run (start, length, period, exponent_milli), and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    best = F.col("_best")
    return collapse(docs, rewrite).withColumn("_best", greatest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
