"""Spelling variants: each word of the corpus with the commoner word that is one edit away, found by blocked Gram matrices.

Words become vectors of letter counts. One inserted or deleted letter changes the squared distance of two vectors by 1, one replaced
letter by 2 (or 0, if both letters share a dimension), so near words are at most 2 apart and differ by at most one letter in
length. |x - y|**2 = |x|**2 + |y|**2 - 2 xy, and all xy of two blocks are one matrix product.

Blocks hold words of one length and one count for each of some groups of letters; an edit changes no more than one group by one (an
inserted or deleted letter), or one up and another down. So a block meets itself and those few neighbours, each pair of
blocks once, at the smaller one. The number of groups grows with the vocabulary. A block (with its visitors) beyond SLICE_LETTERS letters is cut
into slices, and each pair of slices is a group of its own; in a group, products are made for still smaller blocks by other groups
of letters. What is at most 2 apart is compared letter by letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm.common import cut, discard, ready, small, text_or_empty

#: Letters of words, and how often one run in DROP (by a checksum) loses a letter in the registered query.
LETTERS, LEAST_LETTERS, LEAST = "A-Za-zÀ-ÿ", 5, 3
DROP = 97
UPPER = "".join(map(chr, range(65, 91)))
DIMENSIONS = 32
#: Groups of letters inside a task, letters in one slice of a block, pairs verified at once, rows of a broadcast table of words.
FINE, SLICE_LETTERS, PAIRS, BROADCAST_WORDS = 6, 160_000, 1 << 17, 200_000


def dimension(codes: np.ndarray) -> np.ndarray:
    """Of each code point: a to z have their own, others share six."""
    return np.where((codes >= 97) & (codes < 123), codes - 97, 26 + codes % 6)


def counts(docs: DataFrame, drop: int | None = DROP, least: int = LEAST, letters: int = LEAST_LETTERS) -> DataFrame:
    """word, n: the runs of letters of all texts with A-Z in lower case, of at least so many letters and occurrences. With ``drop``, a run
    whose crc32 of "doc_id:run" it divides loses one letter, as typing errors do (none without a doc_id)."""
    runs = docs.select(F.col("doc_id").cast("string").alias("_d"), F.explode(F.regexp_extract_all(text_or_empty(), F.lit(f"[{LETTERS}]{{{letters},}}"), 0)).alias("_w"))
    word = F.when(F.col("_w").rlike("[A-Z]"), F.translate("_w", UPPER, UPPER.lower())).otherwise(F.col("_w"))
    runs = runs.select("_d", word.alias("word"))
    if drop:
        h = F.crc32(F.concat("_d", F.lit(":"), "word").cast("binary"))
        at = (F.col("_h") % F.length("word")).cast("int")
        less = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        runs = runs.withColumn("_h", h).select(F.when(F.col("_h") % drop == 0, less).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= letters)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, a row for each word, 0 behind its end."""
    return np.array(words, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(words), -1)


def _vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    rows, cols = np.nonzero(codes)
    flat = rows * DIMENSIONS + dimension(codes[rows, cols].astype(np.int64))
    return np.bincount(flat, minlength=len(codes) * DIMENSIONS).reshape(-1, DIMENSIONS)


def _by_length(words: list[str]):
    """(places, words) of each length, so that long words don't widen the rows of short ones."""
    size = np.array([len(w) for w in words])
    for k in np.unique(size).tolist():
        at = np.flatnonzero(size == k)
        step = max(1, SLICE_LETTERS // k)
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield k, part, [words[j] for j in part.tolist()]


def _dealt(groups: int):
    """Sends each word to its own block (home) and to the smaller blocks next to it. A key is the length and the counts of the groups."""
    of = np.arange(DIMENSIONS) * 7 % groups
    moves = [(0,) * (groups + 1)]
    for g in range(groups):
        moves.append((-1, *(-(k == g) for k in range(groups))))
        moves += [(0, *((k == h) - (k == g) for k in range(groups))) for h in range(g + 1, groups)]
    moves = np.array(moves, np.int64)

    def run(batches):
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            for size, at, part in _by_length(words):
                v = _vectors(_codes(part, size))
                count = np.stack([np.full(len(part), size), *(v[:, of == g].sum(1) for g in range(groups))], 1)
                for k, m in enumerate(moves):
                    key = count + m
                    good = np.flatnonzero((key >= 0).all(1))
                    raw = np.ascontiguousarray(key[good], ">u4").tobytes()
                    width = 4 * (groups + 1)
                    keys = pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())
                    chosen = [part[i] for i in good.tolist()]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(chosen, pa.string()), pa.array(n[at[good]]), pa.array(np.full(len(good), k == 0))], ["key", "word", "n", "home"])

    return run


def _near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows (code points of words of one length, and of the same or one more) are one edit apart."""
    if left.shape[1] == right.shape[1]:
        return (left != right).sum(1) == 1
    n = left.shape[1]
    ahead, behind = left != right[:, :n], left != right[:, 1:]
    first = np.where(ahead.any(1), ahead.argmax(1), n)
    last = np.where(behind.any(1), n - 1 - behind[:, ::-1].argmax(1), -1)
    return last < first


_STEPS = np.array([[0] * FINE] + [[s * (k == g) for k in range(FINE)] for g in range(FINE) for s in (1, -1)] + [[(k == g) - (k == h) for k in range(FINE)] for g in range(FINE) for h in range(FINE) if g != h])


def _pairs(x: np.ndarray, y: np.ndarray):
    """Rows of the count vectors x and y whose squared distance is at most 2, in parts of about PAIRS: Gram matrices of small blocks."""
    base = 1 << 8 * np.arange(FINE)
    of = np.arange(DIMENSIONS) % FINE
    fine = lambda v: np.minimum(np.stack([v[:, of == g].sum(1) for g in range(FINE)], 1), 100) + 2
    fx, fy = fine(x) @ base, fine(y) @ base
    ox, oy = np.argsort(fx, kind="stable"), np.argsort(fy, kind="stable")
    kx, ax = np.unique(fx[ox], return_index=True)
    ky, ay = np.unique(fy[oy], return_index=True)
    ax, ay = np.append(ax, len(ox)), np.append(ay, len(oy))
    kind = np.float32 if max(int((x * x).sum(1).max()), int((y * y).sum(1).max())) < 1 << 22 else np.float64
    x, y = x[ox].astype(kind), y[oy].astype(kind)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    wanted = kx[:, None] + (_STEPS @ base)[None, :]
    slot = np.searchsorted(ky, wanted)
    hit = (slot < len(ky)) & (ky[np.minimum(slot, len(ky) - 1)] == wanted)
    outs, held = [], 0
    for k in range(len(kx)):
        a, b = int(ax[k]), int(ax[k + 1])
        slots = slot[k][hit[k]]
        if not len(slots):
            continue
        at = np.concatenate([np.arange(ay[s], ay[s + 1]) for s in slots.tolist()])
        step = max(1, (1 << 21) // len(at))
        for i in range(a, b, step):
            e = min(b, i + step)
            far = xx[i:e, None] + yy[at] - 2 * (x[i:e] @ y[at].T)
            p, q = np.nonzero(far <= 2)
            outs.append((ox[i + p], oy[at[q]]))
            held += len(p)
            if held >= PAIRS:
                yield tuple(map(np.concatenate, zip(*outs, strict=True)))
                outs, held = [], 0
    if outs:
        yield tuple(map(np.concatenate, zip(*outs, strict=True)))


def _group(table: pa.Table) -> pa.Table:
    """word, near, best_n, best of the words of a group that have near words in it: how many, and the commonest (of equals the first)."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    left, right, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "home"))
    size = np.array([len(w) for w in words])
    width = int(size[home].min()) if home.any() else 0
    one, same, more = np.flatnonzero(left), np.flatnonzero(right & (size == width)), np.flatnonzero(right & (size == width + 1))
    place = np.empty(len(words), np.int64)
    place[np.argsort(np.array(words, dtype=object), kind="stable")] = np.arange(len(words))
    pairs = []
    if len(one):
        own = _codes([words[i] for i in one.tolist()], width)
        x = _vectors(own)
        for at in (same, more):
            if not len(at):
                continue
            other = _codes([words[i] for i in at.tolist()], int(size[at[0]]))
            for p, q in _pairs(x, _vectors(other)):
                for k in range(0, len(p), step := max(1, 8 * PAIRS // (width + 1))):
                    i, j = p[k : k + step], q[k : k + step]
                    good = _near(own[i], other[j])
                    i, j = one[i[good]], at[j[good]]
                    once = ~home[j] | (place[i] < place[j])  # two home words meet in two places, or twice in one
                    pairs.append((i[once], j[once]))
    names = ["word", "near", "best_n", "best"]
    if not pairs or not sum(len(p) for p, _ in pairs):
        return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], names)
    p, q = map(np.concatenate, zip(*pairs, strict=True))
    of, to = np.concatenate([p, q]), np.concatenate([q, p])
    order = np.lexsort((place[to], -n[to], of))
    of, to = of[order], to[order]
    who, first, many = np.unique(of, return_index=True, return_counts=True)
    best = to[first]
    return pa.table([pa.array([words[i] for i in who.tolist()]), pa.array(many), pa.array(n[best]), pa.array([words[i] for i in best.tolist()])], names)


def near_words(vocabulary: DataFrame, groups: int | None = None) -> DataFrame:
    """word, n_near, best_n, best for the words of ``vocabulary`` (word, n; each word once) that have near words."""
    spark = vocabulary.sparkSession
    ready(spark)
    if groups is None:
        groups = min(10, max(3, (vocabulary.count() >> 13).bit_length()))
    dealt = cut(vocabulary.select("word", "n").mapInArrow(_dealt(groups), "key binary, word string, n long, home boolean"))
    letters = F.length("word")
    sizes = dealt.groupBy("key").agg(F.sum(F.when(F.col("home"), letters).otherwise(0)).alias("_own"), F.sum(letters).alias("_all")).filter("_own > 0")
    sizes = sizes.select("key", F.ceil(F.col("_own") / SLICE_LETTERS).cast("int").alias("_na"), F.ceil(F.col("_all") / SLICE_LETTERS).cast("int").alias("_nb"))
    h = F.abs(F.xxhash64("word") % (1 << 30))
    rows = dealt.join(small(sizes, BROADCAST_WORDS), "key").withColumns({"_a": (h % F.col("_na")).cast("int"), "_b": (F.shiftright(h, 10) % F.col("_nb")).cast("int")})
    # a home word is at the left of slice _a with all slices at the right, and at the right of slice _b with all slices at the left
    to_right = F.transform(F.sequence(F.lit(0), F.col("_na") - 1), lambda a: F.struct(a.alias("a"), F.col("_b").alias("b"), (F.col("home") & (a == F.col("_a"))).alias("left"), F.lit(True).alias("right")))
    to_left = F.transform(F.filter(F.sequence(F.lit(0), F.col("_nb") - 1), lambda b: F.col("home") & (b != F.col("_b"))), lambda b: F.struct(F.col("_a").alias("a"), b.alias("b"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    tasks = rows.select("key", "word", "n", "home", F.explode(F.concat(to_right, to_left)).alias("_t")).select("key", "_t.*", "word", "n", "home")
    found = tasks.groupBy("key", "a", "b").applyInArrow(_group, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.m")).alias("best_n"), F.col("_b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with root: where following the forms ends. Each step doubles the way; forms get commoner by
    a factor of two, so the ways are short and have no circle."""
    at = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        next_ = small(at.select(F.col("word").alias("root"), F.col("root").alias("_next")), BROADCAST_WORDS)
        step = cut(at.join(next_, "root").select("word", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")))
        moved = step.filter("_moved").limit(1).count()
        discard(at)
        at = step.drop("_moved") if not moved else cut(step.drop("_moved"))
        if not moved:
            return forms.join(at, "word")
        discard(step)


def variants(docs: DataFrame, drop: int | None = DROP, least: int = LEAST, letters: int = LEAST_LETTERS, groups: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n over the texts of ``docs`` (doc_id, text; null texts have no words; other columns are ignored).
    A word's form is its near word of largest n (ties: the first in code-point order) if that is at least twice its own. Repeated rows count
    again; very long runs of letters are words like others; an empty table gives an empty result."""
    vocabulary = cut(counts(docs, drop, least, letters))
    near = near_words(vocabulary, groups)
    has = F.col("best_n") >= 2 * F.col("n")
    forms = cut(vocabulary.join(near, "word", "left").select(
        "word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")
    ))
    discard(vocabulary)
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
