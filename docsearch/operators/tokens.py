"""The token table: words with their places, and what is computed from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsearch.functions.arrays import let, running_sums
from docsearch.functions.arrow import steps, utf8
from docsearch.sources.scratch import stored

WORD_CHARS = "A-Za-z0-9_À-ÿ"
_RUN = f"[{WORD_CHARS}]+"


def words(content: Column) -> Column:
    """Maximal runs of word characters, of two characters or more."""
    return F.filter(F.regexp_extract_all(content, F.lit(_RUN), F.lit(0)), lambda w: F.length(w) > 1)


def placed_words(content: Column) -> Column:
    """word, start and end (of the last character) of every word, in order. Gaps and runs alternate, so a run begins after all
    before it."""

    def placed(runs: Column) -> Column:
        gaps = F.transform(F.slice(F.split(content, _RUN, -1), 1, F.size(runs)), lambda g: F.length(g))
        after = let(gaps, lambda g: F.slice(running_sums(F.zip_with(g, runs, lambda n, w: n + F.length(w))), 2, F.size(runs)))
        return F.zip_with(runs, after, lambda w, e: F.struct(w.alias("word"), (e - F.length(w)).cast("int").alias("start"), (e - 1).cast("int").alias("end")))

    return F.filter(let(F.regexp_extract_all(content, F.lit(_RUN), F.lit(0)), placed), lambda x: F.length(x["word"]) > 1)


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), 0xC3]] = True  # 0xC3 leads the letters from À to ÿ


def _scan(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the rows of a text buffer, in one pass: row, first byte, byte behind the end, place of the first character in its row,
    and that behind the last."""
    word = _WORD_BYTE[buf]
    word[1:] |= buf[:-1] == 0xC3
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    place = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # characters before each byte
    row = np.searchsorted(at, first, "right") - 1
    start, stop = place[first] - place[at[row]], place[last] - place[at[row]]
    kept = stop - start > 1
    return row[kept], first[kept], last[kept], np.stack([start[kept], stop[kept]])


def tokens(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """key, word_idx, word, start, end (of the last character) of every word. Texts are cut in Arrow batches, one pass over their bytes, and
    nothing is shuffled; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, offsets = utf8(b.column(1))
            for i, j in steps(offsets):
                buf, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, first, last, places = _scan(buf, at)
                if not len(row):
                    continue
                index = np.arange(len(row)) - np.searchsorted(row, row, "left")
                cuts = np.stack([first, last], 1).reshape(-1).astype(np.int32)  # words and gaps take turns
                turns = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(buf)))
                words = turns.take(pa.array(np.arange(0, len(cuts) - 1, 2)))
                columns = [b.column(0).take(pa.array(i + row)), pa.array(index.astype(np.int32)), words, pa.array(places[0].astype(np.int32)), pa.array((places[1] - 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [key, "word_idx", "word", "start", "end"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, content).mapInArrow(run, f"`{key}` {kind}, word_idx int, word string, start int, end int")


#: Characters of a block of a document in ``word_index_at``.
BLOCK = 1 << 16


def word_index_at(places: DataFrame, token_table: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``places`` (key, pos) with word_idx: the word that holds the position; white space after a word belongs to it; -1 before
    the first word. An as-of lookup by one window over both tables in blocks of ``block`` characters, so a document of any length is
    many groups; the last word before each block, a small table, leads over."""
    starts = token_table.select(key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), "word_idx")
    asked = places.select(key, F.col("pos").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("word_idx"))
    both = starts.unionByName(asked).withColumn("_block", F.floor(F.col("_at") / block))
    last = both.groupBy(key, "_block").agg(F.max("word_idx").alias("_last"))
    before = last.select(key, "_block", F.max("_last").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    w = W.partitionBy(key, "_block").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_word", F.last("word_idx", ignorenulls=True).over(w)).filter("_kind = 1").join(before, [key, "_block"])
    return out.select(key, F.col("_at").alias("pos"), F.coalesce("_word", "_before", F.lit(-1)).alias("word_idx"))


def word_distance(i: Column, j: Column) -> Column:
    return F.when((i < 0) | (j < 0), -1).otherwise(F.abs(i - j))


#: Keys of several rows that ``boundary_positions`` broadcasts.
REPEATED_KEYS = 200_000


def boundary_positions(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """key, pos of every start of a word and of every place after its end, once each.

    In one text no place is both, as a word is followed by a character of no word; so nothing is shuffled but the keys, and the
    places of keys that several rows have (all places, if such keys are too many to broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, offsets = utf8(b.column(1))
            for i, j in steps(offsets):
                row, _, _, places = _scan(whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + np.repeat(row, 2))), pa.array(places.T.reshape(-1).astype(np.int32))], [key, "pos"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.filter(F.col(content).isNotNull()).select(key, content)
    again = stored(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_again")))
    places = lambda some: some.mapInArrow(run, f"`{key}` {kind}, pos int")
    many = again.limit(REPEATED_KEYS + 1).count()
    if not many:
        return places(rows)
    if many > REPEATED_KEYS:
        return places(rows).distinct()
    same = F.col(key).eqNullSafe(F.col("_again"))
    return places(rows.join(F.broadcast(again), same, "left_anti")).unionByName(places(rows.join(F.broadcast(again), same, "left_semi")).distinct())


def nearest_words(content: Column, one: str, two: str) -> Column:
    """The least distance, in words between white space, of a word that holds ``one`` and a word that holds ``two`` (any case);
    -1 if one of them is missing. One fold over the document's words."""
    parts = F.filter(F.split(F.lower(content), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(-1).alias("best"))

    def step(s: Column, w: Column) -> Column:
        a = F.when(w.contains(one.lower()), s["i"]).otherwise(s["a"])
        b = F.when(w.contains(two.lower()), s["i"]).otherwise(s["b"])
        gap = F.when((a >= 0) & (b >= 0), F.abs(a - b))
        best = F.when(gap.isNull(), s["best"]).when(s["best"] < 0, gap).otherwise(F.least(s["best"], gap))
        return F.struct((s["i"] + 1).alias("i"), a.alias("a"), b.alias("b"), best.alias("best"))

    return F.when(content.isNull(), -1).otherwise(F.aggregate(parts, start, step, lambda s: s["best"]))


def within_distance(content: Column, one: str, two: str, distance: int) -> Column:
    d = nearest_words(content, one, two)
    return (d >= 0) & (d <= distance)
