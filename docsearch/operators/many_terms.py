"""Highlighting and finding of very many terms in one pass over each text.

An automaton of all terms (Aho-Corasick) reads a text once, whatever the number of terms; of the matches the one that begins
first counts, of several there the longest, and the next is looked for behind it: what ``positions.highlight`` gives for an
alternation of the terms, whose time grows with their number. The terms go to the tasks with the job, so they are bounded
(MOST_LETTERS in all); a longer list is cut into parts by the caller, or joined word by word (``fuzzy.vocabulary``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.functions.arrow import steps, utf8

#: Letters of all terms together: the automaton takes some 100 bytes for each.
MOST_LETTERS = 2_000_000
#: Bytes of text whose matches are held at once (or one text): a match takes some hundred times its own byte in Python.
STEP_BYTES = 1 << 17
SPANS = "array<struct<start:int,end:int,term:string>>"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_automata: dict[tuple, object] = {}


def automaton(terms: tuple[str, ...]):
    """One for each list of terms and worker process, the newest few."""
    import ahocorasick

    found = _automata.get(terms)
    if found is None:
        found = ahocorasick.Automaton()
        for t in terms:
            found.add_word(t, len(t))
        found.make_automaton()
        if len(_automata) > 3:
            _automata.clear()
        _automata[terms] = found
    return found


def _kept(terms: list[str], case_sensitive: bool) -> tuple[str, ...]:
    kept = tuple(sorted({t if case_sensitive else t.translate(_LOWER) for t in terms if t}))
    if sum(map(len, kept)) > MOST_LETTERS:
        raise ValueError(f"the terms have more than {MOST_LETTERS} letters; search them in parts")
    return kept


def longest_first(text: str, auto) -> list[tuple[int, int]]:
    """(start, end) of the matches that count, in order."""
    best: dict[int, int] = {}
    for last, n in auto.iter(text):
        start = last - n + 1
        if n > best.get(start, 0):
            best[start] = n
    out, free = [], 0
    for start in sorted(best):
        if start >= free:
            free = start + best[start]
            out.append((start, free))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) in parts of about STEP_BYTES of text, however large Spark has made them."""
    for b in batches:
        for i, j in steps(utf8(b.column(1))[1], STEP_BYTES):
            yield b.slice(i, j - i)


def highlight_many(docs: DataFrame, terms: list[str], case_sensitive: bool = False, key: str = "doc_id", content: str = "content", before: str = "<mark>", after: str = "</mark>") -> DataFrame:
    """key, marked (the text with its matches between ``before`` and ``after``) and spans (start, end, term as it stands in the text; code points,
    the end exclusive) for every row. Without case A-Z count as a-z, as in the patterns of this package. Null texts stay null, without spans."""
    kept = _kept(terms, case_sensitive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(kept) if kept else None
        for b in _parts(batches):
            marked, starts, ends, found, sizes = [], [], [], [], []
            for text in b.column(1).to_pylist():
                spans = longest_first(text if case_sensitive else text.encode().lower().decode(), auto) if text and auto else []
                parts, at = [], 0
                for s, e in spans:
                    parts += (text[at:s], before, text[s:e], after)
                    found.append(text[s:e])
                    at = e
                marked.append(None if text is None else "".join(parts) + text[at:])
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
                sizes.append(len(spans))
            rows = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())], ["start", "end", "term"])
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marked, pa.string()), pa.ListArray.from_arrays(at, rows)], [key, "marked", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, content).mapInArrow(run, f"`{key}` {kind}, marked string, spans {SPANS}")


def match_counts(docs: DataFrame, terms: list[str], case_sensitive: bool = False, key: str = "doc_id", content: str = "content") -> DataFrame:
    """term (in lower case unless ``case_sensitive``), n, documents: the counting matches of all texts. Counts are added up by text in
    the tasks first."""
    kept = _kept(terms, case_sensitive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(kept) if kept else None
        for b in _parts(batches):
            rows, found, counts = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                if text and auto:
                    text = text if case_sensitive else text.encode().lower().decode()
                    each = Counter(text[s:e] for s, e in longest_first(text, auto))
                    rows += [k] * len(each)
                    found += each
                    counts += each.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(counts, pa.int64())], [key, "term", "n"])

    kind = docs.schema[key].dataType.simpleString()
    each = docs.select(key, content).mapInArrow(run, f"`{key}` {kind}, term string, n long").groupBy(key, "term").agg(F.sum("n").alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))
