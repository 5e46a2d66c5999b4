"""Typo-tolerant matching of a term against the words of a document."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.operators.tokens import WORD_CHARS, words

RATIO = 0.3
LEAST = 3
#: Words that may be broadcast.
LISTED = 200_000


def close(word: Column, term: str, ratio: float = RATIO) -> Column:
    """``word`` is about as long as the term, begins or ends like it, and is few edits away. Cheap tests stand first."""
    lo, hi, limit = _bounds_of(term, ratio)
    size = (F.length(word) >= lo) & (F.length(word) <= hi)
    edge = (F.substring(word, 1, 1) == term[0]) | (F.substring(word, -1, 1) == term[-1])
    return size & edge & (F.levenshtein(word, F.lit(term), limit) >= 0)


def _bounds_of(term: str, ratio: float) -> tuple[int, int, int]:
    """Least and greatest length of a close word, and the edits it may have."""
    n = len(term)
    return math.floor((1 - ratio) * n + 1e-9), math.ceil((1 + ratio) * n - 1e-9), math.floor(ratio * n + 1e-9)


def close_words_in(text: Column, term: str, ratio: float = RATIO) -> Column:
    """The words of a text whose length and first or last letter let them be close to the term: one pattern finds them, and no other
    word is taken out of the text."""
    lo, hi, _ = _bounds_of(term, ratio)
    any_ = f"[{WORD_CHARS}]"
    ways = [f"\\Q{term[0]}\\E{any_}{{{lo - 1},{hi - 1}}}"] * bool(re.fullmatch(any_, term[0])) + [f"{any_}{{{lo - 1},{hi - 1}}}\\Q{term[-1]}\\E"] * bool(re.fullmatch(any_, term[-1]))
    if not ways:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(text, F.lit(f"(?<!{any_})(?:{'|'.join(ways)})(?!{any_})"), F.lit(0))


def has_close_word(text: Column, term: str, ratio: float = RATIO) -> Column:
    limit = _bounds_of(term, ratio)[2]
    return F.exists(close_words_in(text, term, ratio), lambda w: F.levenshtein(w, F.lit(term), limit) >= 0)


def fuzzy_term(content: Column, term: str, case_sensitive: bool = False, whole_word: bool = False, ratio: float = RATIO) -> Column:
    """Some word is close to the term. Terms under three characters match exactly only. Tokens are whole words, so whole_word
    asks no more of a close word."""
    text, t = (content, term) if case_sensitive else (F.lower(content), term.lower())
    if len(t) < LEAST:
        return F.exists(words(text), lambda w: w == t) if whole_word else text.contains(t)
    return has_close_word(text, t, ratio)


def fuzzy_indexes(listed: Column, term: str) -> Column:
    """The indexes of close words in an array of words; none for terms under three characters."""
    if len(term) < LEAST:
        return F.array().cast("array<int>")
    return F.filter(F.transform(listed, lambda w, i: F.when(close(w, term), i)), lambda i: i.isNotNull())


def fuzzy_score(content: Column, term: str) -> Column:
    """0 for an exact hit, 0.5 for a close word, 1 for neither."""
    exact = F.lower(content).contains(term.lower())
    return F.when(exact, 0.0).when(F.coalesce(fuzzy_term(content, term), F.lit(False)), 0.5).otherwise(1.0)


def fuzzy_positions(token_table: DataFrame, term: str) -> DataFrame:
    """The rows of the token table whose word is close to the term."""
    return token_table.filter(close(F.lower("word"), term.lower()))


def fuzzy_filter(results: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    """Result rows with the term, or a word close to it, in their path or read error. Terms under two characters keep all."""
    if len(term) < 2:
        return results
    tests = []
    for name in ("file_path", "read_error"):
        c = F.col(name)
        text, t = (c, term) if case_sensitive else (F.lower(c), term.lower())
        tests.append(F.coalesce(text.contains(t) | fuzzy_term(c, term, case_sensitive), F.lit(False)))
    return results.filter(tests[0] | tests[1])


# --- many terms against a corpus: each different word is compared once -----------------------------------------------------------


def postings(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """word, key: a row for each different word (in lower case) of each document. A table to be written once and searched often; it is dealt
    by word, and what a word that stands everywhere has is many rows, never one."""
    return docs.select(key, F.explode(F.array_distinct(words(F.lower(content)))).alias("word")).select("word", key)


def vocabulary(posted: DataFrame) -> DataFrame:
    """word, documents."""
    return posted.groupBy("word").agg(F.count("*").alias("documents"))


def _bounds(terms: list[str], ratio: float) -> list[tuple]:
    """(term, least length, greatest length, edits, first letter, last letter) of each term."""
    return [(t, *_bounds_of(t, ratio), t[0], t[-1]) for t in terms]


def close_words(vocabulary: DataFrame, terms: list[str], ratio: float = RATIO) -> DataFrame:
    """term, word: the words of ``vocabulary`` (each once) that are close to a term, by the rule of ``close``.

    A close word begins or ends like its term, so words and terms are joined by the first letter and by the last one, with the lengths
    in the key as well (a term stands under each length that a close word may have): a word meets the terms of its two keys only, and
    edits are counted for these pairs. The terms are the side that is broadcast; the vocabulary isn't shuffled."""
    spark = vocabulary.sparkSession
    wanted = sorted({t.lower() for t in terms if len(t) >= LEAST})
    rows = [(t, n, k, side, letter) for t, lo, hi, k, first, last in _bounds(wanted, ratio) for n in range(max(1, lo), hi + 1) for side, letter in ((0, first), (1, last))]
    keys = F.broadcast(spark.createDataFrame(rows, "term string, _n int, _k int, _side int, _letter string"))
    w = F.col("word")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring(w, 1, 1).alias("letter")), F.struct(F.lit(1).alias("side"), F.substring(w, -1, 1).alias("letter")))
    asked = vocabulary.select("word", F.length(w).alias("_n"), F.explode(sides).alias("_e")).select("word", "_n", F.col("_e.side").alias("_side"), F.col("_e.letter").alias("_letter"))
    pairs = asked.join(keys, ["_n", "_side", "_letter"])
    begins = F.substring(w, 1, 1) == F.substring("term", 1, 1)
    once = (F.col("_side") == 0) | ~begins  # a word that begins and ends like the term is met twice
    return pairs.filter(once & (F.levenshtein("word", "term") <= F.col("_k"))).select("term", "word")


def documents_with(posted: DataFrame, terms: list[str], key: str = "doc_id", ratio: float = RATIO) -> DataFrame:
    """term, key of the documents with a word close to the term: each different word is compared once, however many documents have it,
    and the words found lead to their documents through the postings. The words found are broadcast where they are counted as few."""
    found = close_words(posted.select("word").distinct(), terms, ratio)
    few = found.limit(LISTED + 1).count() <= LISTED
    return posted.join(F.broadcast(found) if few else found, "word").select("term", key).distinct()
