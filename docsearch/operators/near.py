"""Word proximity as one Column: no token leaves its document, so nothing is shuffled, and the same Column works on streams and
under AND, OR and NOT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsearch.functions.arrays import let
from docsearch.functions.patterns import parse_literal
from docsearch.operators.fuzzy import LEAST, fuzzy_indexes, has_close_word
from docsearch.operators.positions import positions, regex_positions
from docsearch.operators.tokens import placed_words, words

#: Shorter contents have no NEAR matches.
LEAST_CONTENT = 10


def word_indexes(starts: Column, places: Column) -> Column:
    """For each of ``places`` (ascending) the index of the word that holds it, by the ascending ``starts`` of the words; a place
    outside of words belongs to the word before it, -1 before the first. Both arrays are sorted into one: a place has as many
    starts before it as its rank is above its rank among the places."""
    both = F.array_sort(F.concat(F.transform(starts, lambda s: s * 2), F.transform(places, lambda p: p * 2 + 1)))
    ranks = F.filter(F.transform(both, lambda x, i: F.when(x % 2 == 1, i)), lambda i: i.isNotNull())
    return F.transform(ranks, lambda i, k: i - k - 1)


def _plain(term: str) -> bool:
    """Whether the term stands inside one word."""
    return parse_literal(term) is None and len(term) > 1 and term.isascii() and term.replace("_", "a").isalnum()


def term_indexes(content: Column, listed: Column, starts: Column | None, term: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """The word indexes of the hits of a term (one word, several words, or a /regex/). ``listed``: the words, in lower case unless
    ``case_sensitive``; ``starts``: where they begin, which only several words and patterns need."""
    literal = parse_literal(term)
    if _plain(term):
        t = term if case_sensitive else term.lower()
        test = (lambda w: w == t) if whole_word else (lambda w: w.contains(t))
        return F.filter(F.transform(listed, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    places = regex_positions(content, literal.java) if literal else positions(content, term, case_sensitive, whole_word)
    return F.array_distinct(F.filter(word_indexes(starts, places), lambda i: i >= 0))


def near(content: Column, one: str, two: str, distance: int | str, case_sensitive: bool = False, whole_word: bool = False, fuzzy: bool = True) -> Column:
    """Hits of both terms at most ``distance`` words apart, in either order. A distance that is no number or is negative, an
    empty term, and contents under ten characters give false. ``fuzzy``: a term of three characters or more without a hit may
    be met by close words. A text is cut into words once, and each step is linear or a sort."""
    try:
        limit = int(float(distance))
    except (TypeError, ValueError):
        return F.lit(False)
    if limit < 0 or not one or not two:
        return F.lit(False)
    text = content if case_sensitive else F.lower(content)

    def hits(listed: Column, starts: Column | None, term: str) -> Column:
        exact = term_indexes(content, listed, starts, term, case_sensitive, whole_word)
        if not fuzzy or parse_literal(term) or len(term) < LEAST:
            return exact
        close = fuzzy_indexes(listed, term if case_sensitive else term.lower())
        return let(exact, lambda e: F.when(F.size(e) > 0, e).otherwise(close))

    # even numbers: hits of the first term; odd: of the second. One fold over the sorted hits finds the nearest pair.
    far = -(1 << 29)

    def step(s: Column, x: Column) -> Column:
        i, second = F.floor(x / 2).cast("int"), x % 2 == 1
        a, b = F.when(second, s["a"]).otherwise(i), F.when(second, i).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"), (s["hit"] | (F.abs(a - b) <= limit)).alias("hit"))

    def test(listed: Column, starts: Column | None = None) -> Column:
        tagged = F.array_sort(F.concat(F.transform(hits(listed, starts, one), lambda i: i * 2), F.transform(hits(listed, starts, two), lambda i: i * 2 + 1)))
        start = F.struct(F.lit(far).alias("a"), F.lit(far).alias("b"), F.lit(False).alias("hit"))
        return F.aggregate(tagged, start, step, lambda s: s["hit"])

    if _plain(one) and _plain(two):
        found = let(words(text), test)
    else:
        base = content if parse_literal(one) or parse_literal(two) else text  # a pattern's places are those in the text as it is
        listed = lambda p: p["word"] if case_sensitive else F.transform(p["word"], F.lower)
        found = let(placed_words(base), lambda p: let(listed(p), lambda w: let(p["start"], lambda s: test(w, s))))
    # cheap tests first: a pattern or a term, or a word close to it, must stand in the text at all
    possible = F.length(content) >= LEAST_CONTENT
    for t in (one, two):
        literal = parse_literal(t)
        if literal:
            possible = possible & content.rlike(literal.java)
        else:
            same = t if case_sensitive else t.lower()
            held = text.contains(same)
            possible = possible & (held | has_close_word(text, same) if fuzzy and len(t) >= LEAST else held)
    return F.when(possible, found).otherwise(F.lit(False))
