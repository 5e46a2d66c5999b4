"""Places of matches, lines, highlights and chunks. Offsets are code points from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.functions.arrays import let, running_sums
from docsearch.functions.patterns import AFTER_WORD, BEFORE_WORD, QueryError, quote


def _period(term: str) -> int:
    """The least distance at which the term can begin again."""
    return next(p for p in range(1, len(term) + 1) if term.startswith(term[p:]))


def _in_text(content: Column, term: str, case_sensitive: bool, whole_word: bool, found: Callable[[Column, str, int], Column], nothing: Column) -> Column:
    """``found(text, pattern, taken)`` where the text that is searched, made once, holds the term at all, else ``nothing``. The pattern takes
    the letters up to where the term can begin again (``taken``) and looks at the rest, so overlapping occurrences are all met."""
    text, t = (content, term) if case_sensitive else (F.lower(content), term.lower())
    if not term:
        return nothing
    n = _period(t)
    rest = (f"(?=\\Q{t[n:]}\\E{AFTER_WORD if whole_word else ''})" if t[n:] else AFTER_WORD if whole_word else "")
    pattern = f"{BEFORE_WORD if whole_word else ''}\\Q{t[:n]}\\E{rest}"
    return F.coalesce(let(text, lambda x: F.when(x.contains(t), found(x, pattern, n))), nothing)


def positions(content: Column, term: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """Starts of the term, overlapping ones too (aba in abababa: 0, 2, 4): what stands between them, and what the pattern takes, add up."""

    def found(text: Column, pattern: str, taken: int) -> Column:
        def places(parts: Column) -> Column:
            after = F.slice(running_sums(F.transform(parts, lambda p: F.length(p) + taken)), 2, F.size(parts) - 1)
            return F.transform(after, lambda s: (s - taken).cast("int"))

        return let(F.split(text, pattern, -1), places)

    return _in_text(content, term, case_sensitive, whole_word, found, F.array().cast("array<int>"))


def regex_positions(content: Column, pattern: str) -> Column:
    """Starts of successive matches: gaps and matches alternate, so a match begins after all before it. Patterns that match
    the empty string are refused by ``check_positions``."""

    def places(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(content, pattern, -1), 1, F.size(hits)), lambda g: F.length(g))

        def starts(g: Column) -> Column:
            before = running_sums(F.zip_with(g, hits, lambda n, m: n + F.length(m)))
            return F.zip_with(F.slice(before, 1, F.size(g)), g, lambda b, n: (b + n).cast("int"))

        return let(gaps, starts)

    return F.when(content.rlike(pattern), let(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), places)).otherwise(F.array().cast("array<int>"))


def check_positions(spark, pattern: str) -> None:
    if spark.range(1).select(F.lit("").rlike(pattern)).first()[0]:
        raise QueryError("a pattern that matches the empty string has no places")


def match_count(content: Column, term: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """The number of ``positions``, without the places themselves."""
    return _in_text(content, term, case_sensitive, whole_word, lambda text, pattern, _: F.regexp_count(text, F.lit(pattern)), F.lit(0))


def _placed_lines(content: Column) -> Column:
    """line_no (from 0), line and start of every line."""

    def placed(parts: Column) -> Column:
        offsets = running_sums(F.transform(parts, lambda p: F.length(p) + 1))
        return let(offsets, lambda o: F.transform(parts, lambda p, i: F.struct(i.alias("line_no"), p.alias("line"), F.get(o, i).cast("int").alias("start"))))

    return let(F.split(content, "\n"), placed)


def lines(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """key, line_no (from 0), line, start of every line."""
    return docs.filter(F.col(content).isNotNull()).select(key, F.explode(_placed_lines(F.col(content))).alias("l")).select(key, "l.line_no", "l.line", "l.start")


def matched_lines(docs: DataFrame, predicate, key: str = "doc_id", content: str = "content", most: int = 10_000) -> DataFrame:
    """The first ``most`` lines of each document that ``predicate`` (Column -> Column) accepts. The limit is a feature of the
    operator; lines are numbered inside the document's own array, so no document is shuffled."""
    good = F.slice(F.filter(_placed_lines(F.col(content)), lambda x: F.coalesce(predicate(x["line"]), F.lit(False))), 1, most)
    return docs.filter(F.col(content).isNotNull()).select(key, F.explode(good).alias("l")).select(key, "l.line_no", "l.line", "l.start")


def _alternation(terms: list[str]) -> str:
    """One group for all terms, the longest first, so that at one place the longest wins."""
    return "(" + "|".join(quote(t) for t in sorted(dict.fromkeys(terms), key=lambda t: (-len(t), t))) + ")"


def highlight(content: Column, terms: list[str], case_sensitive: bool = False) -> Column:
    """Matches between <mark> and </mark>; the earliest start wins, and overlapping matches are passed over."""
    return F.regexp_replace(content, ("" if case_sensitive else "(?i)") + _alternation(terms), "<mark>$1</mark>")


def highlight_spans(content: Column, terms: list[str], case_sensitive: bool = False) -> Column:
    """The same matches as an array of (start, end, term), the end exclusive."""
    pattern = ("" if case_sensitive else "(?i)") + _alternation(terms)
    hits = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    return F.zip_with(regex_positions(content, pattern), hits, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("term")))


#: Comments, declarations, scripts and styles with what they hold, and tags; a > in a quoted attribute doesn't end a tag.
_MARKUP = r"""<!--[\s\S]*?-->|<[!?][^>]*>|<(?i:script)[\s>][\s\S]*?</(?i:script)[^>]*>|<(?i:style)[\s>][\s\S]*?</(?i:style)[^>]*>|</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*+>"""


def highlight_html(html: Column, terms: list[str], case_sensitive: bool = False) -> Column:
    """Marks in text nodes only, never in tags, comments, scripts or styles. In each text node the first of ``terms`` that it holds is
    marked, wherever it stands, and the others are not."""
    way = "" if case_sensitive else "(?i)"

    def node(text: Column) -> Column:
        out = text
        for t in reversed([t for t in terms if t]):
            out = F.when(text.rlike(way + quote(t)), F.regexp_replace(text, f"{way}({quote(t)})", "<mark>$1</mark>")).otherwise(out)
        return out

    tags = F.regexp_extract_all(html, F.lit(_MARKUP), F.lit(0))
    return F.array_join(F.zip_with(F.split(html, _MARKUP, -1), tags, lambda text, tag: F.concat(node(text), F.coalesce(tag, F.lit("")))), "")


def _pieces(content: Column, size: int) -> Column:
    """The text cut into pieces of ``size`` characters, in one pass."""
    return F.regexp_extract_all(content, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunks(docs: DataFrame, size: int = 64 << 10, overlap: int = 1 << 10, key: str = "doc_id", content: str = "content") -> DataFrame:
    """key, chunk_no, start, chunk: pieces of ``size`` characters of which each shares ``overlap`` with the next. The text is cut once; a
    chunk is a piece and what it shares of those behind it."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the size")
    step = size - overlap
    more = 1 + -(-overlap // step)
    whole = lambda p: F.transform(p, lambda _, i: F.substring(F.array_join(F.slice(p, i + 1, F.lit(more)), ""), 1, size))
    each = docs.filter(F.length(content) > 0).select(key, F.posexplode(let(_pieces(F.col(content), step), whole)).alias("chunk_no", "chunk"))
    return each.select(key, "chunk_no", (F.col("chunk_no") * step).alias("start"), "chunk")


def chunk_flags(docs: DataFrame, predicate: Callable[[Column], Column], size: int = 64 << 10, overlap: int = 1 << 10, key: str = "doc_id", content: str = "content") -> DataFrame:
    """``chunks`` with matched in place of the text: whether ``predicate`` accepts the chunk by itself. A term no longer than the overlap
    is in some chunk exactly if it is in the text."""
    return chunks(docs, size, overlap, key, content).select(key, "chunk_no", "start", predicate(F.col("chunk")).alias("matched"))


def line_safe_chunks(docs: DataFrame, size: int = 64 << 10, radius: int = 1000, key: str = "doc_id", content: str = "content") -> DataFrame:
    """key, chunk_no, start, chunk: pieces of about ``size`` characters. Each multiple of ``size`` is moved to the nearest begin of a
    line at most ``radius`` characters away, to the earlier of two as near; where there is none, the line is cut. So no piece is
    longer than size + 2 * radius. The text is cut once, at the multiples; what a border moves by goes over to the neighbour."""
    if not 0 <= 2 * radius < size:
        raise ValueError("twice the radius is smaller than the size")

    def moves(pieces: Column) -> Column:
        def move(piece: Column, k: Column) -> Column:
            back = F.instr(F.reverse(F.right(F.get(pieces, k - 1), F.lit(radius))), "\n") - 1
            ahead = F.instr(F.left(piece, F.lit(radius)), "\n")
            return F.when(k == 0, 0).when((back >= 0) & ((ahead == 0) | (back <= ahead)), -back).when(ahead > 0, ahead).otherwise(0)

        return F.transform(pieces, move)

    def spans(pieces: Column) -> Column:
        def of(by: Column) -> Column:
            def span(piece: Column, k: Column) -> Column:
                here, there = F.get(by, k), F.coalesce(F.get(by, k + 1), F.lit(0))
                own = F.substring(piece, F.greatest(here, F.lit(0)) + 1, F.length(piece) + F.least(there, F.lit(0)) - F.greatest(here, F.lit(0)))
                before = F.when(here < 0, F.right(F.get(pieces, k - 1), -here)).otherwise("")
                after = F.when(there > 0, F.left(F.get(pieces, k + 1), there)).otherwise("")
                return F.struct((k * size + here).alias("start"), F.concat(before, own, after).alias("chunk"))

            return F.filter(F.transform(pieces, span), lambda s: s["chunk"] != "")  # a border that moved to the end of the text is none

        return let(moves(pieces), of)

    each = docs.filter(F.length(content) > 0).select(key, F.posexplode(let(_pieces(F.col(content), size), spans)).alias("chunk_no", "s"))
    return each.select(key, "chunk_no", "s.start", "s.chunk")


def whole_word_at(content: Column, at: Column, length: int) -> Column:
    """Whether the ``length`` characters at a place have word borders on both sides."""
    word = "^[A-Za-z0-9_]$"
    before, after = F.substring(content, at, F.lit(1)), F.substring(content, at + length + 1, F.lit(1))
    return ~(F.when(at > 0, before.rlike(word)).otherwise(F.lit(False)) | after.rlike(word))


def positions_table(docs: DataFrame, places: Column, key: str = "doc_id") -> DataFrame:
    """key, pos of an array of places."""
    return docs.select(key, F.explode(places).alias("pos"))


