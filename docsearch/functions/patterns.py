"""Patterns: globs, regex literals, whole words. All of this runs on the driver and yields Java regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: A word character of the search language, and ASCII whole-word borders. \b is not used: Java's is Unicode-aware.
WORD = "[A-Za-z0-9_]"
BEFORE_WORD, AFTER_WORD = f"(?<!{WORD})", f"(?!{WORD})"


class QueryError(ValueError):
    """A query that can't be run, such as an invalid pattern."""


def quote(text: str) -> str:
    """``text`` as a literal part of a Java or RE2 pattern."""
    return re.sub(r"([\\.\[\]{}()*+?^$|/-])", r"\\\1", text).replace("\n", r"\n").replace("\t", r"\t").replace("\r", r"\r")


def glob_to_regex(glob: str) -> str:
    """An anchored pattern for one path segment: * any run, ? one character, [..] a class, {a,b} alternatives."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inner = glob[i + 1 : end]
            inner = "^" + inner[1:] if inner[:1] in "!^" else inner
            out.append("[" + inner.replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(quote(c))
        i += 1
    return "^" + "".join(out) + ")" * depth + "$"


@dataclass(frozen=True)
class Literal:
    """A /pattern/flags literal. g, u and y have no effect on a test; i, m and s do."""

    pattern: str
    flags: str = ""

    @property
    def java(self) -> str:
        on = "".join(f for f in "ims" if f in self.flags)
        return (f"(?{on})" if on else "") + self.pattern


def parse_literal(text: str) -> Literal | None:
    """The literal in ``text``, or None if it isn't one. Repeated flags count once."""
    m = re.fullmatch(r"/(.+)/([gimsuy]*)", text, re.DOTALL)
    return Literal(m[1], "".join(dict.fromkeys(m[2]))) if m else None


def unquoted(text: str, marks: str = '"') -> str:
    """``text`` without one pair of the same quotation mark around it."""
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in marks else text


def is_valid_regex(spark: SparkSession, pattern: str) -> bool:
    """Whether Java accepts the pattern; a /literal/ is judged by what is between the slashes."""
    literal = parse_literal(pattern)
    try:
        spark.range(1).select(F.lit("").rlike(literal.java if literal else pattern)).collect()
    except PySparkException:
        return False
    return True


def regex_from_pattern(pattern: str, case_sensitive: bool = False, whole_word: bool = False, literal: bool = False) -> str:
    """A Java pattern from plain text (``literal``) or a pattern or /literal/, which keeps its own flags."""
    given = None if literal else parse_literal(pattern)
    if given:
        return given.java
    body = quote(pattern) if literal else pattern
    body = f"{BEFORE_WORD}(?:{body}){AFTER_WORD}" if whole_word else body
    return body if case_sensitive else f"(?i){body}"
