"""The query language: trees of terms, patterns, proximity and boolean groups, compiled to one boolean Column.

Trees are given as objects or as nested dicts:
{"operator": "AND", "conditions": [{"type": "term", "value": "a"}, {"type": "near", "term1": "b", "term2": "c", "distance": 5}]}.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch.functions.patterns import AFTER_WORD, BEFORE_WORD, Literal, QueryError, is_valid_regex, parse_literal, unquoted
from docsearch.operators.fuzzy import LEAST, fuzzy_term
from docsearch.operators.near import near


@dataclass(frozen=True)
class Term:
    """``case_sensitive`` None: as the settings say. Quotes around the value are taken off; a /literal/ is a pattern."""

    value: str
    case_sensitive: bool | None = None


@dataclass(frozen=True)
class Regex:
    value: str
    flags: str = ""


@dataclass(frozen=True)
class Near:
    term1: str
    term2: str
    distance: int | str


@dataclass(frozen=True)
class Matcher:
    """A user's own test, Column -> Column (a pandas UDF counts as such)."""

    test: Callable[[Column], Column]


@dataclass(frozen=True)
class Not:
    condition: Node


@dataclass(frozen=True)
class Group:
    operator: str
    conditions: Sequence[Node] = field(default_factory=tuple)


Node = Term | Regex | Near | Matcher | Not | Group


@dataclass(frozen=True)
class Settings:
    case_sensitive: bool = False
    fuzzy_terms: bool = True
    fuzzy_near: bool = True
    whole_word: bool = False


def all_of(*conditions: Node) -> Group:
    return Group("AND", conditions)


def any_of(*conditions: Node) -> Group:
    return Group("OR", conditions)


def from_dict(tree: dict | Node) -> Node:
    """A tree from nested dicts, checked."""
    if not isinstance(tree, dict):
        return tree
    if "operator" in tree:
        op = str(tree["operator"]).upper()
        kids = [from_dict(c) for c in tree.get("conditions", ())]
        if op == "NOT":
            if len(kids) != 1:
                raise QueryError("NOT takes one condition")
            return Not(kids[0])
        if op not in ("AND", "OR"):
            raise QueryError(f"unknown operator {op}")
        return Group(op, tuple(kids))
    kind = tree.get("type")
    if kind == "term":
        return Term(tree.get("value", ""), tree.get("caseSensitive"))
    if kind == "regex":
        return Regex(tree.get("value", ""), tree.get("flags", ""))
    if kind == "near":
        if not all(k in tree for k in ("term1", "term2", "distance")):
            raise QueryError("near takes two terms and a distance")
        return Near(tree["term1"], tree["term2"], tree["distance"])
    raise QueryError(f"unknown condition {kind}")


def simplify(tree: Node | dict | None) -> Node | None:
    """Without empty conditions and empty groups; a group of one is its condition. None: nothing is asked."""
    node = from_dict(tree) if tree is not None else None
    if isinstance(node, Group):
        kids = [k for k in map(simplify, node.conditions) if k is not None]
        return None if not kids else kids[0] if len(kids) == 1 else Group(node.operator.upper(), tuple(kids))
    if isinstance(node, Not):
        inner = simplify(node.condition)
        return None if inner is None else Not(inner)
    if isinstance(node, (Term, Regex)):
        return node if node.value.strip() else None
    if isinstance(node, Near):
        return node if node.term1 and node.term2 else None
    return node


def term(content: Column, value: str, case_sensitive: bool = False, whole_word: bool = False, fuzzy: bool = False) -> Column:
    """Substring or whole word; with ``fuzzy`` close words count where there is no exact hit."""
    text, t = (content, value) if case_sensitive else (F.lower(content), value.lower())
    exact = text.rlike(f"{BEFORE_WORD}\\Q{t}\\E{AFTER_WORD}") if whole_word else text.contains(t)
    if not fuzzy or len(t) < LEAST:
        return exact
    return F.when(exact, F.lit(True)).otherwise(fuzzy_term(content, value, case_sensitive, whole_word))


def regex(content: Column, pattern: str, case_sensitive: bool = False) -> Column:
    return content.rlike(pattern if case_sensitive else f"(?i){pattern}")


def compile_query(tree: Node | dict | None, content: Column | str = "content", settings: Settings = Settings()) -> Column:
    """The tree as one Column that is true or false, never null: null contents match nothing, and NOT negates that."""
    c = F.col(content) if isinstance(content, str) else content

    def build(node: Node) -> Column:
        if isinstance(node, Group):
            parts = [build(k) for k in node.conditions]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if node.operator == "AND" else out | p
            return out
        if isinstance(node, Not):
            return ~build(node.condition)
        if isinstance(node, Matcher):
            test = node.test(c)
        elif isinstance(node, Regex):
            test = c.rlike(Literal(node.value, node.flags).java)
        elif isinstance(node, Near):
            test = near(c, unquoted(node.term1, "\"'"), unquoted(node.term2, "\"'"), node.distance, settings.case_sensitive, settings.whole_word, settings.fuzzy_near)
        else:
            literal = parse_literal(node.value)
            if literal:
                test = c.rlike(literal.java)
            else:
                case = settings.case_sensitive if node.case_sensitive is None else node.case_sensitive
                test = term(c, unquoted(node.value, "\"'"), case, settings.whole_word, settings.fuzzy_terms)
        return F.coalesce(test, F.lit(False))

    node = simplify(tree)
    return F.lit(True) if node is None else build(node)


def check(spark: SparkSession, tree: Node | dict | None) -> None:
    """Raises QueryError for patterns that Java refuses, before any document is read."""

    def patterns(node: Node | None):
        if isinstance(node, Group):
            for k in node.conditions:
                yield from patterns(k)
        elif isinstance(node, Not):
            yield from patterns(node.condition)
        elif isinstance(node, Regex):
            yield Literal(node.value, node.flags).java
        elif isinstance(node, (Term, Near)):
            for v in (node.value,) if isinstance(node, Term) else (node.term1, node.term2):
                if literal := parse_literal(v):
                    yield literal.java

    for p in patterns(simplify(tree)):
        if not is_valid_regex(spark, p):
            raise QueryError(f"invalid pattern: {p}")


def query_terms(tree: Node | dict | None) -> list[str]:
    """The distinct terms of a query, in order, for highlighting: without quotes, a ``Term:`` before them and AND/OR/NOT words;
    patterns as /literals/."""
    out: list[str] = []

    def visit(node: Node | None) -> None:
        if isinstance(node, Group):
            for k in node.conditions:
                visit(k)
        elif isinstance(node, Not):
            visit(node.condition)
        elif isinstance(node, Regex):
            out.append(f"/{node.value}/{node.flags}")
        elif isinstance(node, Near):
            out.extend((node.term1, node.term2))
        elif isinstance(node, Term):
            out.append(node.value)

    visit(simplify(tree))
    cleaned = [unquoted(t.strip().removeprefix("Term:").strip(), "\"'") for t in out]
    return list(dict.fromkeys(t for t in cleaned if t and t.upper() not in ("AND", "OR", "NOT")))


def search(docs: DataFrame, tree: Node | dict | None, settings: Settings = Settings(), content: str = "content") -> DataFrame:
    """``docs`` with matched; a query that can't be run raises QueryError. Nothing but the content column decides."""
    check(docs.sparkSession, tree)
    return docs.withColumn("matched", compile_query(tree, content, settings))
