"""Filters on paths, times and sizes. Each gives a Column; all are plain expressions that Catalyst pushes to the scan."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.functions import paths
from docsearch.functions.patterns import glob_to_regex, parse_literal


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def ext_in(path: Column, extensions: list[str]) -> Column:
    """The extension is listed (a leading dot is optional, case counts); an empty list lets everything pass."""
    if not extensions:
        return F.lit(True)
    return F.regexp_extract(paths.base_name(path), r"\.([^./]+)$", 1).isin([e.lstrip(".") for e in extensions])


def file_excluded(path: Column, patterns: list[str]) -> Column:
    """The base name matches a glob or a /regex/."""
    name = paths.base_name(path)
    tests = []
    for p in patterns:
        literal = parse_literal(p)
        tests.append(name.rlike(literal.java if literal else glob_to_regex(p)))
    return _any(tests)


MODES = ("contains", "exact", "startsWith", "endsWith")


def folder_excluded(folder: Column, patterns: list[str], mode: str = "contains") -> Column:
    """A segment of the directory ``folder`` matches, in any case. A pattern without wildcards is widened by the mode."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    tests = []
    for p in (x.lower() for x in patterns):
        if mode == "contains" and not any(c in p for c in "*?[{"):
            p = f"*{p}*"
        elif mode == "startsWith":
            p = f"{p}*"
        elif mode == "endsWith":
            p = f"*{p}"
        tests.append(glob_to_regex(p))
    if not tests:
        return F.lit(False)
    pattern = "|".join(f"(?:{t})" for t in tests)
    return F.exists(F.split(F.lower(folder), "/"), lambda s: s.rlike(pattern))


def within_depth(path: Column, root: str, depth: int | None) -> Column:
    """At most ``depth`` segments below the root, the file included; None or 0: any."""
    if not depth:
        return F.lit(True)
    return F.size(F.split(paths.relative(path, root), "/")) <= depth


def _instant(when: str | datetime.datetime | None) -> Column | None:
    return None if when is None else F.lit(when).cast("timestamp")


def modified_between(mtime: Column, after: str | datetime.datetime | None = None, before: str | datetime.datetime | None = None) -> Column:
    """Both ends belong to the range. A plain date is its midnight (session time zone UTC). Rows without a time pass."""
    low, high = _instant(after), _instant(before)
    test = F.lit(True)
    if low is not None:
        test = test & (mtime >= low)
    if high is not None:
        test = test & (mtime <= high)
    return mtime.isNull() | test


def size_between(size: Column, least: int | None = None, most: int | None = None) -> Column:
    """Both ends belong to the range. Rows without a size pass."""
    if least is not None and most is not None and least > most:
        raise ValueError("the least size is above the greatest")
    test = F.lit(True)
    if least is not None:
        test = test & (size >= least)
    if most is not None:
        test = test & (size <= most)
    return size.isNull() | test


def matched_only(results: DataFrame, has_query: bool) -> DataFrame:
    """With a content query the matched rows, else all."""
    return results.filter("matched") if has_query else results


def relevant_errors(errors: DataFrame, excluded: list[str], mode: str = "contains") -> DataFrame:
    """Errors without those of code EPERM in excluded folders; errors of a root itself stay. ``errors``: search_path, error_path,
    message, code."""
    hidden = (F.col("code") == "EPERM") & (F.col("error_path") != F.col("search_path")) & folder_excluded(F.col("error_path"), excluded, mode)
    return errors.filter(~F.coalesce(hidden, F.lit(False)))
