import datetime

import pytest
from pyspark.sql import functions as F

from docsearch.functions import paths, patterns, text
from docsearch.operators import filters


def check(spark, value, test):
    return spark.range(1).select(test(F.lit(value))).first()[0]


@pytest.mark.parametrize(
    ("path", "test", "kept"),
    [
        ("/path/to/file.txt", lambda p: filters.ext_in(p, ["txt", ".md"]), True),
        ("/path/to/file.TXT", lambda p: filters.ext_in(p, ["txt"]), False),
        ("/path/to/file", lambda p: filters.ext_in(p, []), True),
        ("test.log", lambda p: ~filters.file_excluded(p, ["*.log"]), False),
        ("test123.tmp", lambda p: ~filters.file_excluded(p, [r"/test\d+\.tmp/"]), False),
        ("important.txt", lambda p: ~filters.file_excluded(p, ["*.log", "*.tmp", "config.*"]), True),
        ("/a/.env", lambda p: ~filters.file_excluded(p, ["*env"]), False),
        ("/path/to/node_modules/package", lambda p: ~filters.folder_excluded(p, ["node_modules"]), False),
        ("/path/to/temp_folder", lambda p: ~filters.folder_excluded(p, ["temp"], "startsWith"), False),
        ("/path/to/old_backup", lambda p: ~filters.folder_excluded(p, ["backup"], "endsWith"), False),
        ("/path/to/dist", lambda p: ~filters.folder_excluded(p, ["dist"], "exact"), False),
        ("/path/to/distance", lambda p: ~filters.folder_excluded(p, ["dist"], "exact"), True),
        ("/path/to/deeply/nested/file.txt", lambda p: filters.within_depth(p, "/path", 3), False),
        ("/path/to/file.txt", lambda p: filters.within_depth(p, "/path", 3), True),
        ("/path/to/a/b/c/file.txt", lambda p: filters.within_depth(p, "/path", 0), True),
    ],
)
def test_paths(spark, path, test, kept):
    assert check(spark, path, test) is kept


@pytest.mark.parametrize(("size", "kept"), [(1024, True), (3072, False), (500, True), (2048, True), (None, True)])
def test_sizes(spark, size, kept):
    assert check(spark, size, lambda s: filters.size_between(s.cast("long"), 500, 2048)) is kept


@pytest.mark.parametrize(("day", "kept"), [("2023-01-15", True), ("2023-02-15", False), ("2023-01-31T00:00:00", True), ("2023-01-31T00:00:01", False), (None, True)])
def test_times(spark, day, kept):
    when = None if day is None else datetime.datetime.fromisoformat(day)
    assert check(spark, when, lambda t: filters.modified_between(t.cast("timestamp"), "2023-01-01", "2023-01-31")) is kept


def test_bad_arguments():
    with pytest.raises(ValueError):
        filters.size_between(F, 5, 4)
    with pytest.raises(ValueError):
        filters.folder_excluded(F, ["a"], "around")


def test_relevant_errors(spark):
    rows = [("/r", "/r/node_modules", "m", "EPERM"), ("/r", "/r/src", "m", "EPERM"), ("/r", "/r/node_modules", "m", "ENOENT"), ("/node_modules", "/node_modules", "m", "EPERM")]
    df = spark.createDataFrame(rows, "search_path string, error_path string, message string, code string")
    assert {(r.search_path, r.error_path, r.code) for r in filters.relevant_errors(df, ["node_modules"]).collect()} == {("/r", "/r/src", "EPERM"), ("/r", "/r/node_modules", "ENOENT"), ("/node_modules", "/node_modules", "EPERM")}


def test_size_units_and_lists(spark):
    assert [text.size_to_bytes(v, u) for v, u in ((1, "KB"), (2.5, "MB"), (-1, "KB"), (float("nan"), "MB"), (None, "GB"))] == [1024, 2621440, None, None, None]
    assert check(spark, " a, b\n\n,c ", text.split_and_clean) == ["a", "b", "c"]


@pytest.mark.parametrize(("value", "shown"), [(0, "0 Bytes"), (500, "500 Bytes"), (1536, "1.5 KB"), (1048576, "1 MB"), (123456789, "117.74 MB")])
def test_format_file_size(spark, value, shown):
    assert check(spark, value, text.format_file_size) == shown


@pytest.mark.parametrize(("value", "shown"), [(850, "850ms"), (12_345, "12s"), (185_000, "3m 5s"), (3_607_000, "1h 0m 7s")])
def test_format_duration(spark, value, shown):
    assert check(spark, value, text.format_duration) == shown


@pytest.mark.parametrize(("value", "number"), [("1.27 ms", 1.27), ("-3 ms", 0.0), ("none", 0.0), ("0.74 MB", 0.74), ("1.2.3", 0.0)])
def test_leading_number(spark, value, number):
    assert check(spark, value, text.leading_number) == number


def test_path_parts(spark):
    f = F.lit("/a/b.c/Name.tar.GZ")
    got = spark.range(1).select(paths.extension(f), paths.base_name(f), paths.stem(f), paths.directory(f), paths.relative(f, "/a"), paths.language(F.lit("/x/a.PY")), paths.language(F.lit("/x/Makefile")), paths.language(F.lit("x.zzz"))).first()
    assert tuple(got) == ("gz", "Name.tar.GZ", "Name.tar", "/a/b.c", "b.c/Name.tar.GZ", "python", "makefile", "plaintext")
    assert check(spark, "a\\b\\c", paths.normalised) == "a/b/c"


def test_patterns(spark):
    assert patterns.parse_literal("/a+/gig").java == "(?i)a+"
    assert patterns.parse_literal("a/b/") is None
    assert patterns.is_valid_regex(spark, "/a(b)?/i") and not patterns.is_valid_regex(spark, "a(b")
    assert patterns.regex_from_pattern("a.b", literal=True, case_sensitive=True) == r"a\.b"
    assert [patterns.unquoted(x) for x in ('"a"', "'a'", '"', "a")] == ["a", "'a'", '"', "a"]


def test_snippets_and_lines(spark):
    f = F.lit("one\r\ntwo three\nfour")
    got = spark.range(1).select(text.snippet(f, F.lit(5), 3, 4), text.line_number(f, F.lit(5)), text.column_number(f, F.lit(9)), text.truncate(f, 8), text.preview(f, 3), text.first_lines(f, 1)).first()
    assert tuple(got) == ("...ne\r\ntwo thr...", 2, 5, "one\r\n...", "one...", "one\r")
