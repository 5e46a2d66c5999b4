"""Folder listings with failures, reads with causes, copies to a folder, one-file exports, byte ranges and duplicate groups."""

import errno
import hashlib
import json
import os
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from docsearch.operators import duplicates
from docsearch.operators.filters import relevant_errors
from docsearch.plans.query import Term
from docsearch.sources import document, export, folders, ranges
from docsearch.sources.files import place

# --- listings -------------------------------------------------------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    names = {".env": "KEY=1", "_x.txt": "under", "empty.txt": "", "a/b/c.TXT": "deep é", "a/b/.git/config": "x", "a/big.md": "y" * 1000, "a/no_end": "z"}
    for name, content in names.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    return tmp_path, names


def test_hidden_and_empty_files_have_rows(spark, tree):
    root, names = tree
    got = {os.path.relpath(r.file_path, root): r for r in folders.files(spark, f"file://{root}").collect()}
    assert set(got) == set(names)
    for name, r in got.items():
        assert (r.size, r.content, r.read_error, r.depth) == (len(names[name].encode()), names[name], None, name.count("/") + 1) and r.mtime is not None
    assert {n: r.ext for n, r in got.items()} == {".env": "", "_x.txt": "txt", "empty.txt": "txt", "a/b/c.TXT": "txt", "a/b/.git/config": "", "a/big.md": "md", "a/no_end": ""}


def test_filters_reach_the_listing(spark, tree):
    root, _ = tree
    some = folders.files(spark, str(root)).filter((F.col("ext") == "txt") & (F.col("size") < 100) & (F.col("depth") <= 1))
    plan = some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "simple")
    assert "Filter (" not in plan and "folder_files" in plan
    assert sorted(os.path.basename(r.file_path) for r in some.collect()) == ["_x.txt", "empty.txt"]
    late = folders.files(spark, str(root)).filter(F.col("mtime") > F.lit("2100-01-01").cast("timestamp"))
    assert late.count() == 0
    reader = folders.Reader({"roots": json.dumps([str(root)])})
    assert list(reader.pushFilters([folders.ds.LessThanOrEqual(("depth",), 1), folders.ds.StringContains(("file_path",), "x")])) == [folders.ds.StringContains(("file_path",), "x")]
    seen = []
    list_one = reader._list
    reader._list = lambda *a: seen.append(a[2]) or list_one(*a)
    assert len(reader.listed()) == 3 and seen == [str(root)]  # folders below the depth aren't opened


def test_sizes_roots_and_tasks(spark, tree):
    root, names = tree
    rows = folders.files(spark, [str(root), f"{root}/a", f"{root}/gone", f"{root}/.env"], max_bytes=500)
    got = rows.collect()
    assert len(got) == len(names) + 1 == len({r.file_path for r in got})
    by = {os.path.relpath(r.file_path, root): r for r in got}
    assert (by["a/big.md"].read_error, by["a/big.md"].content) == ("fileTooLarge:1000", None)
    assert (by["gone"].read_error, by["gone"].code, by["gone"].size) == ("fileNotFoundDuringRead", "ENOENT", None)
    parts = folders.Reader({"roots": json.dumps([str(root)]), "task_bytes": str(150 << 10)}).partitions()
    assert len(parts) == 3 and sorted(len(p.files) for p in parts) == [2, 2, 3]
    errors = folders.path_errors(rows)
    assert [tuple(r) for r in errors.select("search_path", "error_path", "code").collect()] == [(f"{root}/gone", f"{root}/gone", "ENOENT")]


class Locked:
    """A file system whose folders named locked refuse everything, in front of the local one."""

    def __init__(self):
        self.local = fs.LocalFileSystem()

    def get_file_info(self, what):
        if isinstance(what, fs.FileSelector) and what.base_dir.endswith("locked"):
            raise PermissionError(errno.EACCES, "Permission denied")
        return self.local.get_file_info(what)

    def open_input_stream(self, path, **options):
        if "secret" in path:
            raise PermissionError(errno.EPERM, "Operation not permitted")
        return self.local.open_input_stream(path, **options)


def test_a_folder_without_permission_is_a_row(spark, tmp_path, monkeypatch):
    (tmp_path / "node_modules" / "locked").mkdir(parents=True)
    for name in ("a.txt", "secret.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    monkeypatch.setattr(folders, "place", lambda path: (_locked, path))
    reader = folders.Reader({"roots": json.dumps([str(tmp_path)])})
    rows = {os.path.basename(r[1]): r for r in reader.listed()}
    assert set(rows) == {"a.txt", "secret.txt", "b.txt", "locked"}
    assert rows["locked"][7:9] == ("readPermissionDenied", "EACCES")
    os.remove(tmp_path / "b.txt")  # goes between listing and reading
    read = {os.path.basename(r[1]): reader._read(r) for r in rows.values() if r[4] is not None}
    assert {n: (r[6], r[7]) for n, r in read.items()} == {"a.txt": ("a.txt", None), "secret.txt": (None, "readPermissionDenied"), "b.txt": (None, "fileNotFoundDuringRead")}
    rows = [(str(tmp_path), r[1], r[9], "EPERM") for r in (*read.values(), rows["locked"]) if r[8]]
    errors = spark.createDataFrame(rows, "search_path string, error_path string, message string, code string")
    assert sorted(os.path.basename(r.error_path) for r in relevant_errors(errors, ["node_modules"]).collect()) == ["b.txt", "secret.txt"]


_locked = Locked()


def test_fetch_names_the_cause(spark, tree):
    root, _ = tree
    wanted = spark.createDataFrame([(f"{root}/.env",), (f"{root}/zzz",), (f"file://{root}/a",), (None,), ("",), ("odd://x/y",)], "file_path string")
    got = {r.file_path: (r.content, r.error) for r in folders.fetch(spark, wanted).collect()}
    assert got == {f"{root}/.env": ("KEY=1", None), f"{root}/zzz": (None, "fileNotFoundDuringRead"), f"file://{root}/a": (None, "pathIsDir"), None: (None, "noFilePath"), "": (None, "noFilePath"), "odd://x/y": (None, "readError")}


def test_file_scheme_forms():
    assert [place(p)[1] for p in ("/a/b", "file:/a/b", "file:///a/b")] == ["/a/b"] * 3


# --- copies and one-file exports ------------------------------------------------------------------------------------------------

RESULTS = "file_path string, matched boolean, read_error string"


def corpus(spark, rows):
    docs = spark.createDataFrame(rows, "file_path string, content string")
    return docs, docs.select("file_path", F.lit(True).alias("matched"), F.lit(None).cast("string").alias("read_error"))


def held(folder):
    return {p.name: p.read_text() for p in folder.iterdir()}


def test_conflicts_are_settled_name_by_name(spark, tmp_path):
    folder = tmp_path / "out"
    docs, r = corpus(spark, [("/x/a", "1"), ("/y/a", "2"), ("/x/b", "3")])
    first = export.materialise(r.filter("file_path = '/x/b'"), docs, str(folder))
    assert [tuple(x) for x in first.select("name", "outcome").collect()] == [("b", "copied")] and held(folder) == {"b": "3"}
    (folder / "b").write_text("own")
    (folder / "other").write_text("stays")
    out = export.materialise(r, docs, f"file://{folder}/")
    assert sorted(map(tuple, out.select("name", "file_path", "outcome").collect())) == [("a", "/x/a", "copied"), ("b", "/x/b", "skipped")]
    assert held(folder) == {"a": "1", "b": "own", "other": "stays"}
    out = export.materialise(r, docs, str(folder), "replace")
    assert sorted(map(tuple, out.select("name", "file_path", "outcome").collect())) == [("a", "/y/a", "replaced"), ("b", "/x/b", "replaced")]
    assert held(folder) == {"a": "2", "b": "3", "other": "stays"}
    (folder / "a").unlink()  # a task was lost after b: the next run does what is missing
    out = export.materialise(r, docs, str(folder))
    assert sorted(map(tuple, out.select("name", "outcome").collect())) == [("a", "copied"), ("b", "skipped")] and held(folder)["a"] == "1"
    with pytest.raises(ValueError):
        export.materialise(r, docs, str(folder), "ask")


def test_a_name_that_cannot_be_written_is_a_row(spark, tmp_path):
    (tmp_path / "a").mkdir()
    docs, r = corpus(spark, [("/x/a", "1"), ("/x/b", "3")])
    out = {x.name: x for x in export.materialise(r, docs, str(tmp_path), "replace").collect()}
    assert out["a"].outcome == "failed" and out["a"].error.startswith("a: ") and out["b"].outcome == "copied"


def test_documents_of_all_kinds(spark, tmp_path):
    rows = [("/b.txt", "Matched", 'say "hi",\nyou'), ("/a.txt", "Not Matched", None), ("/c é.txt", "Read Error", "fileTooLarge:9"), ("/d.txt", "Matched", "tab\tand \\ é")]
    exported = spark.createDataFrame(rows, "file_path string, status string, details string").repartition(3)
    rows.sort()
    for kind in ("csv", "json", "markdown", "txt"):
        export.write_document(exported, kind, f"{tmp_path}/{kind}")
    text = (tmp_path / "json").read_text()
    assert text == json.dumps([dict(zip(("filePath", "status", "details"), r, strict=True)) for r in rows], indent=2, ensure_ascii=False)
    assert (tmp_path / "csv").read_text() == 'FilePath,Status,Details\n/a.txt,Not Matched,\n/b.txt,Matched,"say ""hi"",\nyou"\n/c é.txt,Read Error,fileTooLarge:9\n/d.txt,Matched,tab\tand \\ é'
    shown = [f"Error: {d}" if s == "Read Error" else d or "No content." for _, s, d in rows]
    assert (tmp_path / "markdown").read_text() == "\n---\n\n".join(f"## {p} (Status: {s})\n\n```\n{d}\n```\n" for (p, s, _), d in zip(rows, shown, strict=True))
    assert (tmp_path / "txt").read_text() == ("\n" + "-" * 40 + "\n\n").join(f"{p} (Status: {s})\n{d}\n" for (p, s, _), d in zip(rows, shown, strict=True))
    told = document.described(exported, f"{tmp_path}/json").collect()[0]
    assert tuple(told) == (4, len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(n for k in ("csv", "json", "markdown", "txt") for n in (k, f"{k}.json"))  # no parts left
    none = exported.limit(0)
    for kind, want in (("csv", "FilePath,Status,Details"), ("json", "[]"), ("markdown", ""), ("txt", "")):
        export.write_document(none, kind, f"{tmp_path}/none.{kind}")
        assert (tmp_path / f"none.{kind}").read_text() == want


def test_parts_of_lost_tasks_do_not_count(tmp_path):
    import pyarrow as pa

    w = document.Writer({"path": f"{tmp_path}/doc", "between": "\n"}, False)
    batch = lambda *v: pa.RecordBatch.from_arrays([pa.array(v, pa.string())], ["value"])

    class At:
        def __init__(self, k):
            self.k = k

        def partitionId(self):  # noqa: N802
            return self.k

    old, document.TaskContext = document.TaskContext, type("T", (), {"get": staticmethod(lambda: At(number))})
    try:
        number = 1
        w.write(iter([batch("lost")]))
        b = w.write(iter([batch("c", None, "d")]))
        number = 0
        a = w.write(iter([batch("a"), batch("b")]))
        number = 2
        c = w.write(iter([]))
    finally:
        document.TaskContext = old
    w.commit([b, c, a, None])
    assert (tmp_path / "doc").read_text() == "a\nb\nc\nd"
    with pytest.raises(FileExistsError):
        w.commit([a])


# --- byte ranges ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [5, 7, 64])
def test_ranges_own_every_character_once(size):
    text = "aé𝄞b\n" * 40 + "é"
    data, out = text.encode(), []
    for k in range(-(-len(data) // size)):
        begin = k * size
        lead = min(4, begin)
        before, own, chunk = ranges.cut_range(data[begin - lead : begin + size + 4 * 6 + 4], lead, size, 6)
        at = sum(len(c) for c in out)
        assert chunk == text[at : at + own + 6] and before == text[max(0, at - 1) : at]
        out.append(chunk[:own])
    assert "".join(out) == text


def test_places_and_flags_of_one_file(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choice(["test", "é", " ", "a", "tes", "\n", "𝄞", "x"]) for _ in range(4000))
    (tmp_path / "one.txt").write_text(text)
    rows = ranges.ranges(spark, str(tmp_path), size=97, overlap=8, task_bytes=1000)
    assert rows.rdd.getNumPartitions() > 5
    want = [i for i in range(len(text)) if text.startswith("test", i)]
    assert sorted(r.pos for r in ranges.places(rows, "test", 8).collect()) == want
    import re

    whole = [m.start() for m in re.finditer(r"(?<![A-Za-z0-9_])test(?![A-Za-z0-9_])", text)]
    assert sorted(r.pos for r in ranges.places(rows, "test", 8, whole_word=True).collect()) == whole
    assert ranges.flags(rows, Term("testtest")).filter("matched").count() > 0
    assert ranges.ranges(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        ranges.places(rows, "x" * 8, 8)


# --- duplicates -----------------------------------------------------------------------------------------------------------------


def test_groups_equal_exact_grouping(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(n)) for n in (0, 3, 999, 1000, 2500, 5000)]
    texts = [t for t in base for _ in range(rng.randint(1, 4))] + ["hot " * 600] * 300 + [None, None, "alone"]
    texts += [t[:600] + "#" + t[601:] for t in base if len(t) > 2400]  # alike in all that is sampled
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    of = {}
    for i, t in enumerate(texts):
        of.setdefault(t, []).append(i)
    want = {(i, g[0], len(g)) for t, g in of.items() if t is not None and len(g) > 1 for i in g}
    assert {tuple(r) for r in duplicates.duplicate_groups(docs).collect()} == want
    same = duplicates.duplicate_groups(docs, sample=F.lit("one bucket"))
    assert {tuple(r) for r in same.collect()} == want
    assert duplicates.duplicate_groups(docs.limit(0)).collect() == []
