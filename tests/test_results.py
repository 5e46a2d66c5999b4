import datetime
import json
import random
import time

from pyspark.sql import functions as F

from docsearch.operators import fuzzy, history, results, telemetry
from docsearch.sources import corpus, export

RESULTS = "file_path string, matched boolean, read_error string, size long, mtime timestamp"


def rows(spark):
    t = datetime.datetime(2024, 1, 1)
    data = [("/r/file1.txt", True, None, 1024, t), ("/r/file2.md", False, None, 2048, t), ("/r/subfolder/file3.js", True, None, 512, None), ("/r/subfolder/bad.bin", False, "fileTooLarge:9", None, None)]
    return spark.createDataFrame(data, RESULTS)


def docs(spark):
    return spark.createDataFrame([("/r/file1.txt", 'a "b", c'), ("/r/file2.md", "x"), ("/r/subfolder/file3.js", "t\nest")], "file_path string, content string")


def test_sort_and_summary(spark):
    r = rows(spark)
    paths = lambda df: [x.file_path.rsplit("/", 1)[1] for x in df.collect()]
    assert paths(results.sort_results(r, "size")) == ["file3.js", "file1.txt", "file2.md", "bad.bin"]
    assert paths(results.sort_results(r, "size", True)) == ["bad.bin", "file2.md", "file1.txt", "file3.js"]
    assert paths(results.limit(r, 2, "matched", True)) == ["file1.txt", "file3.js"]
    assert tuple(results.summary(r).first()) == (4, 3, 2, 1)


def test_tree(spark):
    r = rows(spark)
    assert {tuple(x) for x in results.directory_rollup(r).collect()} == {("/r", True, 4, 2), ("/r/subfolder", True, 2, 1)}
    edges = {(x.parent, x.path) for x in results.tree_edges(r).collect()}
    assert (None, "/r") in edges and ("/r", "/r/subfolder") in edges and ("/r/subfolder", "/r/subfolder/file3.js") in edges and len(edges) == 6


def test_selection(spark):
    r = rows(spark)
    one, two = r.filter("matched"), r.filter("size > 600")
    names = lambda df: sorted(x.file_path[-8:] for x in df.collect())
    assert names(results.toggle(one, two)) == names(r.filter("matched <> coalesce(size > 600, false)"))
    assert names(results.deselect(one, two)) == ["file3.js"[-8:]]
    assert results.selected_or_all(r, one.filter("false")).count() == 4


def test_exports(spark, tmp_path):
    e = export.export_rows(rows(spark), docs(spark))
    got = {x.file_path: (x.status, x.details) for x in e.collect()}
    assert got["/r/file2.md"] == ("Not Matched", None) and got["/r/subfolder/bad.bin"] == ("Read Error", "Initial Read Error: fileTooLarge:9")
    csv = {x.value for x in export.csv_rows(e).collect()}
    assert '/r/file1.txt,Matched,"a ""b"", c"' in csv and "/r/file2.md,Not Matched," in csv
    assert json.loads(export.json_rows(e.filter("status = 'Not Matched'")).first().value) == {"filePath": "/r/file2.md", "status": "Not Matched", "details": None}
    assert export.markdown_rows(e.filter("status = 'Not Matched'")).first().value == "## /r/file2.md (Status: Not Matched)\n\n```\nNo content.\n```\n"
    assert export.text_rows(e.filter("status = 'Read Error'")).first().value == "/r/subfolder/bad.bin (Status: Read Error)\nError: Initial Read Error: fileTooLarge:9\n"
    for kind in ("csv", "json", "markdown", "txt"):
        export.write(e, kind, str(tmp_path / kind))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 4
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    lost = export.export_rows(rows(spark), docs(spark).filter("file_path <> '/r/file1.txt'"))
    assert lost.filter("file_path = '/r/file1.txt'").first().details == "fileNotFoundDuringRead"
    export.materialise(rows(spark), docs(spark), str(tmp_path / "copies"))
    assert {x.name for x in (tmp_path / "copies").iterdir()} == {"file1.txt", "file3.js"}
    assert export.path_list(rows(spark)).count() == 4


def test_scan(spark, tmp_path):
    for name, body in (("a.txt", "one\ntwo"), ("b/c.md", "three"), ("b/d/e.txt", "four"), ("b/f.log", "")):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    root = str(tmp_path / "root")
    found = {x.file_path.rsplit("/", 1)[1]: (x.size, x.content) for x in corpus.scan(spark, root).collect()}
    assert found["a.txt"] == (7, "one\ntwo") and found["e.txt"] == (4, "four") and "f.log" not in found  # empty
    assert corpus.scan(spark, root, ["txt", ".md"], 2).count() == 2
    assert corpus.scan_many(spark, [root, root + "/b"]).count() == 3
    small = corpus.with_read_status(corpus.scan(spark, root), 5)
    assert small.filter("read_error is not null and content is null").count() == 1
    wanted = spark.createDataFrame([("/r/file2.md",), ("/r/none",)], "file_path string")
    assert {tuple(x) for x in corpus.fetch_content(wanted, docs(spark)).collect()} == {("/r/file2.md", "x", None), ("/r/none", None, "fileNotFoundDuringRead")}


def test_telemetry(spark):
    ops = spark.createDataFrame([("a", 10.0, 1, 5.0), ("a", 30.0, 2, -5.0), ("b", 60.0, 3, -9.0)], "name string, duration double, id long, memory_delta double").withColumn("ts", F.timestamp_seconds("id"))
    assert [tuple(r) for r in telemetry.op_summary(ops).collect()] == [("b", 60.0, 1, 60.0, 60.0), ("a", 40.0, 2, 20.0, 40.0)]
    assert {tuple(r) for r in telemetry.hot_ops(telemetry.op_totals(ops)).collect()} == {("a", "share"), ("b", "share"), ("b", "slow")}
    assert [tuple(r) for r in telemetry.memory_by_op(ops).collect()] == [("b", -9.0)]
    c = {r.name: (r.before, r.after, r.change, r.side) for r in telemetry.compare(ops.filter("name = 'a'"), ops).collect()}
    assert c == {"a": (20.0, 20.0, 0.0, "both"), "b": (None, 60.0, None, "after")}
    points = ops.select(F.lit("k").alias("key"), (F.col("ts") + F.expr("make_dt_interval(1)") * F.col("id")).alias("ts"), "id", (F.col("duration") / 70).alias("ratio"))
    assert [(r.id, r.level) for r in telemetry.level_changes(points).orderBy("id").collect()] == [(1, "low"), (3, "high")]
    m = telemetry.line_metrics(spark.createDataFrame([(1, "/a/x.py", "# c\n\n code\n  // d"), (2, "/a/y.py", None)], "doc_id long, file_path string, content string"))
    assert tuple(m.filter("doc_id = 1").first())[2:] == (4, 1, 2, 1)


def entry(spark, data):
    fields = [*history.ARRAYS, *history.VALUES, "structured_query"]
    rows = [(i, datetime.datetime.fromtimestamp(t), name, fav, tuple(params.get(f) for f in fields)) for i, t, name, fav, params in data]
    return spark.createDataFrame(rows, f"id string, ts timestamp, name string, is_favorite boolean, params {history.PARAMS}")


def test_history(spark):
    h = entry(
        spark,
        [
            ("a", 100, "first", True, {"extensions": ["x", "y"], "content_search_term": "Q", "structured_query": "1"}),
            ("b", 300, None, None, {"extensions": ["y", "x"], "content_search_term": "Q", "structured_query": "2"}),
            ("c", 200, None, None, {"extensions": ["y"], "content_search_term": "Q"}),
        ],
    )
    d = {r.id: (r.ts.timestamp(), r.name, r.is_favorite) for r in history.dedupe(h).collect()}
    assert d == {"a": (300.0, "first", True), "c": (200.0, None, None)}
    assert [r.id for r in history.order(h).collect()] == ["a", "b", "c"]
    assert [r.id for r in history.cap(h, 2).collect()] == ["b", "c"]
    assert {r.id for r in history.search(h, "FIRST").collect()} == {"a"}
    patched = history.update(h, spark.createDataFrame([("c", "new", None)], "id string, name string, is_favorite boolean"))
    assert {(r.id, r.name, r.is_favorite) for r in patched.collect()} == {("a", "first", True), ("b", None, None), ("c", "new", None)}


def test_line_metrics_equal_a_plain_count(spark):
    rng = random.Random(8)
    parts = ["", " ", "\t", "code", "  // x", "#", " * y", "/* z", "\r", "a # b", "\x0b\f", " #", "\x85", "-- no"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(400)] + ["", "\n", "\n\n", " " * 300_000 + "x", None]
    rows = spark.createDataFrame([(i, f"/d/f{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, file_path string, content string")
    began = time.time()
    got = {r.doc_id: (r.total, r.blank, r.comment, r.code) for r in telemetry.line_metrics(rows).collect()}
    assert time.time() - began < 30
    for i, t in enumerate(texts):
        if t is not None:
            lines = [x.strip(" \t\n\x0b\f\r") for x in t.split("\n")]
            blank, comment = lines.count(""), sum(x.startswith(("//", "/*", "*", "#")) for x in lines)
            assert got[i] == (len(lines), blank, comment, len(lines) - blank - comment), repr(t)


def test_close_words_are_those_of_the_rule(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abé_1") for _ in range(n))
    texts = ["".join(rng.choice(["(", "-", " ", ".", word(rng.randint(1, 8))]) for _ in range(12)) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")
    for term in ("abé_a", "(ab)", "aba", "b1é_ab1", "ab-ba"):
        rule = F.exists(fuzzy.words(F.col("content")), lambda w: fuzzy.close(w, term))  # noqa: B023
        got = rows.select(rule.alias("a"), fuzzy.fuzzy_term(F.col("content"), term, case_sensitive=True).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got], term
