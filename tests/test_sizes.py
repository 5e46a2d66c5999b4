"""What steps shuffle, hold at once and deal to tasks, on small tables."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from docsearch.operators import duplicates, many_terms, tokens
from docsearch.sources import document, export, folders, ranges


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_documents_are_cut_by_keys_and_not_by_texts(spark):
    rows = spark.createDataFrame([(k // 20, f"{'x' * 20}{k % 7}{k}") for k in range(200)], "key long, value string")
    some = document.dealt(rows, ["key"])
    cut = next(x for x in plan(some).splitlines() if "RepartitionByExpression" in x)
    assert "substring(value" in cut and cut.count("value#") == 1
    assert [r.value for r in some.collect()] == [r.value for r in sorted(rows.collect())]


def test_matches_of_few_texts_are_held_at_once():
    texts = ["ab " * 5000] * 100 + ["ab" * many_terms.STEP_BYTES, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "content"])
    parts = list(many_terms._parts([batch.slice(0, 50), batch.slice(50)]))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= many_terms.STEP_BYTES for b in parts)


def test_duplicate_groups_shuffle_digests(spark, monkeypatch):
    texts = [f"{'text ' * 300}{k % 12}" if k % 2 else f"own {k}" for k in range(60)] + [None, None, "", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    few = {tuple(r) for r in duplicates.duplicate_groups(docs).collect()}
    plans, kept = [], duplicates.stored
    monkeypatch.setattr(duplicates, "stored", lambda df: plans.append(plan(df)) or kept(df))
    monkeypatch.setattr(duplicates, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in duplicates.duplicate_groups(docs).collect()} == few and len(few) == 32
    joined = [p.split("Join LeftSemi", 1)[1].splitlines()[1] for p in plans if "Join LeftSemi" in p]
    assert joined and all("sha2" in side and "Project" in side for side in joined)


def test_paths_are_fetched_by_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "FETCH_FILES", 3)
    for k in range(10):
        (tmp_path / f"{k}.txt").write_text(str(k))
    got = folders.fetch(spark, spark.createDataFrame([(f"{tmp_path}/{k}.txt",) for k in range(11)], "file_path string").coalesce(1))
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r.content, r.error) for r in got.collect() if r.content) == [(str(k), None) for k in range(10)] and got.count() == 11


def test_one_large_file_is_a_bounded_number_of_tasks(tmp_path):
    (tmp_path / "all.txt").write_bytes(b"x" * 300_001)
    parts = ranges.RangeReader({"roots": json.dumps([str(tmp_path)]), "size": "10", "overlap": "2", "task_bytes": "10"}).partitions()
    assert len(parts) <= ranges.MOST_TASKS and sum(p.ranges for p in parts) == 30_001
    assert all(a.first + a.ranges == b.first for a, b in zip(parts[:-1], parts[1:], strict=True))


def test_boundaries_shuffle_no_places(spark, monkeypatch):
    rows = [(1, "one two x three"), (2, "Ünder_score  été"), (None, "ab cd"), (3, None), (4, ""), (5, "ab cd")]
    expected = lambda docs: sorted(map(str, tokens.tokens(docs).select("doc_id", F.explode(F.array("start", F.col("end") + 1)).alias("pos")).distinct().collect()))
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    got = tokens.boundary_positions(docs)
    assert sorted(map(str, got.collect())) == expected(docs) and "Aggregate" not in plan(got) and "Join" not in plan(got)
    again = docs.unionByName(docs).unionByName(spark.createDataFrame([(1, "one more text"), (9, "last one")], docs.schema))
    assert sorted(map(str, tokens.boundary_positions(again).collect())) == expected(again)
    monkeypatch.setattr(tokens, "REPEATED_KEYS", 1)
    assert sorted(map(str, tokens.boundary_positions(again).collect())) == expected(again)


def test_copies_are_dealt_by_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "PUT_FILES", 2)
    docs = spark.createDataFrame([(f"/c/{k}.txt", f"text {k}") for k in range(10)], "file_path string, content string").coalesce(1)
    done = export.materialise(docs.select("file_path", F.lit(True).alias("matched")), docs, f"{tmp_path}/out", "replace")
    assert {r.outcome for r in done.collect()} == {"copied"} and done.count() == 10
    assert len([x for x in done.inputFiles() if "/outcome/" in x]) == 5
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == [f"{k}.txt" for k in range(10)]
