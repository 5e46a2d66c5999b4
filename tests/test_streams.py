from pyspark.sql import functions as F

from docsearch.operators import telemetry
from docsearch.plans.query import Near, Term, all_of, search
from docsearch.streaming import search as streaming

DOCS = [(i, f"alpha {'beta ' * (i % 4)}gamma {'delta' if i % 3 else 'alpha'}") for i in range(40)]


def written(spark, tmp_path, parts=3):
    df = spark.createDataFrame(DOCS, "doc_id long, content string")
    df.repartition(parts).write.parquet(str(tmp_path / "docs"))
    return df, str(tmp_path / "docs")


def test_stream_equals_batch(spark, tmp_path):
    df, folder = written(spark, tmp_path)
    tree = all_of(Term("delta"), Near("alpha", "gamma", 2))
    stream = streaming.stream_search(streaming.read_documents(spark, folder, df.schema, files_per_batch=1), tree)
    got = streaming.run_to_table(stream.filter("matched").select("doc_id"))
    assert {r[0] for r in got.collect()} == {r.doc_id for r in search(df, tree).filter("matched").collect()} != set()


def test_progress_and_listener(spark, tmp_path):
    df, folder = written(spark, tmp_path)
    stream = streaming.stream_search(streaming.read_documents(spark, folder, df.schema), Term("delta"))
    counts = {r.matched: r.documents for r in streaming.run_to_table(streaming.progress(stream), "complete").collect()}
    assert counts == {True: sum(i % 3 > 0 for i in range(40)), False: sum(i % 3 == 0 for i in range(40))}
    listener = streaming.ProgressListener()
    spark.streams.addListener(listener)
    try:
        streaming.run_to_table(streaming.observed(stream).select("doc_id"))
        for _ in range(50):
            if listener.status == "completed":
                break
            import time

            time.sleep(0.1)
        assert (listener.processed, listener.matched, listener.status) == (40, counts[True], "completed")
    finally:
        spark.streams.removeListener(listener)


def test_levels_and_stats(spark, tmp_path):
    ops = spark.range(60).select(F.col("id"), F.timestamp_seconds(F.col("id") * 4000).alias("ts"), F.concat(F.lit("op"), (F.col("id") % 3).cast("string")).alias("name"), ((F.col("id") * 37) % 100).cast("double").alias("duration"))
    ops.repartition(1).write.parquet(str(tmp_path / "ops"))
    source = lambda: streaming.read_documents(spark, str(tmp_path / "ops"), ops.schema)
    points = lambda df: df.select(F.col("name").alias("key"), "ts", "id", (F.col("duration") / 100).alias("ratio"))
    got = streaming.run_level_changes(points(source()))
    assert {(r.key, r.id, r.level) for r in got.collect()} == {(r.key, r.id, r.level) for r in telemetry.level_changes(points(ops)).collect()}
    stats = streaming.run_to_table(streaming.stream_op_stats(source()), "complete")
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, telemetry.op_stats(ops).collect()))
    windows = streaming.run_to_table(streaming.windowed_op_stats(source()), "append")
    assert windows.count() > 0


def test_levels_of_late_points(spark, tmp_path):
    """The same changes for one file, eight and forty, in any order, one file at a time; and after a batch that is run again."""
    import random

    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 2)}", i, rng.choice([0.1, 0.75, 0.9]), rng.randint(0, 20) * 20_000) for i in range(400)]
    points = spark.createDataFrame(rows, "key string, id long, ratio double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {(r.key, r.id, r.level) for r in telemetry.level_changes(points).collect()}
    assert 50 < len(want) < 400
    for parts in (1, 8, 40):
        folder = str(tmp_path / f"in{parts}")
        points.repartition(parts, F.rand(parts)).write.parquet(folder)
        stream = streaming.read_documents(spark, folder, points.schema, files_per_batch=1 if parts < 40 else 9)
        got = streaming.run_level_changes(stream, f"file://{tmp_path}/out{parts}")
        assert {(r.key, r.id, r.level) for r in got.collect()} == want
    changes = streaming.LevelChanges(spark, f"file://{tmp_path}/again")
    halves = [points.filter("id % 2 = 0"), points.filter("id % 2 = 1")]
    for number, half in ((0, halves[0]), (1, halves[1]), (1, halves[1]), (2, points.limit(0))):
        changes.step(half, number)
    assert {(r.key, r.id, r.level) for r in changes.read().collect()} == want
