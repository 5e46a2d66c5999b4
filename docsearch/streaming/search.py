"""The same searches on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from docsearch.operators.telemetry import level
from docsearch.plans.query import Node, Settings, check, compile_query
from docsearch.sources.scratch import new_path


def read_documents(spark: SparkSession, folder: str, schema, file_format: str = "parquet", files_per_batch: int | None = 8) -> DataFrame:
    """A stream of the files that arrive in a folder; ``files_per_batch`` None: all that are there in one batch."""
    reader = spark.readStream.format(file_format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def stream_search(stream: DataFrame, tree: Node | dict | None, settings: Settings = Settings(), content: str = "content") -> DataFrame:
    """``stream`` with matched. The query is one stateless Column, NEAR and fuzzy terms included, so batch and stream agree."""
    check(stream.sparkSession, tree)
    return stream.withColumn("matched", compile_query(tree, content, settings))


def progress(searched: DataFrame) -> DataFrame:
    """Running counts by matched; write in complete mode."""
    return searched.groupBy("matched").agg(F.count("*").alias("documents"))


def observed(searched: DataFrame, name: str = "search") -> DataFrame:
    """``searched`` with counts of each micro-batch for listeners."""
    return searched.observe(name, F.count(F.lit(1)).alias("processed"), F.count_if(F.col("matched")).alias("matched"))


class ProgressListener(StreamingQueryListener):
    """Adds up the observed counts of all batches."""

    def __init__(self, name: str = "search"):
        self.name, self.processed, self.matched, self.status = name, 0, 0, "pending"

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.status = "searching"

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.processed += row.processed
            self.matched += row.matched

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.status = "failed" if event.exception else "completed"


class LevelChanges:
    """Level changes of a stream of points (key, ts, id, ratio) that may come in any order, kept as tables below ``path``.

    Points are stored by day of ts. A batch works out the days anew that it has points of, whole days, however late: of each key in
    the day the points whose level differs from the one before (but for the day's first point, which depends on earlier days), and
    the day's edges (first point, last level). Of a day only the newest batch's rows count, so a batch that runs again after a loss
    writes over its own folder and changes nothing else. ``read`` puts the days together: a day's first point is a change if the last level
    of the key's day before differs; that is one window over the edges, a row for each key and day."""

    POINTS = "key string, ts timestamp, id long, ratio double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, columns: str) -> DataFrame:
        """A table of all batches; empty before the first."""
        schema = f"{columns}, batch long, day date"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*")

    def _put(self, rows: DataFrame, name: str, number: int) -> None:
        rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/{name}/batch={number}")  # a day is few files, a large one several

    def step(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch; for ``foreachBatch``. A batch without points writes empty tables."""
        self._put(batch.select("key", F.col("ts").cast("timestamp").alias("ts"), "id", "ratio", F.to_date("ts").alias("day")).filter("ts is not null"), "points", number)
        points = self._table("points", self.POINTS)
        days = points.filter(F.col("batch") == number).select("day").distinct()
        rows = points.filter(F.col("batch") <= number).join(F.broadcast(days), "day", "left_semi").withColumn("level", level(F.col("ratio")))
        in_day = W.partitionBy("key", "day").orderBy("ts", "id")
        rows = rows.withColumns({"_before": F.lag("level").over(in_day), "_n": F.row_number().over(in_day)})
        self._put(rows.filter((F.col("_n") > 1) & (F.col("_before") != F.col("level"))).select("key", "ts", "id", "ratio", "level", "day"), "inner", number)
        first = F.min_by(F.struct("ts", "id", "ratio", "level"), F.struct("ts", "id"))
        self._put(rows.groupBy("key", "day").agg(first.alias("first"), F.max_by("level", F.struct("ts", "id")).alias("last")), "edges", number)

    def read(self) -> DataFrame:
        """key, ts, id, ratio, level of all changes so far; a key's first point is one."""
        edges = self._table("edges", f"key string, first struct<{self.POINTS.removeprefix('key string, ').replace(' ', ':').replace(',:', ',')},level:string>, last string")
        newest = edges.groupBy("day").agg(F.max("batch").alias("batch"))
        edges = edges.join(F.broadcast(newest), ["day", "batch"])
        before = F.lag("last").over(W.partitionBy("key").orderBy("day"))
        begun = edges.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("first.level"))).select("key", "first.*")
        inner = self._table("inner", f"{self.POINTS}, level string").join(F.broadcast(newest), ["day", "batch"])
        return begun.unionByName(inner.select("key", "ts", "id", "ratio", "level"))


def run_level_changes(points: DataFrame, path: str | None = None) -> DataFrame:
    """Runs what is there of a stream of points (key, ts, id, ratio) through ``LevelChanges`` to its end: key, ts, id, ratio, level of the
    points whose level differs from that of the key's point before by (ts, id), whatever order they came in and in however many batches.
    With ``path`` the tables stay there, and a later run goes on from them."""
    spark = points.sparkSession
    path = path or new_path(spark)
    changes = LevelChanges(spark, path)
    points.writeStream.foreachBatch(changes.step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return changes.read()


def stream_op_stats(ops: DataFrame) -> DataFrame:
    """Running count, total, minimum and maximum for each operation; write in update or complete mode."""
    d = F.col("duration")
    return ops.groupBy("name").agg(F.count("*").alias("calls"), F.sum(d).alias("total"), F.min(d).alias("minimum"), F.max(d).alias("maximum"))


def windowed_op_stats(ops: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same for each window of time, with a watermark that bounds the state."""
    d = F.col("duration")
    by = ops.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "name")
    return by.agg(F.count("*").alias("calls"), F.sum(d).alias("total"), F.min(d).alias("minimum"), F.max(d).alias("maximum")).select(F.col("w.start").alias("start"), "name", "calls", "total", "minimum", "maximum")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs what is there through the stream into a table in the shared folder, and reads it. Rows that a stream adds go to the
    Parquet sink, with a checkpoint beside the table; of a result that is rewritten with every batch (complete mode) the last
    batch is the table. No row comes to the driver."""
    spark = stream.sparkSession
    path = new_path(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path).outputMode(mode)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).outputMode(mode)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
