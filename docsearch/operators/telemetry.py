"""Summaries of line counts and of telemetry: tables of named operations with durations and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsearch.functions import paths


def line_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, file_path, total, blank, comment and code lines. Comment lines begin, after white space, with //, /*, * or #."""
    text, blanks = F.col("content"), r"[ \t\x0b\f\r]*+"
    total = F.regexp_count(text, F.lit("\n")) + 1
    # (?d): a line feed alone ends a line; ^ doesn't stand at the end of a text, so an empty last line is added
    blank = F.regexp_count(text, F.lit(rf"(?md)^{blanks}$")) + F.when((text == "") | text.endswith("\n"), 1).otherwise(0)
    comment = F.regexp_count(text, F.lit(rf"(?md)^{blanks}(?://|/\*|\*|#)"))
    out = docs.select("doc_id", "file_path", total.cast("long").alias("total"), blank.cast("long").alias("blank"), comment.cast("long").alias("comment"))
    return out.withColumn("code", F.col("total") - F.col("blank") - F.col("comment"))


def _sums() -> list[Column]:
    return [F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("total", "blank", "comment", "code"))]


def line_metrics_by_extension(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(paths.extension(F.col("file_path")).alias("ext")).agg(*_sums()).orderBy(F.desc("code"), "ext")


def line_metrics_by_directory(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(paths.directory(F.col("file_path")).alias("directory")).agg(*_sums())


def line_metrics_total(metrics: DataFrame) -> DataFrame:
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) * 100.0 / F.col("total"))).otherwise(0).cast("long").alias(f"{c}_percent")
    return metrics.agg(*_sums()).select("*", share("blank"), share("comment"), share("code"))


def line_metrics_rollup(metrics: DataFrame) -> DataFrame:
    """By extension and in total (ext null) in one job."""
    return metrics.rollup(paths.extension(F.col("file_path")).alias("ext")).agg(*_sums())


def op_stats(ops: DataFrame) -> DataFrame:
    """name, calls, total, minimum, maximum of ``ops`` (name, duration)."""
    d = F.col("duration")
    return ops.groupBy("name").agg(F.count("*").alias("calls"), F.sum(d).alias("total"), F.min(d).alias("minimum"), F.max(d).alias("maximum"))


def op_totals(ops: DataFrame) -> DataFrame:
    """name, calls, total, average, percent of all. The whole is a scalar subquery over the same rows, so that any number of names
    stays distributed."""
    by = ops.groupBy("name").agg(F.sum("duration").alias("total"), F.count("*").alias("calls"), F.avg("duration").alias("average"))
    whole = ops.agg(F.sum("duration")).scalar()
    return by.withColumn("percent", F.when(whole != 0, F.col("total") * 100 / whole).otherwise(0.0))


def op_summary(ops: DataFrame, n: int = 10) -> DataFrame:
    """The n operations of the largest totals."""
    return op_totals(ops).orderBy(F.desc("total"), "name").limit(n)


def percent_of_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` (parent, id, duration) with the share of their parent's duration (id, duration)."""
    up = parents.select(F.col("id").alias("parent"), F.col("duration").alias("_whole"))
    share = F.when(F.col("_whole") != 0, F.col("duration") * 100 / F.col("_whole")).otherwise(0.0)
    return children.join(up, "parent").withColumn("percent", share).drop("_whole")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, before and after (averages), change in percent (0 if before is 0), side: both, before or after only."""
    b = before.groupBy("name").agg(F.avg("duration").alias("before"))
    a = after.groupBy("name").agg(F.avg("duration").alias("after"))
    change = F.when(F.col("before") == 0, 0.0).otherwise((F.col("after") - F.col("before")) / F.col("before") * 100)
    side = F.when(F.col("before").isNull(), "after").when(F.col("after").isNull(), "before").otherwise("both")
    return b.join(a, "name", "full_outer").select("name", "before", "after", change.alias("change"), side.alias("side"))


def overall_change(compared: DataFrame) -> DataFrame:
    """One row: the mean change of the names on both sides."""
    return compared.filter("side = 'both'").agg(F.avg("change").alias("overall_change"), F.count("*").alias("names"))


def compare_reports(reports: DataFrame, names: list[str], factor: float = 1.5, fresh: float = 10.0) -> DataFrame:
    """``reports`` (report, name, percent) side by side: one column for each of the two or more report ``names``, 0 where absent,
    and flag by the first and the last: new, slower, faster or none."""
    wide = reports.groupBy("name").pivot("report", names).agg(F.max("percent")).fillna(0.0, names)
    first, last = F.col(f"`{names[0]}`"), F.col(f"`{names[-1]}`")
    flag = F.when((first == 0) & (last > fresh), "new").when((first > 0) & (last > first * factor), "slower").when((last > 0) & (first > last * factor), "faster").otherwise("none")
    return wide.withColumn("flag", flag)


def hot_ops(totals: DataFrame, percent: float = 20, average: float = 50, calls: int = 1000) -> DataFrame:
    """name, reason for each way in which an operation stands out."""
    tags = F.array_compact(F.array(F.when(F.col("percent") > percent, "share"), F.when(F.col("average") > average, "slow"), F.when(F.col("calls") > calls, "frequent")))
    return totals.select("name", F.explode(tags).alias("reason"))


def content_size_stats(docs: DataFrame) -> DataFrame:
    n = F.length("content")
    return docs.agg(F.sum(n).alias("total"), F.count(n).alias("docs"), F.min(n).alias("minimum"), F.max(n).alias("maximum"), F.avg(n).alias("average"))


def memory_by_op(ops: DataFrame, n: int = 10) -> DataFrame:
    """The n largest sums of memory_delta by absolute value, zeros left out."""
    return ops.groupBy("name").agg(F.sum("memory_delta").alias("memory")).filter("memory <> 0").orderBy(F.desc(F.abs("memory")), "name").limit(n)


def complexity(functions: DataFrame, high: float = 10) -> DataFrame:
    """file, functions, mean, total, high_count of ``functions`` (file, function, value)."""
    v = F.col("value")
    return functions.groupBy("file").agg(F.count("*").alias("functions"), F.avg(v).alias("mean"), F.sum(v).alias("total"), F.count_if(v >= high).alias("high_count"))


def latest_of_frequent(ops: DataFrame, n: int = 100, most: int = 5) -> DataFrame:
    """The newest n points (ties by id) of each of the ``most`` most frequent operations. Rows beyond n are dropped before the
    shuffle as well (Spark keeps the first n of each group in every partition)."""
    top = ops.groupBy("name").agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), "name").limit(most).select("name")
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.desc("ts"), F.desc("id")))
    return ops.join(F.broadcast(top), "name", "left_semi").withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def newest(points: DataFrame, n: int = 1000) -> DataFrame:
    return points.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def level(ratio: Column) -> Column:
    return F.when(ratio >= 0.85, "high").when(ratio >= 0.70, "medium").otherwise("low")


def level_changes(points: DataFrame) -> DataFrame:
    """key, ts, id, ratio, level, and what other columns there are, of the points whose level differs from that of the point before
    (the first one counts).
    A series is cut into days, so a key with most of the points is many window groups; the last level of each day, a small table,
    leads over to the next."""
    rows = points.withColumns({"level": level(F.col("ratio")), "_day": F.to_date("ts")})
    last = rows.groupBy("key", "_day").agg(F.max_by("level", F.struct("ts", "id")).alias("_end"))
    before = last.select("key", "_day", F.lag("_end").over(W.partitionBy("key").orderBy("_day")).alias("_before"))
    inside = F.lag("level").over(W.partitionBy("key", "_day").orderBy("ts", "id"))
    joined = rows.withColumn("_last", inside).join(before, ["key", "_day"]).withColumn("_last", F.coalesce("_last", "_before"))
    return joined.filter(F.col("_last").isNull() | (F.col("_last") != F.col("level"))).select("key", "ts", "id", "ratio", "level", *(n for n in points.columns if n not in ("key", "ts", "id", "ratio", "level")))
