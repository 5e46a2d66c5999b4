"""Result sets: sorting, limits, summaries, directory trees, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.functions import paths


def sort_key(key: str) -> Column:
    return {"path": F.lower("file_path"), "size": F.col("size"), "mtime": F.col("mtime"), "matched": F.coalesce("matched", F.lit(False)) & F.col("read_error").isNull()}[key]


def sort_results(results: DataFrame, key: str = "path", descending: bool = False) -> DataFrame:
    """Missing values stand last in ascending and first in descending order; ties go by path."""
    k = sort_key(key)
    return results.orderBy(k.desc_nulls_first() if descending else k.asc_nulls_last(), F.asc("file_path"))


def limit(results: DataFrame, n: int, key: str = "path", descending: bool = False) -> DataFrame:
    """The first n in order, taken from each partition first."""
    return sort_results(results, key, descending).limit(n)


def summary(results: DataFrame) -> DataFrame:
    """One row: files found, processed (read without error), matched, errors."""
    bad = F.col("read_error").isNotNull()
    return results.agg(
        F.count("*").alias("files_found"),
        F.count_if(~bad).alias("files_processed"),
        F.count_if(F.coalesce(F.col("matched"), F.lit(False)) & ~bad).alias("files_matched"),
        F.count_if(bad).alias("errors"),
    )


def _ancestors(path: Column) -> Column:
    """All directories above a path, the root / left out."""
    parts = F.split(path, "/")
    steps = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.filter(F.transform(steps, lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda d: d != "")


def directory_rollup(results: DataFrame) -> DataFrame:
    """directory, matched (of any file below), files, matched_files of every directory above a file. Counts are added up before
    rows are shuffled, so a directory with most of the files is no hot spot."""
    hit = F.coalesce(F.col("matched"), F.lit(False))
    rows = results.select(F.explode(_ancestors(F.col("file_path"))).alias("directory"), hit.alias("_m"))
    return rows.groupBy("directory").agg(F.max("_m").alias("matched"), F.count("*").alias("files"), F.count_if("_m").alias("matched_files"))


def tree_edges(results: DataFrame) -> DataFrame:
    """parent, path, is_directory of every file and directory; the parent of a root is null."""
    nodes = results.select(F.explode(F.concat(F.transform(_ancestors(F.col("file_path")), lambda d: F.struct(d.alias("path"), F.lit(True).alias("is_directory"))), F.array(F.struct(F.col("file_path").alias("path"), F.lit(False).alias("is_directory"))))).alias("n"))
    above = F.nullif(paths.directory(F.col("n.path")), F.lit(""))
    return nodes.select(above.alias("parent"), "n.path", "n.is_directory").distinct()


def selected_or_all(results: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected rows, or all if the selection is empty."""
    return results if selected.isEmpty() else results.join(selected.select("file_path").distinct(), "file_path", "left_semi")


def select_all(selection: DataFrame, more: DataFrame) -> DataFrame:
    return selection.select("file_path").union(more.select("file_path")).distinct()


def deselect(selection: DataFrame, gone: DataFrame) -> DataFrame:
    return selection.select("file_path").distinct().join(gone.select("file_path"), "file_path", "left_anti")


def toggle(selection: DataFrame, other: DataFrame) -> DataFrame:
    """Paths in one of the two, but not in both: one pass over their union."""
    both = selection.select("file_path").distinct().withColumn("_n", F.lit(1)).union(other.select("file_path").distinct().withColumn("_n", F.lit(1)))
    return both.groupBy("file_path").agg(F.sum("_n").alias("_n")).filter("_n = 1").select("file_path")
