"""Result exports: rows in four formats, path lists, copies of matched documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.functions import paths
from docsearch.sources import document, folders
from docsearch.sources.files import place, write_whole
from docsearch.sources.scratch import new_path, stored


def export_rows(results: DataFrame, docs: DataFrame) -> DataFrame:
    """file_path, status, details: the content of what matched, the error of what couldn't be read, else null.
    Only matched rows take part in the join with the contents."""
    status = F.when(F.col("read_error").isNotNull(), "Read Error").when(F.col("matched"), "Matched").otherwise("Not Matched")
    rows = results.select("file_path", status.alias("status"), "read_error")
    content = docs.select("file_path", F.col("content").alias("_content"), F.lit(True).alias("_there"))
    wanted = rows.withColumn("_key", F.when(F.col("status") == "Matched", F.col("file_path")))
    joined = wanted.join(content.withColumnRenamed("file_path", "_key"), "_key", "left")
    lost = (F.col("status") == "Matched") & F.col("_there").isNull()
    details = (
        F.when(lost, "fileNotFoundDuringRead")
        .when(F.col("status") == "Matched", F.col("_content"))
        .when(F.col("status") == "Read Error", F.concat(F.lit("Initial Read Error: "), "read_error"))
    )
    return joined.select("file_path", F.when(lost, "Read Error").otherwise(F.col("status")).alias("status"), details.alias("details"))


def csv_field(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), "").when(value.rlike('[,"\n]'), quoted).otherwise(value)


CSV_HEADER = "FilePath,Status,Details"


def csv_rows(exported: DataFrame, *keep: str) -> DataFrame:
    """One CSV record a row, in column value, after the columns ``keep``."""
    return exported.select(*keep, F.concat_ws(",", *(csv_field(F.col(c)) for c in ("file_path", "status", "details"))).alias("value"))


def json_rows(exported: DataFrame, *keep: str) -> DataFrame:
    """One JSON object a row, nulls written."""
    row = F.struct(F.col("file_path").alias("filePath"), "status", "details")
    return exported.select(*keep, F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def _shown() -> Column:
    return F.when(F.col("status") == "Read Error", F.concat(F.lit("Error: "), F.coalesce("details", F.lit("null")))).otherwise(F.coalesce("details", F.lit("No content.")))


def markdown_rows(exported: DataFrame, *keep: str) -> DataFrame:
    head = F.format_string("## %s (Status: %s)\n\n```\n", "file_path", "status")
    return exported.select(*keep, F.concat(head, _shown(), F.lit("\n```\n")).alias("value"))


def text_rows(exported: DataFrame, *keep: str) -> DataFrame:
    return exported.select(*keep, F.concat(F.format_string("%s (Status: %s)\n", "file_path", "status"), _shown(), F.lit("\n")).alias("value"))


#: What stands between two entries of a format when part files are put together.
SEPARATORS = {"csv": "\n", "json": ",\n", "markdown": "\n---\n\n", "txt": "\n" + "-" * 40 + "\n\n"}
ROWS = {"csv": csv_rows, "json": json_rows, "markdown": markdown_rows, "txt": text_rows}


def write(exported: DataFrame, kind: str, path: str) -> None:
    """Writes part files in parallel. CSV parts have a header each; JSON parts hold one object a line."""
    if kind == "csv":
        named = exported.select(F.col("file_path").alias("FilePath"), F.col("status").alias("Status"), F.col("details").alias("Details"))
        named.write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)
    elif kind == "json":
        exported.withColumnRenamed("file_path", "filePath").write.option("ignoreNullFields", False).mode("overwrite").json(path)
    else:
        ROWS[kind](exported).write.option("lineSep", SEPARATORS[kind]).mode("overwrite").text(path)


def path_list(results: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """The selected paths, or all without a selection."""
    rows = results.select("file_path")
    return rows if selected is None else rows.join(selected.select("file_path").distinct(), "file_path", "left_semi")


def named_copies(results: DataFrame, docs: DataFrame, conflict: str = "skip") -> DataFrame:
    """name, file_path, content of the matched documents as they are to be copied to one place: of several with one base name
    the first by path stays, or with ``conflict`` "replace" the last."""
    return _picked(results, docs, conflict).join(docs.select("file_path", "content"), "file_path").select("name", "file_path", "content")


def _picked(results: DataFrame, docs: DataFrame, conflict: str) -> DataFrame:
    """name, file_path of ``named_copies``, told from paths alone."""
    matched = docs.select("file_path").join(results.filter("matched").select("file_path"), "file_path", "left_semi")
    pick = F.min if conflict == "skip" else F.max
    return matched.groupBy(paths.base_name(F.col("file_path")).alias("name")).agg(pick("file_path").alias("file_path"))


#: What can become of a name in ``materialise``.
COPIED, SKIPPED, REPLACED, FAILED = "copied", "skipped", "replaced", "failed"
#: Files that a task of ``materialise`` writes.
PUT_FILES = 2000


def _put(folder: str):
    """Writes each row's content as a file of its name: under another name first, then moved, so a file is there as a whole or not at all and
    a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, top = place(folder)
        at.create_dir(top, recursive=True)
        made: set[str] = set()
        for b in batches:
            error = []
            for name, content in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    if "/" in name and name.rsplit("/", 1)[0] not in made:
                        made.add(name.rsplit("/", 1)[0])
                        at.create_dir(f"{top}/{name.rsplit('/', 1)[0]}", recursive=True)
                    write_whole(f"{folder}/{name}", (content or "").encode())
                    error.append(None)
                except OSError as e:
                    error.append(f"{name}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(error, pa.string())], ["name", "file_path", "there", "error"])

    return run


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes column content of ``rows`` as files of the names in column name (which may hold folders)."""
    given = rows.select("name", F.lit(None).cast("string").alias("file_path"), "content", F.lit(False).alias("there"))
    path = new_path(rows.sparkSession)
    given.mapInArrow(_put(folder.rstrip("/")), "name string, file_path string, there boolean, error string").filter("error is not null").write.parquet(path)
    lost = rows.sparkSession.read.schema("error string").parquet(path).limit(3).collect()
    if lost:
        raise OSError(f"not all files could be written: {'; '.join(r.error for r in lost)}")


def materialise(results: DataFrame, docs: DataFrame, folder: str, conflict: str = "skip") -> DataFrame:
    """Copies the matched documents into ``folder``, a file for each base name, and returns name, file_path, outcome, error of all of them.

    Each name is settled for itself against what the folder held before: with "skip" it stays as it is, with "replace" it is
    written anew; names that the results don't have aren't touched. Names are settled without the contents, and files are dealt to tasks by
    their number, as writing one costs more than its bytes. A name that can't be written is a row with its error. Run again
    after a loss, "replace" gives the same files, and "skip" writes those that are missing."""
    if conflict not in ("skip", "replace"):
        raise ValueError("a conflict is settled by skip or replace")
    spark, folder = docs.sparkSession, folder.rstrip("/")
    listed = folders.files(spark, folder, content=False).filter("depth = 1").select(paths.base_name(F.col("file_path")).alias("name"))
    path = new_path(spark)
    before = listed.distinct()
    before.write.parquet(f"{path}/before")  # what the folder holds now, not what it will hold when a task reads this again
    before = spark.read.schema(before.schema).parquet(f"{path}/before").withColumn("there", F.lit(True))
    named = stored(_picked(results, docs, conflict).join(before, "name", "left").select("name", "file_path", F.coalesce("there", F.lit(False)).alias("there")))
    stays = F.col("there") if conflict == "skip" else F.lit(False)
    written = named.filter(~stays)
    tasks = max(1, -(-written.count() // PUT_FILES))
    texts = written.join(docs.select("file_path", "content"), "file_path").select("name", "file_path", "content", "there").repartition(tasks)
    done = texts.mapInArrow(_put(folder), "name string, file_path string, there boolean, error string")
    outcome = F.when(F.col("error").isNotNull(), FAILED).when(F.col("there"), REPLACED).otherwise(COPIED)
    rows = done.select("name", "file_path", outcome.alias("outcome"), "error")
    rows.write.parquet(f"{path}/outcome")  # the copying happens here, once
    kept = named.filter(stays).join(docs.select("file_path"), "file_path").select("name", "file_path", F.lit(SKIPPED).alias("outcome"), F.lit(None).cast("string").alias("error"))
    return spark.read.schema(rows.schema).parquet(f"{path}/outcome").unionByName(kept)


def entries(exported: DataFrame, kind: str) -> DataFrame:
    """file_path and value: an entry of the one document of a kind for each row."""
    if kind == "json":
        text = lambda c: F.coalesce(F.expr(f"substring(to_json(struct({c} as v)), 6, length(to_json(struct({c} as v))) - 6)"), F.lit("null"))
        shown = lambda c: F.when(F.col(c).isNull(), "null").otherwise(text(c))
        fields = [F.concat(F.lit(f'    "{n}": '), shown(c)) for n, c in (("filePath", "file_path"), ("status", "status"), ("details", "details"))]
        return exported.select("file_path", F.concat(F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }")).alias("value"))
    return ROWS[kind](exported.withColumn("_path", F.col("file_path")), "_path").withColumnRenamed("_path", "file_path")


#: Head, text of an empty document, and tail of each kind.
FRAMES = {"csv": (CSV_HEADER + "\n", CSV_HEADER, ""), "json": ("[\n", "[]", "\n]"), "markdown": ("", "", ""), "txt": ("", "", "")}


def write_document(exported: DataFrame, kind: str, path: str) -> None:
    """Writes all rows as one file in the order of file_path: CSV with one header, a JSON array, Markdown or text with separators."""
    head, empty, tail = FRAMES[kind]
    document.write(entries(exported, kind), path, ["file_path"], head=head, empty=empty, between=SEPARATORS[kind], tail=tail)
