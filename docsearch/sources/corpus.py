"""The document table, from files or from the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch.functions import paths

MAX_BYTES = 50 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file_path, size, mtime, content, lang, source over the documents table: every document gets a path and a time by
    rule. Columns that a query doesn't use are pruned down to the scan."""
    ext = F.element_at(F.array(*map(F.lit, ("txt", "md", "log", "json"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        name.alias("file_path"),
        F.octet_length("text").cast("long").alias("size"),
        (F.timestamp_add("HOUR", F.col("doc_id").cast("int"), start)).alias("mtime"),
        F.col("text").alias("content"),
        "lang",
        "source",
    )


def scan(spark: SparkSession, path: str | list[str], extensions: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """file_path, size, mtime, content of all files below ``path``. One extension or several become a glob of the file lister.
    Spark passes over names that begin with . or _ and over empty files. Depth counts the segments below the root; None or 0: any depth."""
    roots = [path] if isinstance(path, str) else list(path)
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if extensions:
        names = ",".join(e.lstrip(".") for e in extensions)
        read = read.option("pathGlobFilter", f"*.{{{names}}}")
    df = read.load(roots).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("value").alias("content"),
    )
    if max_depth:
        depth = F.lit(None).cast("int")
        for root in roots:
            plain = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/")
            below = F.regexp_replace("file_path", "^[a-z]+:/*", "/")
            inside = F.when(below.startswith(plain + "/"), F.size(F.split(paths.relative(below, plain), "/")))
            depth = F.coalesce(F.least(depth, inside), depth, inside)
        df = df.filter(depth <= max_depth)
    return df


def union_scans(parts: list[DataFrame]) -> DataFrame:
    """Scans of several roots together; a file that lies under two roots appears once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["file_path"])


def scan_many(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    return union_scans([scan(spark, r, **options) for r in roots])


def with_read_status(df: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows too large stay, with a read_error and without content."""
    large = F.coalesce(F.col("size") > max_bytes, F.lit(False))
    error = F.when(large, F.concat(F.lit("fileTooLarge:"), F.col("size").cast("string")))
    return df.withColumns({"read_error": error, "content": F.when(~large, F.col("content"))})


def limit_content(matched: Column, content: Column, n: int) -> tuple[Column, Column]:
    """(matched, error) where content longer than n characters is no match but an error."""
    long = F.coalesce(F.length(content) > n, F.lit(False))
    return ~long & matched, F.when(long, F.concat(F.lit("contentTooLong:"), F.length(content).cast("string")))


def fetch_content(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """file_path, content, error for each path in ``wanted``."""
    found = docs.select("file_path", "content", F.lit(True).alias("_there"))
    joined = wanted.select("file_path").join(found, "file_path", "left")
    return joined.select("file_path", "content", F.when(F.col("_there").isNull(), "fileNotFoundDuringRead").alias("error"))
