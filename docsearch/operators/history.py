"""The search history: a table of id, ts, name, is_favorite and params (a struct of the search parameters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAYS = ("search_paths", "extensions", "exclude_files", "exclude_folders")
VALUES = (
    "folder_exclusion_mode", "content_search_term", "content_search_mode", "case_sensitive", "modified_after", "modified_before",
    "min_size_bytes", "max_size_bytes", "max_depth",
)
PARAMS = "struct<" + ", ".join([*(f"{a}:array<string>" for a in ARRAYS), *(f"{v}:string" for v in VALUES), "structured_query:string"]) + ">"


def params_key(params: Column) -> Column:
    """Equal for equal parameters: arrays count as sets of entries in any order, null arrays as empty; the query tree is left out."""
    arrays = [F.array_sort(F.coalesce(params[a], F.array().cast("array<string>"))).alias(a) for a in ARRAYS]
    return F.sha2(F.to_json(F.struct(*arrays, *(params[v].alias(v) for v in VALUES))), 256)


def dedupe(history: DataFrame) -> DataFrame:
    """One entry for each set of parameters: id, name and favourite of the oldest, the newest time. Only the two extremes of a group
    are kept while it is added up, so a search repeated without end is no hot spot."""
    first = F.min(F.struct("ts", "id", "name", "is_favorite", "params")).alias("f")
    grouped = history.withColumn("_key", params_key(F.col("params"))).groupBy("_key").agg(first, F.max("ts").alias("_last"))
    return grouped.select("f.id", F.col("_last").alias("ts"), "f.name", "f.is_favorite", "f.params")


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Two de-duplicated tables as one: an entry that is stored keeps its id, name and favourite and takes the newer time. Loads come in
    the order of time, so what is stored is older."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.min(F.struct("_new", "ts", "id", "name", "is_favorite", "params")).alias("f")
    grouped = both.withColumn("_key", params_key(F.col("params"))).groupBy("_key").agg(first, F.max("ts").alias("_last"))
    return grouped.select("f.id", F.col("_last").alias("ts"), "f.name", "f.is_favorite", "f.params")


def cap(history: DataFrame, n: int = 50) -> DataFrame:
    return history.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def order(history: DataFrame) -> DataFrame:
    """Favourites first, then the newest."""
    return history.orderBy(F.desc(F.coalesce("is_favorite", F.lit(False))), F.desc("ts"), F.desc("id"))


def searchable(entry_name: Column, params: Column) -> Column:
    fields = [F.array_join(params[a], " ") for a in ARRAYS] + [params[v] for v in ("content_search_term", "modified_after", "modified_before", "max_depth")]
    return F.lower(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in (entry_name, *fields))))


def search(history: DataFrame, text: str) -> DataFrame:
    return history.filter(searchable(F.col("name"), F.col("params")).contains(text.lower()))


def update(history: DataFrame, patches: DataFrame) -> DataFrame:
    """``history`` with name and is_favorite taken from ``patches`` (id, name, is_favorite) where these are not null."""
    p = patches.select("id", F.col("name").alias("_name"), F.col("is_favorite").alias("_favorite"))
    return history.join(p, "id", "left").withColumns({"name": F.coalesce("_name", "name"), "is_favorite": F.coalesce("_favorite", "is_favorite")}).drop("_name", "_favorite").select(*history.columns)
