"""Groups of documents with the same content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch.functions.text import sampled_fingerprint
from docsearch.sources.scratch import stored

#: Rows of keys that may be broadcast.
BROADCAST_ROWS = 200_000


def _is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def duplicate_groups(docs: DataFrame, key: str = "doc_id", content: str = "content", sample: Column | None = None) -> DataFrame:
    """key, group (the smallest key with this content) and copies of every document whose content another row has as well.

    First the sampled fingerprint and the length of each text are counted: what stands alone can have no copy and is not looked at again.
    The rest is compared by the SHA-256 of the whole content, so texts that are alike in the sampled parts only come apart.
    Digests, never texts, are shuffled, and counts are added up before the shuffle, so a content that a third of all rows have
    is one row from each task; the groups come back to the rows by a broadcast where they are few, else by a join that Spark
    splits where it is uneven. Where the fingerprints that repeat are too many to broadcast, every text is digested before that join, so
    that it shuffles digests as well. The steps between are stored, so texts are read twice. Null contents are in no group; empty ones are equal."""
    c = F.col(content)
    sample = sampled_fingerprint(c) if sample is None else sample
    rows = docs.filter(c.isNotNull()).select(F.col(key), c.alias("_c"), sample.alias("_s"), F.octet_length(c).alias("_n"))
    again = stored(rows.groupBy("_s", "_n").agg(F.count("*").alias("_k")).filter("_k > 1").select("_s", "_n"))
    digest = F.unhex(F.sha2("_c", 256)).alias("_d")
    if _is_small(again):
        likely = rows.join(F.broadcast(again), ["_s", "_n"], "left_semi").select(key, "_n", digest)
    else:
        likely = rows.select(key, "_s", "_n", digest).join(again, ["_s", "_n"], "left_semi").select(key, "_n", "_d")
    likely = stored(likely)
    groups = stored(likely.groupBy("_n", "_d").agg(F.min(key).alias("group"), F.count("*").alias("copies")).filter("copies > 1"))
    return likely.join(F.broadcast(groups) if _is_small(groups) else groups, ["_n", "_d"]).select(key, "group", "copies")
