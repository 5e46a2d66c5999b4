"""Exact top-k by inner product, column by column with branch and bound.

Vectors are dealt into blocks of candidates and blocks of queries of bounded size; a task takes one block of each. There the
candidates lie in vertical layout, dimension by dimension. Partial products are added up one group of dimensions after the other;
what is still to come is at most the product of the two vectors' remaining lengths (Cauchy-Schwarz), so candidates whose best case
is below the k-th best worst case can't be among the first k and are compacted away. The first block of candidates is searched
before the others: its k-th best score of a query is the bound that the query begins with in all other blocks. Bounds only exclude
what is strictly worse, so ties stay, and the result is exact. The tasks' top k meet in one ranking for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsearch.llm.common import cut, ready

CANDIDATES, QUERIES = 8192, 1024
#: Dimensions added up between two compactions.
DIMENSIONS = 8


def integer_vectors(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(vec_id, v): every component x as floor(factor * x). Left out: null ids, and vectors that are null or hold null or
    non-finite components. Rows that repeat a vec_id stay. Scores are exact as long as sums of products stay under 2**53."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    some = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    v = F.transform(x, lambda c: F.floor(F.lit(float(factor)) * c).cast("long"))
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    a = column.combine_chunks()
    n = np.diff(a.offsets.to_numpy())
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out[row, place] = a.flatten().to_numpy()
    return out


def search_block(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector id, score) of the k best of ``x`` for each row of ``q``, the query's own row left out. ``rows`` and
    ``query_rows`` number the rows of the table; scores under a query's ``least`` are of no use."""
    order = np.argsort(-(q * q).sum(0), kind="stable")  # heavy dimensions first: bounds fall sooner
    x, q = np.ascontiguousarray(x[:, order].T), q[:, order]
    cuts = [*range(0, len(x), DIMENSIONS), len(x)]
    rest_x = [np.sqrt((x[c:] ** 2).sum(0)) for c in cuts[1:]]
    rest_q = [np.sqrt((q[:, c:] ** 2).sum(1)) for c in cuts[1:]]
    out = []
    for a in range(0, len(q), 128):
        first = q[a : a + 128, : cuts[1]] @ x[: cuts[1]] if len(x) else np.zeros((len(q[a : a + 128]), len(ids)))
        for r in range(a, min(a + 128, len(q))):
            alive = np.flatnonzero(rows != query_rows[r])
            s = first[r - a][alive]
            for b in range(1, len(cuts)):
                if b > 1:
                    s = s + q[r, cuts[b - 1] : cuts[b]] @ x[cuts[b - 1] : cuts[b], alive]
                if len(s):
                    room = rest_x[b - 1][alive] * rest_q[b - 1][r]
                    worst = max(least[r], np.partition(s - room, len(s) - k)[len(s) - k]) if len(s) > k else least[r]
                    keep = s + room >= worst - 1e-6 * (1 + abs(worst)) if np.isfinite(worst) else slice(None)
                    alive, s = alive[keep], s[keep]
            best = np.lexsort((ids[alive], -s))[:k]
            out.append((np.full(len(best), query_rows[r]), ids[alive[best]], np.rint(s[best]).astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, factor: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows but the query's own, ties to the smaller vec_id, for the
    queries whose vec_id is divisible by ``every``. ``vectors``: vec_id, embedding; others are ignored. Rows that repeat a vec_id
    are rows of their own, each a query and a candidate of the others. Shorter vectors count as filled with zeros. Queries without
    other vectors have no rows; an empty table gives an empty result."""
    ready(vectors.sparkSession)
    data = cut(integer_vectors(vectors, factor).withColumn("row", F.monotonically_increasing_id()))
    n, n_queries = data.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    block = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    every_of = lambda first, m: F.explode(F.sequence(F.lit(first), F.lit(m - 1)))
    candidates = data.withColumn("c", block(c_blocks))
    queries = data.filter(F.col("vec_id") % every == 0)

    def search(t: pa.Table) -> pa.Table:
        query = t.column("query").to_numpy()
        if query.all() or not query.any():
            empty = pa.array([], pa.int64())
            return pa.table({"query_row": empty, "vec_id": empty, "score": empty})
        rows, ids, least = (t.column(c).to_numpy() for c in ("row", "vec_id", "least"))
        m = _matrix(t.column("v"), int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()))
        found = search_block(rows[~query], ids[~query], m[~query], rows[query], m[query], k, least[query])
        return pa.table(dict(zip(("query_row", "vec_id", "score"), map(pa.array, found), strict=True)))

    def searched(some: DataFrame, asking: DataFrame, first: int, last: int) -> DataFrame:
        left = some.select("row", "vec_id", "v", "c", every_of(0, q_blocks).alias("q"), F.lit(False).alias("query"), F.lit(0.0).alias("least"))
        right = asking.select("row", "vec_id", "v", every_of(first, last).alias("c"), block(q_blocks).alias("q"), F.lit(True).alias("query"), "least")
        return left.unionByName(right).groupBy("c", "q").applyInArrow(search, "query_row long, vec_id long, score long")

    nothing = F.lit(float("-inf"))
    local = searched(candidates.filter("c = 0"), queries.withColumn("least", nothing), 0, 1)
    if c_blocks > 1:
        local = cut(local)
        kth = local.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(nothing).alias("least"))
        local = local.unionByName(searched(candidates.filter("c > 0"), queries.join(kth, "row", "left").withColumn("least", F.coalesce("least", nothing)), 1, c_blocks))
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    ranked = local.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.join(queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row").select("query_id", "rank", "vec_id", "score")
