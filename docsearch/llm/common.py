"""Shared helpers: scratch tables in the cluster's shared folder, Arrow batches, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch.sources.scratch import new_path

#: Rows of eight-byte keys that a broadcast may hold (about 32 MB in memory).
BROADCAST_ROWS = 1_000_000
#: Bytes of text that one step of an Arrow operator holds at once.
SLICE_BYTES = 1 << 20
#: Bytes of one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20

#: Spark's own bound of a batch, which ``ready`` lowers; a bound that the user has set stays.
SPARKS_BATCH = "67108864b"

_own_dirs: dict[str, str] = {}
_paths: dict[int, tuple] = {}


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: later steps start from files that every executor sees."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that no later step reads."""
    for df in tables:
        known, path = _paths.pop(id(df), (lambda: None, ""))
        if known() is df:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes where the session has Spark's default, and ships this package where the workers would not find
    it by themselves. Spark reads the bound when a lazy result is run, so it can't be set back before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == SPARKS_BATCH:
        spark.conf.set(key, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    places = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in places or os.path.realpath(os.getcwd()) == os.path.realpath(root) or os.path.exists("docsearch/llm/common.py"):
        return
    app = spark.sparkContext.applicationId
    if f"zip {app}" not in _own_dirs:
        base = os.path.join(tempfile.mkdtemp(prefix="docsearch-"), "docsearch")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "docsearch"))
        _own_dirs[f"zip {app}"] = base


def _give_back() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after which its worker keeps no freed memory: workers live on between tasks, beside the executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` followed by the fields in ``ddl``."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted), else as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0, one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
