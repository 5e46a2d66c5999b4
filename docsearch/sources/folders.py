"""Files below some folders as a Spark data source: hidden and empty files too, and failures as rows.

Format ``folder_files``. The reader lists the roots folder by folder (several folders at once, a folder that can't be listed gives
an error row and the rest goes on), leaves out what the pushed-down filters on ext, size, mtime and depth exclude before anything
is read, and deals the files to tasks by bytes: large files get tasks of their own, small ones share one. A task reads its files one
after another; a file that is gone, locked or a folder by then gives a row with the cause. A task holds one file and one batch.

Columns: root, file_path, ext, depth (segments below the root), size, mtime, content, read_error (why a file has no content), code and
message (of the system, for errors). A folder that can't be listed has a row with code and without size.
"""

from __future__ import annotations

import errno
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from docsearch.sources.files import place
from docsearch.sources.scratch import stored

SCHEMA = "root string, file_path string, ext string, depth int, size long, mtime timestamp, content string, read_error string, code string, message string"
#: Why a file can't be read, by the system's code (fixed values); any other code is a readError.
CAUSES = {"EPERM": "readPermissionDenied", "EACCES": "readPermissionDenied", "ENOENT": "fileNotFoundDuringRead", "EISDIR": "pathIsDir"}
#: Bytes that a task reads, what opening a file costs in bytes, rows and bytes of a batch, and folders listed at once.
TASK_BYTES, OPEN_BYTES, BATCH_ROWS, BATCH_BYTES, LISTERS = 64 << 20, 64 << 10, 4096, 8 << 20, 16
#: Paths that a task of ``fetch`` reads.
FETCH_FILES = 2000

Row = tuple  # of the columns of SCHEMA


def code_of(error: OSError) -> str:
    """The name of the system's code, EIO where there is none."""
    return errno.errorcode.get(error.errno or errno.EIO, "EIO")


def cause(code: str) -> str:
    return CAUSES.get(code, "readError")


def extension(name: str) -> str:
    """Lower case, without the dot; empty for none and for names that only begin with a dot."""
    base = name.rsplit("/", 1)[-1]
    stem, dot, ext = base.rpartition(".")
    return ext.lower() if dot and stem else ""


_TESTS: dict[type, Callable[[object, object], bool]] = {
    ds.EqualTo: lambda x, v: x == v,
    ds.GreaterThan: lambda x, v: x > v,
    ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v,
    ds.LessThanOrEqual: lambda x, v: x <= v,
    ds.In: lambda x, v: x in v,
}
_PUSHED = {"ext", "depth", "size", "mtime"}


@dataclass
class Part(ds.InputPartition):
    """Files to read, and rows that are complete already."""

    files: list[Row]
    done: list[Row]


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.content, self.most = options.get("content", "true") == "true", int(options.get("max_bytes", 50 << 20))
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.tests: list[tuple[str, Callable]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        """Filters on what a listing knows are answered here. Rows of failed folders have no size or time, so no such filter keeps them."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if type(f) in _TESTS and name in _PUSHED:
                self.tests.append((name, lambda x, t=_TESTS[type(f)], v=f.value: x is not None and t(x, v)))
            elif isinstance(f, ds.IsNotNull) and name in _PUSHED:
                self.tests.append((name, lambda x: x is not None))
            else:
                yield f

    def _wanted(self, row: Row) -> bool:
        known = dict(zip(("root", "file_path", "ext", "depth", "size", "mtime"), row, strict=False))
        return all(test(known[name]) for name, test in self.tests)

    def _deeper(self, depth: int) -> bool:
        """Whether any depth below can pass the filters, as far as upper bounds tell."""
        return all(name != "depth" or any(test(d) for d in range(depth, depth + 64)) for name, test in self.tests)

    def _list(self, at: fs.FileSystem, root: str, folder: str, depth: int) -> tuple[list[Row], list[tuple[str, int]]]:
        """Rows of the files and failures in one folder, and the folders in it."""
        try:
            infos = at.get_file_info(fs.FileSelector(folder))
        except OSError as e:
            return [(root, folder, None, depth, None, None, None, cause(code_of(e)), code_of(e), str(e))], []
        files, below = [], []
        for i in infos:
            if i.type == fs.FileType.Directory:
                below.append((i.path, depth + 1))
            elif i.type == fs.FileType.File:
                files.append((root, i.path, extension(i.path), depth + 1, i.size, i.mtime and i.mtime.astimezone(UTC), None, None, None, None))
        return files, below

    def listed(self) -> list[Row]:
        """One row for each path, however many roots it lies under (of these the first)."""
        rows: dict[str, Row] = {}
        with ThreadPoolExecutor(LISTERS) as pool:
            for root in self.roots:
                at, top = place(root)
                found = at.get_file_info(top)
                if found.type == fs.FileType.File:
                    level, ready = [], [(root, top, extension(top), 1, found.size, found.mtime and found.mtime.astimezone(UTC), None, None, None, None)]
                elif found.type == fs.FileType.NotFound:
                    level, ready = [], [(root, top, None, 0, None, None, None, "fileNotFoundDuringRead", "ENOENT", "no such folder")]
                else:
                    level, ready = [(top, 0)], []
                for row in ready:
                    if self._wanted(row):
                        rows.setdefault(row[1], row)
                while level:
                    parts = list(pool.map(lambda x, at=at, root=root: self._list(at, root, *x), level))
                    for files, _ in parts:
                        for row in files:
                            if self._wanted(row):
                                rows.setdefault(row[1], row)
                    level = [x for _, below in parts for x in below if self._deeper(x[1] + 1)]
        return list(rows.values())

    def partitions(self) -> list[Part]:
        """The largest files first, each to the task that has the least so far."""
        import heapq

        rows = self.listed()
        large = lambda r: r[4] is not None and r[4] > self.most
        done = [(*r[:7], f"fileTooLarge:{r[4]}" if self.content and large(r) else r[7], *r[8:]) for r in rows if r[4] is None or not self.content or large(r)]
        files = sorted((r for r in rows if r[4] is not None and self.content and not large(r)), key=lambda r: (-r[4], r[1]))
        total = sum(r[4] + OPEN_BYTES for r in files)
        tasks = [Part([], []) for _ in range(max(1, -(-total // self.task_bytes), -(-len(done) // 100_000)))]
        heap = [(0, k) for k in range(len(tasks))]
        for r in files:
            load, k = heapq.heappop(heap)
            tasks[k].files.append(r)
            heapq.heappush(heap, (load + r[4] + OPEN_BYTES, k))
        for k, r in enumerate(done):
            tasks[k * len(tasks) // len(done)].done.append(r)
        return tasks

    def _read(self, row: Row) -> Row:
        root, path, ext, depth, size, mtime, *_ = row
        try:
            at, _ = place(root)
            if at.get_file_info(path).type == fs.FileType.Directory:
                raise IsADirectoryError(errno.EISDIR, "is a directory")
            with at.open_input_stream(path, compression=None) as f:
                return (root, path, ext, depth, size, mtime, f.read().decode("utf-8", "replace"), None, None, None)
        except OSError as e:
            return (root, path, ext, depth, size, mtime, None, cause(code_of(e)), code_of(e), str(e))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        rows, held = [], 0
        for k, r in enumerate([*partition.done, *partition.files]):
            rows.append(r if k < len(partition.done) else self._read(r))
            held += len(rows[-1][6] or "")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class FolderFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def files(spark: SparkSession, roots: str | list[str], content: bool = True, max_bytes: int = 50 << 20, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of SCHEMA for all files below ``roots``; without ``content`` no file is opened. Files over ``max_bytes`` have a read_error
    and no content. Filters on ext, depth, size and mtime reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderFiles)
    options = {"roots": json.dumps([roots] if isinstance(roots, str) else list(roots)), "content": str(content).lower(), "max_bytes": str(max_bytes), "task_bytes": str(task_bytes)}
    return spark.read.format("folder_files").options(**options).load()


def path_errors(found: DataFrame) -> DataFrame:
    """search_path, error_path, message, code of what couldn't be listed or read: the input of ``filters.relevant_errors``."""
    bare = F.regexp_replace(F.col("root"), "^file:/*", "/")
    return found.filter("code is not null").select(bare.alias("search_path"), F.col("file_path").alias("error_path"), "message", "code")


def fetch(spark: SparkSession, wanted: DataFrame, batch: int = 256) -> DataFrame:
    """file_path, content, error for every path of ``wanted``, read from the file systems by tasks of about FETCH_FILES paths: paths are
    short, so tasks of a size in bytes would be few. Each cause of a failure has its key; a null or empty path has "noFilePath"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader({"roots": "[]"})
        for b in batches:
            for k in range(0, len(b), batch):
                paths = b.column(0).slice(k, batch).to_pylist()
                rows = []
                for p in paths:
                    if not p:
                        rows.append((None, "noFilePath"))
                        continue
                    try:
                        _, name = place(p)
                        r = reader._read((p, name, "", 0, None, None))
                        rows.append((r[6], r[7]))
                    except (ValueError, pa.ArrowInvalid):
                        rows.append((None, "readError"))
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], ["file_path", "content", "error"])

    paths = stored(wanted.select(F.col("file_path").cast("string")))
    return paths.repartition(max(1, -(-paths.count() // FETCH_FILES))).mapInArrow(run, "file_path string, content string, error string")


def utc(text: str) -> datetime:
    """A time for filters on mtime."""
    return datetime.fromisoformat(text).replace(tzinfo=UTC)
