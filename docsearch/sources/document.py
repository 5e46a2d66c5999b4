"""One ordered text file from many tasks, as a Spark data source (format ``one_document``).

Tasks write their rows (one string column, in the order of the whole) as part files beside the target; when all have succeeded the
parts are joined in the order of the tasks, in pieces of PIECE bytes, with the separator between entries and head and tail around them.
Readers see the whole file or none: it is moved into its place at the end, with a description (entries, bytes, sha256) beside it.
Parts of lost tasks aren't in the commit, so a repeated task leaves no trace. The joining is one pass of one process over
the bytes, as one file is; where parts will do, ``export.write`` has no such step.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docsearch.sources.files import exists, place, write_whole

PIECE = 4 << 20
#: Characters of a value by which rows of one key are dealt.
PREFIX = 16


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    entries: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.head, self.empty, self.between, self.tail = (options.get(k, "").encode() for k in ("head", "empty", "between", "tail"))
        self.parts = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, entries = TaskContext.get().partitionId(), 0
        at, folder = place(self.parts)
        at.create_dir(folder, recursive=True)
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        with at.open_output_stream(name) as out:
            for b in iterator:
                rows = [v.encode() for v in b.column(0).to_pylist() if v is not None]
                if rows:
                    out.write((self.between if entries else b"") + self.between.join(rows))
                    entries += len(rows)
        return Written(part, name, entries)

    def commit(self, messages: list) -> None:
        if not self.overwrite and exists(self.path):
            raise FileExistsError(self.path)
        done = sorted((m for m in messages if m is not None and m.entries), key=lambda m: m.part)
        at, target = place(self.path)
        digest, size = hashlib.sha256(), 0
        with at.open_output_stream(f"{target}.tmp") as out:

            def put(data: bytes) -> None:
                nonlocal size
                out.write(data)
                digest.update(data)
                size += len(data)

            put(self.head if done else self.empty)
            for k, m in enumerate(done):
                if k:
                    put(self.between)
                with at.open_input_stream(m.name) as part:
                    while piece := part.read(PIECE):
                        put(piece)
            if done:
                put(self.tail)
        at.move(f"{target}.tmp", target)
        write_whole(f"{self.path}.json", json.dumps({"entries": sum(m.entries for m in done), "bytes": size, "sha256": digest.hexdigest()}).encode())
        self.abort(messages)

    def abort(self, messages: list) -> None:
        at, folder = place(self.parts)
        if exists(self.parts):
            at.delete_dir(folder)


class OneDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_document"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """Column value of ``rows``, sorted by the columns ``order`` (then by value). Ranges are cut by ``order`` and the first characters of
    value, as Spark brings a sample of what it cuts by to the driver."""
    return rows.repartitionByRange(*order, F.substring("value", 1, PREFIX)).sortWithinPartitions(*order, "value").select("value")


def write(rows: DataFrame, path: str, order: list[str], head: str = "", empty: str = "", between: str = "\n", tail: str = "", overwrite: bool = True) -> None:
    """Writes column value of ``rows``, sorted by the columns ``order`` (then by value), as one file at ``path``."""
    rows.sparkSession.dataSource.register(OneDocument)
    options = {"head": head, "empty": empty, "between": between, "tail": tail}
    dealt(rows, order).write.format("one_document").options(**options).mode("overwrite" if overwrite else "append").save(path)


def described(rows_of: DataFrame, path: str) -> DataFrame:
    """entries, bytes, sha256 of a document that ``write`` has written."""
    return rows_of.sparkSession.read.schema("entries long, bytes long, sha256 string").json(f"{path}.json").select(F.col("entries"), "bytes", "sha256")
