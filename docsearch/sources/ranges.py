"""One very large text file as many rows: byte ranges with overlap, from as many tasks (format ``file_ranges``).

A row owns the characters that begin in its range of ``size`` bytes; its text goes on for ``overlap`` characters, so whatever begins in a
range and is no longer than that is seen whole by the range it begins in, and by no other. The character before a range comes
along for tests of word borders. Ranges begin at characters: a range skips what the one before it owns of a character. Places are
put together from the numbers of characters of the ranges before, one small row for each range. No file is one row or one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsearch.operators.positions import positions
from docsearch.plans.query import Node, Settings, compile_query
from docsearch.sources.files import place
from docsearch.sources.folders import Reader as Folders
from docsearch.sources.scratch import stored

SCHEMA = "file_path string, chunk_no long, start_byte long, before string, own_chars long, chunk string"
#: Bytes of a range, characters of overlap, bytes of ranges that one task reads.
SIZE, OVERLAP, TASK_BYTES = 64 << 10, 1 << 10, 32 << 20
#: Tasks beyond which they are made larger.
MOST_TASKS = 1000


def _begin(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def cut_range(data: bytes, lead: int, size: int, overlap: int) -> tuple[str, int, str]:
    """(the character before, own characters, text) of the range that begins at ``lead`` in ``data`` and owns ``size`` bytes; data goes on for
    four bytes for each character of overlap, where the file does."""
    first, end = _begin(data, lead), _begin(data, min(len(data), lead + size))
    own = data[first:end].decode("utf-8", "replace") if first < end else ""
    back = first - 1
    while back > 0 and data[back] & 0xC0 == 0x80:
        back -= 1
    before = data[back:first].decode("utf-8", "replace") if first else ""
    return before, len(own), own + (data[end : _begin(data, min(len(data), end + 4 * overlap))].decode("utf-8", "replace")[:overlap])


@dataclass
class Part(InputPartition):
    path: str
    name: str
    first: int
    ranges: int
    length: int


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.size, self.overlap = int(options.get("size", SIZE)), int(options.get("overlap", OVERLAP))
        self.each = max(1, int(options.get("task_bytes", TASK_BYTES)) // self.size)

    def partitions(self) -> list[Part]:
        found = [r for r in Folders({"roots": self.options["roots"], "content": "false"}).listed() if r[4]]
        # an asked-for task is the least: with more than MOST_TASKS of them in all, tasks grow up to TASK_BYTES
        total = sum(-(-r[4] // self.size) for r in found)
        self.each = max(self.each, min(-(-total // MOST_TASKS), TASK_BYTES // self.size))
        parts = []
        for root, name, _, _, length, *_ in found:
            many = -(-length // self.size)
            parts += [Part(root, name, k, min(self.each, many - k), length) for k in range(0, many, self.each)]
        return parts or [Part("", "", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.ranges:
            return
        at, _ = place(p.path)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        with at.open_input_file(p.name) as f:
            rows, held = [], 0
            for k in range(p.first, p.first + p.ranges):
                begin = k * self.size
                lead = min(4, begin)
                data = f.read_at(min(p.length - begin + lead, lead + self.size + 4 * self.overlap + 4), begin - lead)
                before, own, text = cut_range(data, lead, self.size, self.overlap)
                rows.append((p.name, k, begin, before, own, text))
                held += len(text)
                if held >= 4 << 20 or k == p.first + p.ranges - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows, held = [], 0


class FileRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def ranges(spark: SparkSession, roots: str | list[str], size: int = SIZE, overlap: int = OVERLAP, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of SCHEMA for all files below ``roots``."""
    spark.dataSource.register(FileRanges)
    options = {"roots": json.dumps([roots] if isinstance(roots, str) else list(roots)), "size": str(size), "overlap": str(overlap), "task_bytes": str(task_bytes)}
    return spark.read.format("file_ranges").options(**options).load()


def starts(rows: DataFrame) -> DataFrame:
    """file_path, chunk_no, start: the place (in characters) of each range in its file. Numbers alone are shuffled; a file with very many
    ranges is cut into groups of 4,096, whose sums lead over."""
    group = F.floor(F.col("chunk_no") / 4096).alias("_g")
    sizes = rows.select("file_path", "chunk_no", group, "own_chars")
    sums = sizes.groupBy("file_path", "_g").agg(F.sum("own_chars").alias("_s"))
    before = sums.select("file_path", "_g", F.coalesce(F.sum("_s").over(W.partitionBy("file_path").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("own_chars").over(W.partitionBy("file_path", "_g").orderBy("chunk_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("_i", inside).join(before, ["file_path", "_g"]).select("file_path", "chunk_no", (F.col("_b") + F.col("_i")).alias("start"))


def flags(rows: DataFrame, tree: Node | dict | None, settings: Settings = Settings()) -> DataFrame:
    """``rows`` with matched: whether the range with its overlap satisfies the query."""
    return rows.withColumn("matched", compile_query(tree, "chunk", settings))


def hits(term: str, whole_word: bool = False) -> Column:
    """The places in a row's text of the occurrences that begin in its own characters."""
    lead = F.length("before")
    found = positions(F.concat("before", "chunk"), term, whole_word=whole_word)
    return F.filter(F.transform(found, lambda i: i - lead), lambda i: (i >= 0) & (i < F.col("own_chars")))


def places(rows: DataFrame, term: str, overlap: int = OVERLAP, whole_word: bool = False) -> DataFrame:
    """file_path, pos of every occurrence (in characters of the whole file), equal to a search of the whole text."""
    if len(term) >= overlap:
        raise ValueError("a term longer than the overlap can be cut off by it")
    seen = stored(rows.select("file_path", "chunk_no", "own_chars", hits(term, whole_word).alias("_at")))  # the file is read once
    found = seen.filter(F.size("_at") > 0).join(starts(seen), ["file_path", "chunk_no"])
    return found.select("file_path", F.explode("_at").alias("_i"), "start").select("file_path", (F.col("start") + F.col("_i")).alias("pos"))
