"""Token ids in binary files: blocks of BLOCK ids are transposed into byte planes (or bit planes), each compressed with zstandard.

A store is a folder of plane files and an index. Documents are dealt by ranges of doc_id and sorted; each task encodes its texts
and writes files of at most FILE_IDS ids (and what the last document has more). A file holds the blocks one after another, and at its
end the chunk index (place, ids and plane sizes of each block) and the document index (doc_id and number of ids of each document). A
document may begin in one block and end in a later one of the file. The store's index lists the files in order with the number of
ids before each; it is written when all tasks have succeeded, and files that it doesn't list (of tasks that were lost and
repeated) don't count. Both ways are Spark data sources, so tasks, repeats and commits are Spark's.

Ids below 2**8k need k byte planes; the number is the writer's ``planes``. High bytes repeat and are all but free; bit planes
(``bits``) suit ids that are sorted by frequency.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from docsearch.llm.common import BATCH_BYTES, buffer_of, ready, slices, text_or_empty
from docsearch.sources.files import exists, place, write_whole
from docsearch.sources.scratch import new_path

BLOCK = 1 << 16
FILE_IDS = 1 << 25
LEVEL = 3
MAGIC = b"TOKPLAN1"
INDEX = "_index.json"
#: Pieces (words with their marks) that a worker keeps encoded, none longer than PIECE_LETTERS: some 150 MB at most.
PIECES, PIECE_LETTERS = 800_000, 48

# --- blocks ---------------------------------------------------------------------------------------------------------------------


def split_planes(ids: np.ndarray, planes: int, bits: bool) -> list[bytes]:
    """The planes of a block of ids, lowest byte (or bit) first. Raises ValueError for an id that doesn't fit."""
    if len(ids) and int(ids.max()) >> 8 * planes:
        raise ValueError(f"id {int(ids.max())} needs more than {planes} bytes")
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, :planes]
    if bits:
        return [p.tobytes() for p in np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)]
    return [p.tobytes() for p in rows.T]


def join_planes(parts: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a block of ``n`` from its planes."""
    rows = np.zeros((n, 4), np.uint8)
    if bits:
        flat = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1), axis=1)[:, :n]
        rows[:, : len(parts) // 8] = np.packbits(flat.T, axis=1, bitorder="little")
    else:
        for k, p in enumerate(parts):
            rows[:, k] = np.frombuffer(p, np.uint8)
    return rows.view("<u4").reshape(-1)


class FileWriter:
    """Writes one plane file; blocks leave memory as soon as they are full."""

    def __init__(self, path: str, planes: int, bits: bool, block: int):
        import zstandard

        self.fs, self.path = place(path)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at, self.planes, self.bits, self.block = len(MAGIC), planes, bits, block
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.chunks: list[tuple[int, ...]] = []
        self.docs, self.sizes = [], array("q")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._put(flat[k : k + self.block])
            self.waiting, self.n_waiting = [flat[whole:].copy()], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        parts = [self.press.compress(p) for p in split_planes(ids, self.planes, self.bits)]
        self.chunks.append((self.at, len(ids), *map(len, parts)))
        for p in parts:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        width = self.planes * (8 if self.bits else 1)
        none = np.array([d is None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        chunks = np.array(self.chunks, "<i8").reshape(-1, 2 + width)
        index = self.press.compress(chunks.tobytes() + none.tobytes() + ids.tobytes() + np.array(self.sizes, "<i8").tobytes())
        self.out.write(index)
        self.out.write(struct.pack("<QQQBB", len(index), len(self.chunks), len(self.docs), self.planes, self.bits) + MAGIC)
        self.out.close()


_TAIL = struct.Struct("<QQQBB")


class FileReader:
    """Reads a plane file; ``ids`` fetches any range through the chunk index."""

    def __init__(self, path: str):
        import zstandard

        at, name = place(path)
        self.file = at.open_input_file(name)
        end = self.file.size()
        tail = self.file.read_at(_TAIL.size + len(MAGIC), end - _TAIL.size - len(MAGIC)) if end > _TAIL.size + 2 * len(MAGIC) - 1 else b""
        if tail[_TAIL.size :] != MAGIC:
            raise ValueError(f"{path} is not a whole plane file")
        size, n_chunks, n_docs, self.planes, self.bits = _TAIL.unpack(tail[: _TAIL.size])
        self.open = zstandard.ZstdDecompressor()
        raw = self.open.decompress(self.file.read_at(size, end - len(tail) - size))
        width = 2 + self.planes * (8 if self.bits else 1)
        cut = np.cumsum([0, 8 * n_chunks * width, n_docs, 8 * n_docs, 8 * n_docs])
        part = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.chunks = np.frombuffer(part[0], "<i8").reshape(-1, width)
        self.none, self.docs, self.sizes = np.frombuffer(part[1], np.uint8), np.frombuffer(part[2], "<i8"), np.frombuffer(part[3], "<i8")
        self.starts = np.cumsum([0, *self.sizes])
        self.firsts = np.cumsum([0, *self.chunks[:, 1]])

    def block(self, k: int) -> np.ndarray:
        offset, n, *sizes = self.chunks[k].tolist()
        raw = self.file.read_at(sum(sizes), offset)
        cut = np.cumsum([0, *sizes]).tolist()
        return join_planes([self.open.decompress(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)], n, bool(self.bits))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(self.firsts, start, "right")) - 1, int(np.searchsorted(self.firsts, stop, "left"))
        flat = np.concatenate([self.block(k) for k in range(a, b)])
        return flat[start - self.firsts[a] : stop - self.firsts[a]]

    def documents(self, limit: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Ranges of documents (from, to) with their ids, of about ``limit`` ids or one document each; every block is read once."""
        a, n, block, rest = 0, len(self.docs), 0, np.zeros(0, np.uint32)
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + limit, "right")) - 1))
            need, parts, have = int(self.starts[b] - self.starts[a]), [rest], len(rest)
            while have < need:
                parts.append(self.block(block))
                have += len(parts[-1])
                block += 1
            flat = np.concatenate(parts)
            yield a, b, flat[:need]
            rest = flat[need:].copy()
            a = b


# --- data source ----------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list  # of (partition, number in it, name, ids, documents)


@dataclass
class File(InputPartition):
    name: str
    first: int


class PlaneWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.planes = options["path"].rstrip("/"), int(options.get("planes", 2))
        self.bits, self.block, self.most = options.get("bits", "false") == "true", int(options.get("block", BLOCK)), int(options.get("file_ids", FILE_IDS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at, name = place(self.path)
        at.create_dir(name, recursive=True)
        part, files, out = TaskContext.get().partitionId(), [], None
        for b in iterator:
            buf, offs = buffer_of(b.column(1))
            flat, cut = np.frombuffer(buf.tobytes(), "<u4"), offs // 4
            for k, d in enumerate(b.column(0).to_pylist()):
                if out is None:
                    name = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.planes"
                    out = FileWriter(f"{self.path}/{name}", self.planes, self.bits, self.block)
                out.add(d, flat[cut[k] : cut[k + 1]])
                if out.n_ids >= self.most:
                    out.close()
                    files.append((part, len(files), name, out.n_ids, len(out.docs)))
                    out = None
        if out is not None:
            out.close()
            files.append((part, len(files), name, out.n_ids, len(out.docs)))
        return Written(files)

    def commit(self, messages: list) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        first = np.cumsum([0, *(f[3] for f in files)]).tolist()
        rows = [{"file": f[2], "first": a, "ids": f[3], "documents": f[4]} for f, a in zip(files, first, strict=False)]
        at, name = place(self.path)
        at.create_dir(name, recursive=True)
        write_whole(f"{self.path}/{INDEX}", json.dumps(rows).encode())

    def abort(self, messages: list) -> None:
        at, name = place(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                at.delete_file(f"{name}/{f[2]}")


class PlaneReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[File]:
        at, name = place(f"{self.path}/{INDEX}")
        with at.open_input_stream(name) as f:
            rows = json.loads(f.read())
        return [File(f"{self.path}/{r['file']}", r["first"]) for r in rows] or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        f = FileReader(partition.name)
        for a, b, flat in f.documents(BATCH_BYTES // 4):
            cut = ((f.starts[a : b + 1] - f.starts[a]) * 4).astype(np.int64)
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
            starts, sizes = pa.array(f.starts[a:b] + partition.first), pa.array(f.sizes[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(f.docs[a:b], mask=f.none[a:b].astype(bool)), starts, sizes, ids.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


class Planes(DataSource):
    """Format ``token_planes``: write (doc_id long, ids binary of little-endian 32-bit ids) in order, read it back with start (ids before
    the document in the store) and n_tokens. A store is written once."""

    @classmethod
    def name(cls) -> str:
        return "token_planes"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def writer(self, schema, overwrite: bool) -> PlaneWriter:
        if exists(f"{self.options['path'].rstrip('/')}/{INDEX}"):
            raise ValueError("a store is written once; take another path")
        return PlaneWriter(dict(self.options))

    def reader(self, schema) -> PlaneReader:
        return PlaneReader(dict(self.options))


# --- encoding -------------------------------------------------------------------------------------------------------------------


_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _OWN]
#: Byte-level tokenizers write each byte as a letter: these as they are, the others as the letters from 256 on, in their order.
_BYTES = {b: chr(256 + k) for k, b in enumerate(_OTHER)}
_SPACE = _BYTES[32]
#: Marks behind a word that are words of their own by the pattern.
_ENDS = (".", ",", ";", ":", "!", "?")
#: White space other than the space and the line feed.
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class Encoder:
    """Texts to ids by the tokenizers library. Where the tokenizer's words can't hold a space or a line feed behind another character
    (byte-level BPE), a text is cut in front of spaces and around line feeds: these are word borders by its pattern where no other white
    space stands beside them. The pieces are encoded once, many in one call with a line feed between any two, and kept. Other texts
    are cut in front of spaces that begin a word. Strings of special tokens are ordinary text."""

    _odd, _cut, _space = re.compile("[ \n]\\s"), re.compile(r" (?=\S)"), re.compile(r"\s")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        told = json.loads(self.tokenizer.to_str())
        words = told["pre_tokenizer"] or {}
        line = self._ids("\n")
        self.line = line[0] if len(line) == 1 else -1
        self.by_pieces = (
            told["normalizer"] is None and words.get("type") == "ByteLevel" and not words["add_prefix_space"] and words.get("use_regex", True)
            and told["model"].get("dropout") is None and all(t["special"] for t in told["added_tokens"]) and self.line >= 0
        )
        self.kept: dict[str, bytes] = {}
        self.ends = {e: self.whole(e) for e in ("", *_ENDS)}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bytes:
        """Of a text, by one call of the library."""
        return array("I", self._ids(text)).tobytes()

    def _word(self, letters: str, bare: bool) -> bytes:
        """Of a word of Latin letters, with a space before it unless ``bare``: by the pattern it is cut no further, so the library's model
        gets it as it is, in the letters that stand for bytes."""
        name = ("" if bare else _SPACE) + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTES))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(name)]).tobytes()

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Of pieces with a space before each, or the mark 1 or 2 if there is none. Words of Latin letters, also with a mark behind them,
        which is a word of its own, go to the model alone. The others are joined: a line feed is a word of its own beside a piece that
        doesn't hold white space."""
        out, plain, kept = {}, [], self.kept.get
        for p in pieces:
            bare = p[:1] in ("\1", "\2")
            end = p[-1:] if p[-1:] in _ENDS else ""
            letters = p[bare : len(p) - len(end)]
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250") and p[:1] != "\1":
                base = p[: len(p) - len(end)]
                found = kept(base) or out.get(base)
                if found is None:
                    out[base] = found = self._word(letters, bare)
                out[p] = found + self.ends[end]
            elif self._space.search(p) or len(p) <= bare:
                out[p] = self.whole(p[1:] if bare else " " + p)
            else:
                plain.append(p)
        for k in range(0, len(plain), 1024):
            part = plain[k : k + 1024]
            ids = np.array(self._ids("\n".join([p[1:] if p[0] == "\2" else " " + p for p in part])), np.uint32)
            raw, ends = ids.tobytes(), [*np.flatnonzero(ids == self.line).tolist(), len(ids)]
            if len(ends) != len(part):
                raise ValueError("the tokenizer joins words across a line feed")
            out.update((p, raw[4 * a + 4 : 4 * b]) for p, a, b in zip(part, [-1, *ends], ends, strict=False))
        return out

    def _split(self, text: str) -> list[str]:
        """The pieces; mark 1: a line feed, mark 2: a piece without a space before it."""
        if "\1" in text or "\2" in text:
            return []
        # looking for a string is much faster than the pattern, which is asked only where other white space stands in the text
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in _WHITE) and self._odd.search(text):
            first, *rest = self._cut.split(text)
            return [*(["\2" + first] if first else ()), *rest]
        return f"\2{text.replace("\n", " \1\n \2")}".split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_pieces:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = list(map(self._split, texts))
        flat = list(chain.from_iterable(cut))
        got = list(map(self.kept.get, flat))
        holes = [k for k, x in enumerate(got) if x is None]
        new = self._pieces(list(dict.fromkeys([flat[k] for k in holes])))
        for k in holes:
            got[k] = new[flat[k]]
        if len(self.kept) + len(new) > PIECES:
            self.kept = {p: x for p, x in zip(flat, got, strict=True) if len(p) <= PIECE_LETTERS}
        else:
            self.kept.update((p, x) for p, x in new.items() if len(p) <= PIECE_LETTERS)
        out, at = [], 0
        for p, t in zip(cut, texts, strict=True):
            out.append(b"".join(got[at : at + len(p)]) if p else self.whole(t))
            at += len(p)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each tokenizer and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """doc_id and ids (binary, little-endian 32 bits each, with ``end`` appended) of every row of ``docs`` in ascending order of
    doc_id, dealt by ranges of it. Nulls come first; rows with one doc_id are ordered by a hash of the text, then the text."""
    ready(docs.sparkSession)
    last = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in batches:
            buf, offs = buffer_of(b.column(1))
            for i, j in slices(offs):
                raw = buf[offs[i] : offs[j]].tobytes()
                texts = [raw[p:q].decode() for p, q in zip(offs[i:j] - offs[i], offs[i + 1 : j + 1] - offs[i], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x + last for x in e.encode(texts)], pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_t")).withColumn("_h", F.xxhash64("_t"))
    dealt = rows.repartitionByRange("doc_id", "_h", F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "_h", "_t")
    return dealt.select("doc_id", "_t").mapInArrow(run, "doc_id long, ids binary")


def write(tokens: DataFrame, path: str, planes: int = 2, bits: bool = False, block: int = BLOCK, file_ids: int = FILE_IDS) -> None:
    """Writes ordered rows of doc_id and ids as a store at ``path``."""
    spark = tokens.sparkSession
    ready(spark)
    spark.dataSource.register(Planes)
    options = {"planes": str(planes), "bits": str(bits).lower(), "block": str(block), "file_ids": str(file_ids)}
    tokens.select("doc_id", "ids").write.format("token_planes").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document of a store, a task for each file."""
    ready(spark)
    spark.dataSource.register(Planes)
    return spark.read.format("token_planes").load(path)


def digests(docs: DataFrame, tokenizer: str, end: int = 0, **options) -> DataFrame:
    """Writes the texts of ``docs`` (columns doc_id, text; null is empty) as a store and reads it back: doc_id, start, n_tokens,
    ids_crc32 for every row. Empty texts have the end id alone; an empty table gives an empty result; repeated rows are rows of their own."""
    spark = docs.sparkSession
    path = new_path(spark)
    write(encode(docs, tokenizer, end), path, **options)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
