"""Files that tasks write and read themselves, in any file system that pyarrow knows (file, hdfs, viewfs, s3, gs)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. file:/x and file:///x are the same."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_whole(path: str, data: bytes) -> None:
    """Writes a file that readers see as a whole or not at all: under another name first, then moved."""
    at, name = place(path)
    other = f"{name}.{uuid.uuid4().hex}.tmp"
    with at.open_output_stream(other) as out:
        out.write(data)
    at.move(other, name)


def exists(path: str) -> bool:
    at, name = place(path)
    return at.get_file_info(name).type != fs.FileType.NotFound
