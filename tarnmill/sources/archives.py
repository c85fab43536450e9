"""Tar archives as a data source: every archive is a partition that is read as a stream.

``spark.read.format("tar_members")`` gives ``archive, member, content, error``. A task opens its
archive once, goes through it from front to back and hands on its members in batches of bounded
size, so memory holds one batch or one large member, however long the archive is.
"""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS_PER_BATCH = 256
BYTES_PER_BATCH = 32 << 20
# tarfile copies what is left of a buffer at every read, so a large one costs its size for each member
BUFFER = 64 << 10
COMPRESSED_BUFFER = 4 << 20
OPENERS = {b"\x1f\x8b\x08": gzip.open, b"BZh": bz2.BZ2File, b"\xfd7z": lzma.LZMAFile, b"]\0\0": lzma.LZMAFile}
NAMES = ["archive", "member", "content", "error"]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path)


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def members(stream: IO[bytes], suffixes: tuple[str, ...]) -> Iterator[tuple[str, bytes]]:
    """Name and content of the regular files in a tar stream, compressed or not."""
    held = io.BufferedReader(stream, COMPRESSED_BUFFER)
    opener = OPENERS.get(held.peek(3)[:3])
    # decompressed by the buffer, however well it is compressed
    plain = opener(held) if opener else held
    with tarfile.open(fileobj=plain, mode="r|", bufsize=BUFFER) as archive:
        for member in archive:
            if member.isfile() and (not suffixes or member.name.lower().endswith(suffixes)):
                yield member.name, archive.extractfile(member).read()
            # the archive would otherwise remember every header
            archive.members = []


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern = options["path"], options.get("pattern", "*.tar.gz")
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)

    def partitions(self) -> list[InputPartition]:
        system, root = located(self.folder)
        files = system.get_file_info(fs.FileSelector(root, recursive=True))
        kept = [f.path for f in files if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)]
        return [_Archive(path) for path in sorted(kept)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = located(self.folder)
        held: list[tuple] = []
        size = 0
        try:
            with system.open_input_stream(partition.path, compression=None) as stream:
                for name, content in members(stream, self.suffixes):
                    held.append((partition.path, name, content, None))
                    size += len(content)
                    if len(held) == MEMBERS_PER_BATCH or size >= BYTES_PER_BATCH:
                        yield _batch(held)
                        held, size = [], 0
        except (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError) as error:
            held.append((partition.path, None, None, f"{type(error).__name__}: {error}"))
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], NAMES)


class TarMembers(DataSource):
    """Options: ``path`` (a folder), ``pattern`` of archive names, ``suffixes`` of members by comma."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, member string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarMembers)
