"""Sequence files of (32-bit integer, bytes) as a data source, read and written in splits.

A file is a header with a random 16-byte mark, then records; every hundred kilobytes or so the mark
stands between two records. A task that is given any byte range looks for the first mark in it and
reads on to the first mark past its end, so a file of any size is shared by many tasks. Rows go to
and from Spark as Arrow batches; no RDD is involved.

Paths are opened by pyarrow (local, hdfs, s3, gs), so executors must reach them by it. Compressed
files are refused; ``sequences.read_packed_files`` imports those through Hadoop's own classes.

Defined results: a folder without files, or with empty ones, gives no rows; files whose names begin
with ``_`` or ``.`` are skipped; a null id or value cannot be stored and fails the job; a file that
ends inside a record, or whose mark is damaged, fails with its name. A path that already holds files
is not written to.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

SCHEMA = "id int, value binary"
# Fixed values of the container: its first bytes, the class names of its fields, and the length
# that announces a mark.
MAGIC = b"SEQ\x06"
KEY_CLASS = "org.apache.hadoop.io.IntWritable"
VALUE_CLASS = "org.apache.hadoop.io.BytesWritable"
MARK_BYTES = 16
ESCAPE = b"\xff\xff\xff\xff"
# Bytes between marks, as written.
MARK_INTERVAL = 100 << 10
# Bytes a task reads, and holds, at once.
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000
SPLIT_BYTES = 128 << 20


def open_filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def data_files(files: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """Files of a folder, or the one file, that hold rows."""
    info = files.get_file_info(folder)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(folder))
    rows = [f for f in found if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
    return sorted(rows, key=lambda f: f.path)


class Truncated(ValueError):
    pass


def exactly(stream: io.BufferedIOBase, n: int) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise Truncated(f"{len(data)} bytes where {n} are due")
    return data


def read_name(stream: io.BufferedIOBase) -> str:
    """Text with its length before it; the lengths of class names take one byte or two."""
    n = struct.unpack("b", exactly(stream, 1))[0]
    if n == -113:
        n = exactly(stream, 1)[0]
    elif n < 0:
        raise ValueError("a name of more than 255 bytes in the header")
    return exactly(stream, n).decode()


def read_header(stream: io.BufferedIOBase) -> bytes:
    """Leave the stream at the first record and return the file's mark."""
    if exactly(stream, len(MAGIC)) != MAGIC:
        raise ValueError("no sequence file of version 6")
    kinds = (read_name(stream), read_name(stream))
    if kinds != (KEY_CLASS, VALUE_CLASS):
        raise ValueError(f"records of {kinds[0]} and {kinds[1]}")
    if exactly(stream, 2) != b"\0\0":
        raise ValueError("compressed records; use read_packed_files")
    for _ in range(2 * struct.unpack(">i", exactly(stream, 4))[0]):
        read_name(stream)
    return exactly(stream, MARK_BYTES)


def first_mark(stream: io.BufferedIOBase, mark: bytes, begin: int, end: int) -> int | None:
    """Where the first escape and mark that begin in [begin, end) begin."""
    stream.seek(begin)
    wanted, held, at = ESCAPE + mark, b"", begin
    while at < end:
        block = stream.read(BLOCK_BYTES)
        if not block:
            return None
        held += block
        found = held.find(wanted)
        if found >= 0:
            return at + found if at + found < end else None
        passed = max(0, len(held) - len(wanted) + 1)
        held, at = held[passed:], at + passed
    return None


def read_records(stream: io.BufferedIOBase, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Records that follow the header, if begin is 0, and the marks that begin in [begin, end)."""
    mark = read_header(stream)
    if begin:
        start = first_mark(stream, mark, begin, end)
        if start is None:
            return
        stream.seek(start)
    at = stream.tell()
    while head := stream.read(4):
        if len(head) < 4:
            raise Truncated("the file ends inside a record")
        if head == ESCAPE:
            if at >= end:
                return
            if exactly(stream, MARK_BYTES) != mark:
                raise ValueError(f"another mark than the header's at byte {at}")
            at += 4 + MARK_BYTES
            continue
        size, key_size = struct.unpack(">i", head)[0], struct.unpack(">i", exactly(stream, 4))[0]
        if key_size != 4 or size < 8:
            raise ValueError(f"no record at byte {at}")
        number, length = struct.unpack(">ii", exactly(stream, 8))
        if length != size - 8:
            raise ValueError(f"a value of {length} bytes in a record of {size} at byte {at}")
        yield number, exactly(stream, length)
        at += 8 + size


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


class SequenceFileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        if self.split_bytes < 1:
            raise ValueError("split_bytes must be positive")

    def partitions(self) -> list[Split]:
        files, folder = open_filesystem(self.path)
        step = self.split_bytes
        return [
            Split(f.path, begin, min(begin + step, f.size))
            for f in data_files(files, folder)
            for begin in range(0, f.size, step)
        ] or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        files, _ = open_filesystem(self.path)
        ids, values, held = [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int32()), pa.array(values, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "value"])

        with io.BufferedReader(files.open_input_file(split.path), BLOCK_BYTES) as stream:
            try:
                for number, value in read_records(stream, split.begin, split.end):
                    ids.append(number)
                    values.append(value)
                    held += len(value)
                    if held >= BATCH_BYTES or len(ids) >= BATCH_ROWS:
                        yield batch()
                        ids, values, held = [], [], 0
            except ValueError as problem:
                raise ValueError(f"{split.path}: {problem}") from problem
        if ids:
            yield batch()


def header(mark: bytes) -> bytes:
    names = b"".join(struct.pack("b", len(n)) + n.encode() for n in (KEY_CLASS, VALUE_CLASS))
    return MAGIC + names + b"\0\0" + struct.pack(">i", 0) + mark


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class SequenceFileWriter(DataSourceArrowWriter):
    """One file for each task that has rows, moved into the folder once all tasks are done.

    A task that is run twice writes two files under different names; only the one that its
    commit names is moved.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        files, folder = open_filesystem(self.path)
        if files.get_file_info(folder).type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} already exists")
        self.unfinished = f"_unfinished-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, folder = open_filesystem(self.path)
        name, out, since = f"part-{uuid.uuid4().hex}", None, 0
        mark = uuid.uuid4().bytes
        try:
            for batch in batches:
                if batch.column(0).null_count or batch.column(1).null_count:
                    raise ValueError("a null id or value cannot be stored")
                for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if out is None:
                        files.create_dir(f"{folder}/{self.unfinished}")
                        raw = files.open_output_stream(f"{folder}/{self.unfinished}/{name}")
                        out = io.BufferedWriter(raw, BLOCK_BYTES)
                        out.write(header(mark))
                    if since >= MARK_INTERVAL:
                        out.write(ESCAPE + mark)
                        since = 0
                    since += out.write(struct.pack(">iiii", 8 + len(value), 4, number, len(value)))
                    since += out.write(value)
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = open_filesystem(self.path)
        files.create_dir(f"{folder}/{self.unfinished}")
        for message in messages:
            if message is not None and message.name:
                files.move(f"{folder}/{self.unfinished}/{message.name}", f"{folder}/{message.name}")
        files.delete_dir(f"{folder}/{self.unfinished}")
        files.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = open_filesystem(self.path)
        if files.get_file_info(f"{folder}/{self.unfinished}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{folder}/{self.unfinished}")


class SequenceFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandjoin_sequence_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SequenceFileReader:
        return SequenceFileReader(self.options)

    def writer(self, schema, overwrite: bool) -> SequenceFileWriter:
        return SequenceFileWriter(self.options)


def scan_sequence_files(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, value) of a file or of the files of a folder, a task for each ``split_bytes``."""
    spark.dataSource.register(SequenceFileSource)
    source = spark.read.format(SequenceFileSource.name()).option("split_bytes", str(split_bytes))
    return source.load(path)


def save_sequence_files(packed: DataFrame, path: str) -> None:
    """(id, value) as sequence files in a new folder, one for each partition that has rows."""
    packed.sparkSession.dataSource.register(SequenceFileSource)
    rows = packed.select(F.col("id").cast("int").alias("id"), F.col("value").cast("binary").alias("value"))
    rows.write.format(SequenceFileSource.name()).mode("append").save(path)
