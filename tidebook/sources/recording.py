"""The recording format as a Spark data source: ``spark.read.format("msr")`` and ``df.write.format("msr")``.

A file is one zstd stream: a header, then records of kind, receive time, length
and payload, little-endian.  Files are read one per partition.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import io
import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidebook.workers import reachable

# Fixed values of the format.
MAGIC, VERSION = b"MSREC\0", 1
HEAD, RECORD = struct.Struct("<6sH"), struct.Struct("<BqI")
KINDS = {1: "frame", 2: "snapshot", 3: "metadata", 4: "drop"}
LONGEST = 16 << 20
_HOUR = 3_600_000_000_000
SUFFIX = ".msr.zst"

SCHEMA = "file string, file_no bigint, idx bigint, kind string, received_at bigint, payload binary, dropped bigint"


class CorruptRecording(ValueError):
    """The file is not a recording, or ends or goes wrong inside a record."""


class FileWriter:
    """One file, written as records come: one thread and one stream, so equal records give equal bytes."""

    def __init__(self, out: io.RawIOBase, level: int = 3) -> None:
        self.numbers = {name: number for number, name in KINDS.items()}
        self.out = zstandard.ZstdCompressor(level=level).stream_writer(out, closefd=True)
        self.out.write(HEAD.pack(MAGIC, VERSION))

    def write(self, kind: str, received_at: int, payload: bytes) -> None:
        if len(payload) > LONGEST:
            raise ValueError(f"a record of {len(payload)} bytes is too long")
        self.out.write(RECORD.pack(self.numbers[kind], received_at, len(payload)) + payload)

    def close(self) -> None:
        self.out.close()


def encode(records: Iterable[tuple[str, int, bytes]], level: int = 3) -> bytes:
    """A whole file in memory."""
    out = io.BytesIO()
    out.close = lambda: None  # its bytes are wanted
    writer = FileWriter(out, level)
    for record in records:
        writer.write(*record)
    writer.close()
    return out.getvalue()


def drop_marker(n: int) -> bytes:
    """The payload that says how many records were lost."""
    return struct.pack("<Q", n)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def hour_name(received_at: int) -> str:
    """The name of the hourly file that a record belongs to, in UTC."""
    return dt.datetime.fromtimestamp(received_at // 1_000_000_000, dt.timezone.utc).strftime("%Y-%m-%dT%H")


def decode(stream: io.BufferedIOBase) -> Iterator[tuple[str, int, bytes]]:
    """Records up to the end, which must lie between two of them."""
    reader = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)

    def exactly(n: int, may_end: bool = False) -> bytes:
        parts, left = [], n
        while left:
            try:
                part = reader.read(left)
            except zstandard.ZstdError as e:
                raise CorruptRecording(str(e)) from e
            if not part:
                if may_end and left == n:
                    return b""
                raise CorruptRecording("the file ends inside a record")
            parts.append(part)
            left -= len(part)
        return b"".join(parts)

    magic, version = HEAD.unpack(exactly(HEAD.size))
    if magic != MAGIC or version != VERSION:
        raise CorruptRecording("not a recording of this version")
    while head := exactly(RECORD.size, may_end=True):
        number, received_at, size = RECORD.unpack(head)
        if number not in KINDS:
            raise CorruptRecording(f"unknown record kind {number}")
        if size > LONGEST:
            raise CorruptRecording(f"a record of {size} bytes is too long")
        if number == 4 and size != 8:
            raise CorruptRecording("a drop marker must hold 8 bytes")
        yield KINDS[number], received_at, exactly(size)


@dataclass
class _File(InputPartition):
    path: str
    number: int


class RecordingReader(DataSourceReader):
    """One partition per file, in path order. ``mode`` PERMISSIVE keeps the records before a break; FAILFAST refuses the file. ``kind`` reads records of one kind only."""

    def __init__(self, options: dict) -> None:
        self.path, self.mode, self.kind = options["path"], options.get("mode", "FAILFAST").upper(), options.get("kind")

    def partitions(self) -> list[InputPartition]:
        files, at = filesystem(self.path)
        found = files.get_file_info(at) if not any(c in at for c in "*?[") else None
        if found is not None and found.type == fs.FileType.File:
            names = [at]
        else:
            folder, pattern = (at, f"*{SUFFIX}") if found is not None else (os.path.dirname(at), os.path.basename(at))
            listed = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            matching = (f.path for f in listed if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith("."))
            names = sorted(matching, key=lambda name: name.removesuffix(SUFFIX))  # an hour's first file has no number
        return [_File(p, k) for k, p in enumerate(names)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with filesystem(self.path)[0].open_input_stream(partition.path, compression=None) as f:
            rows = decode(f)
            idx = 0
            while True:
                try:
                    kind, received_at, payload = next(rows)
                except StopIteration:
                    return
                except CorruptRecording:
                    if self.mode == "PERMISSIVE":
                        return
                    raise
                if self.kind in (None, kind):
                    yield partition.path, partition.number, idx, kind, received_at, payload, struct.unpack("<Q", payload)[0] if kind == "drop" else None
                idx += 1


@dataclass
class _Written(WriterCommitMessage):
    """The files of a task: hour, receive time of the first record, path."""

    files: list[tuple[str, int, str]]


class RecordingWriter(DataSourceWriter):
    """A file per task and UTC hour, of rows (kind, received_at, payload) in the order they come; metadata, where given, leads every file.

    Records are written as they come, on any file system that pyarrow knows.
    Files get their names once all tasks are done: those of an hour are
    numbered by the receive time of their first record."""

    def __init__(self, options: dict) -> None:
        self.folder, self.metadata, self.parts = options["path"], options.get("metadata"), int(options.get("parts", 1))

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, folder = filesystem(self.folder)
        files.create_dir(folder, recursive=True)
        open_: dict[tuple[str, int], FileWriter] = {}
        written = []
        for r in rows:
            hour = hour_name(r["received_at"])
            key = (hour, r["received_at"] % _HOUR * self.parts // _HOUR)
            if key not in open_:
                path = f"{folder}/.{hour}-{uuid.uuid4().hex}{SUFFIX}"
                open_[key] = FileWriter(files.open_output_stream(path, compression=None))
                written.append((hour, r["received_at"], path))
                if self.metadata:
                    open_[key].write("metadata", r["received_at"], self.metadata.encode())
            open_[key].write(r["kind"], r["received_at"], bytes(r["payload"]))
        for writer in open_.values():
            writer.close()
        return _Written(written)

    def commit(self, messages: list) -> None:
        files, folder = filesystem(self.folder)
        seen: dict[str, int] = {}
        for hour, _, path in sorted(f for m in messages if m for f in m.files):
            n = seen[hour] = seen.get(hour, -1) + 1
            files.move(path, f"{folder}/{hour}{f'.{n:05d}' if n else ''}{SUFFIX}")

    def abort(self, messages: list) -> None:
        files, _ = filesystem(self.folder)
        for _, _, path in (f for m in messages if m for f in m.files):
            files.delete_file(path)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "msr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordingReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordingWriter(self.options)


def register(spark: SparkSession) -> None:
    reachable(spark)
    spark.dataSource.register(RecordingSource)


def read(spark: SparkSession, path: str, mode: str = "FAILFAST", kind: str | None = None) -> DataFrame:
    """Records of a file, a folder or a pattern; of one kind only where it is given."""
    register(spark)
    options = {"mode": mode} | ({"kind": kind} if kind else {})
    return spark.read.format("msr").options(**options).load(path)


def hour_of(received_at: Column) -> Column:
    """The name of the hourly file that a record belongs to, in UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(received_at / 1_000_000_000)), "yyyy-MM-dd'T'HH")


def snapshot_payload(symbol: str, last_id: int, bids: list, asks: list, truncated: bool) -> bytes:
    side = lambda levels: [{"Price": p, "Qty": q} for p, q in levels]
    return json.dumps({"Symbol": symbol, "LastID": last_id, "Bids": side(bids), "Asks": side(asks), "Truncated": truncated}, separators=(",", ":")).encode()


def frame_records(frames: DataFrame) -> DataFrame:
    """frames (received_at, data) as records."""
    return frames.select(F.lit("frame").alias("kind"), "received_at", F.col("data").cast("binary").alias("payload"))


def snapshot_records(snapshots: DataFrame) -> DataFrame:
    """snapshots (received_at, symbol, last_id, bids, asks, truncated) as records that a replay serves again."""
    side = lambda c: F.transform(c, lambda x: F.struct(x["price"].alias("Price"), x["qty"].alias("Qty")))
    body = F.to_json(F.struct(F.col("symbol").alias("Symbol"), F.col("last_id").alias("LastID"), side("bids").alias("Bids"), side("asks").alias("Asks"), F.coalesce("truncated", F.lit(False)).alias("Truncated")))
    return snapshots.select(F.lit("snapshot").alias("kind"), "received_at", body.cast("binary").alias("payload"))


def record(records: DataFrame, folder: str, metadata: str, parts: int = 1) -> None:
    """Write records to hourly files in order of receive time; every file begins with the metadata.

    Rows are dealt by hour, or by each of ``parts`` equal parts of one, so that
    a file is the same whatever the partitions were and a busy hour is shared
    by several tasks.  Files of an hour, read by name, are in order."""
    if not metadata or len(metadata.encode()) > LONGEST:
        raise ValueError("a recording needs metadata of at most 16 MiB")
    register(records.sparkSession)
    part = F.expr(f"pmod(received_at, {_HOUR}L) * {max(1, parts)} div {_HOUR}L")
    dealt = records.withColumns({"_hour": hour_of(F.col("received_at")), "_part": part}).repartition("_hour", "_part").sortWithinPartitions("_hour", "_part", "received_at")
    dealt.drop("_hour", "_part").write.format("msr").option("metadata", metadata).option("parts", str(max(1, parts))).mode("append").save(folder)
