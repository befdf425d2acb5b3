"""Web archives of individually compressed records that share one Zstandard dictionary.

The dictionary is trained on a bounded sample of the records and embedded in a
skippable frame at the head of every archive, so that each file can be read by
itself.  Of pages with equal payloads one is stored, the others revisit it.
Tasks write archives to the shared folder under names of their own attempt and
report them in a manifest; only archives of attempts that succeeded are in it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import _store

#: Skippable frame that holds the dictionary of the frames after it.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"


@dataclass(frozen=True)
class Params:
    """dictionary: bytes at most. sample, sample_bytes: records the dictionary is trained on at most, and
    the bytes taken of a payload. archive: bytes of records before compression after which the next archive
    begins. least: payload bytes from which equal payloads are stored once. broadcast_rows: repeated
    digests that are broadcast at most; beyond, pages are joined with them by a shuffle."""

    dictionary: int = 64 << 10
    sample: int = 1000
    sample_bytes: int = 64 << 10
    level: int = 3
    archive: int = 64 << 20
    least: int = 0
    broadcast_rows: int = 100_000
    date: str = "2026-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(kind: str, page_id: int | None, digest: str) -> str:
    name = f"{kind}:{page_id}" if page_id is not None else f"{kind}:{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, p: Params) -> bytes:
    """One WARC record; a revisit keeps the response's HTTP headers and not its payload."""
    digest = digest_of(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(kind, page_id, digest)}", f"WARC-Date: {p.date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id('response', refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in fields.items()}
    return headers, rest[: int(headers["content-length"])]


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary; records too few or too alike for training serve as its raw content."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if len(raw) >= 8 else {}


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed with the dictionary at its head."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    reader, at = zstandard.ZstdDecompressor(**_dictionary(data[8 : 8 + size])), 8 + size
    view = memoryview(data)
    while at < len(data):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            part = view[at : at + (16 << 10)]
            out.append(frame.decompress(part))
            at += len(part)
        at -= len(frame.unused_data)
        yield b"".join(out)


def _typed(pages: DataFrame, p: Params) -> DataFrame:
    """page_id, url, html, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    many = keyed.where((F.octet_length("html") >= p.least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    many = _store.save(many, "repeated-payloads")
    joined = keyed.join(F.broadcast(many) if many.count() <= p.broadcast_rows else many, "digest", "left")
    revisit = (F.col("first") != F.col("page_id")) & (F.octet_length("html") >= p.least)
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, p: Params | None = None) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to archives in folder; returns their manifest.

    A null html is an empty payload, a null url is left out.  A page without an
    id is always a response and never revisited; rows that repeat the smallest
    page_id of their payload are all responses.  A payload of any length is one
    record, held whole by the task that writes it.  Other columns are not read.
    An empty table writes no archive.  folder is any URI that pyarrow's
    filesystems open on executors; by default one in the shared folder."""
    p = p or Params()
    spark = pages.sparkSession
    _store.shared_dir(spark)
    folder = folder or _store.new_path(spark, "archives")
    rows = _typed(pages, p)
    n = rows.count()
    share = 1.0 if n <= p.sample else p.sample / n
    some = rows.where((F.octet_length("html") <= p.sample_bytes) | F.lit(p.sample_bytes > 0)).where((F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    # Of a longer payload a piece is taken, at a place drawn by a hash.
    body, over = F.col("html").cast("binary"), F.octet_length("html") - p.sample_bytes
    at = F.when(over > 0, F.pmod(F.xxhash64("url", "page_id"), over + 1)).otherwise(0).cast("int")
    some = some.select("page_id", "url", "refers_to", F.substring(body, at + 1, F.lit(max(p.sample_bytes, 1))).alias("piece"))
    samples = [record("revisit" if r["refers_to"] is not None else "response", r["page_id"], r["url"], bytes(r["piece"]), r["refers_to"], p) for r in some.limit(2 * p.sample).collect()]
    held = spark.sparkContext.broadcast(train(sorted(samples), p.dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        raw = held.value
        writer = zstandard.ZstdCompressor(level=p.level, **_dictionary(raw))
        head = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
        parts: list[bytes] = []
        written = count = 0

        def close() -> pa.RecordBatch:
            fs.create_dir(base, recursive=True)
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name + ".part", compression=None) as out:
                for x in (head, *parts):
                    out.write(x)
            fs.move(name + ".part", name)
            return pa.RecordBatch.from_pylist([{"path": name, "records": count, "bytes": len(head) + sum(map(len, parts))}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                kind = "response" if refers_to.as_py() is None else "revisit"
                one = record(kind, page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), p)
                parts.append(writer.compress(one))
                written, count = written + len(one), count + 1
                if written >= p.archive:
                    yield close()
                    parts, written, count = [], 0, 0
        if parts:
            yield close()

    return _store.save(rows.mapInArrow(run, MANIFEST).withColumn("folder", F.lit(folder)), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload where asked for.

    The digest of a response is computed from the payload that was read."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = FileSystem.from_uri(row["folder"])
                with fs.open_input_stream(row["path"], compression=None) as f:
                    data = f.read()
                out: list[dict] = []
                for raw in frames(data):
                    headers, block = parse(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                        raise ValueError(f"record {headers['warc-record-id']} does not hold the payload it names")
                    ids = [int(headers[k]) if k in headers else None for k in ("warc-page-id", "warc-refers-to-page-id")]
                    out.append({"page_id": ids[0], "url": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": ids[1], "payload": payload if payloads and kind == "response" else None})
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, pa.schema(fields))
                        out = []
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    n = max(1, manifest.count())
    found = manifest.select("folder", "path").repartition(min(n, 10_000)).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return found if payloads else found.drop("payload")


def warc_digest(pages: DataFrame, p: Params | None = None) -> DataFrame:
    return read_archives(write_archives(pages, None, p)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
