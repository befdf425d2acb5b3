"""Replay of recordings: frames, snapshots and metadata of several files as DataFrames of one order."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.operators.decode import decode, parse_instruments
from tidebook.sources import recording

#: Fixed field names of a recorded snapshot.
SNAPSHOT = "Symbol string, LastID bigint, Bids array<struct<Price: bigint, Qty: bigint>>, Asks array<struct<Price: bigint, Qty: bigint>>, Truncated boolean"


class NoMetadata(ValueError):
    """No file holds instrument metadata, without which frames cannot be decoded."""


@dataclass(frozen=True)
class Replay:
    """frames (arrival, received_at, data), snapshots, instruments, and the sum of recorded drops; all in file order, then record order."""

    frames: DataFrame
    snapshots: DataFrame
    instruments: DataFrame
    dropped: int


def arrival(records: DataFrame) -> DataFrame:
    """records with ``arrival``: files in the order of their names, then records as they lie in the file."""
    return records.withColumn("arrival", F.col("file_no") * (1 << 40) + F.col("idx"))


def open_replay(spark: SparkSession, path: str, mode: str = "FAILFAST") -> Replay:
    """The first metadata holds for all files; a second one is not read."""
    rows = lambda kind: arrival(recording.read(spark, path, mode, kind))
    meta = rows("metadata").orderBy("arrival").limit(1)
    if meta.isEmpty():
        raise NoMetadata(path)
    body = meta.select(F.col("payload").cast("string").alias("body"))
    snap = rows("snapshot").select("arrival", "received_at", F.from_json(F.col("payload").cast("string"), SNAPSHOT).alias("s"))
    pairs = lambda side: F.transform(f"s.{side}", lambda x: F.struct(x["Price"].alias("price"), x["Qty"].alias("qty")))
    snapshots = snap.select("arrival", "received_at", F.col("s.Symbol").alias("symbol"), F.col("s.LastID").alias("last_id"), pairs("Bids").alias("bids"), pairs("Asks").alias("asks"), F.col("s.Truncated").alias("truncated"))
    frames = rows("frame").select("arrival", "received_at", F.col("payload").cast("string").alias("data"))
    dropped = rows("drop").agg(F.coalesce(F.sum("dropped"), F.lit(0))).first()[0]
    return Replay(frames, snapshots, parse_instruments(body), int(dropped))


def serve_order(snapshots: DataFrame) -> DataFrame:
    """snapshots with ``serve``: the number, from 1, at which each is handed out for its symbol; none is handed out twice."""
    return snapshots.withColumn("serve", F.row_number().over(Window.partitionBy("symbol").orderBy("arrival")))


def symbols(snapshots: DataFrame) -> DataFrame:
    """Recorded symbols, ascending, with the number of their snapshots."""
    return snapshots.groupBy("symbol").agg(F.count("*").alias("snapshots")).orderBy("symbol")


def tracker_rows(decoded: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Input rows of the tracker: decoded updates and trades, and all snapshots ahead of them in recorded order."""
    columns = ["symbol", "arrival", "kind", "first_id", "last_id", "truncated", "bids", "asks"]
    good = decoded.where("decode_error IS NULL").withColumn("truncated", F.lit(None).cast("boolean"))
    first = snapshots.withColumns({"kind": F.lit("snapshot"), "first_id": F.lit(None).cast("bigint"), "arrival": F.col("arrival") - (1 << 60)})
    return good.select(*columns).unionByName(first.select(*columns))


def tracker_events(replay: Replay) -> DataFrame:
    """tracker_rows of a replay."""
    return tracker_rows(decode(replay.frames, replay.instruments), replay.snapshots)


def paced(frames: DataFrame, speed: float) -> DataFrame:
    """frames with ``due``: nanoseconds after the first at which each is due at that speed; 0 for a speed of 0 or less."""
    start = frames.agg(F.min("received_at").alias("_start"))
    if speed <= 0:
        return frames.withColumn("due", F.lit(0).cast("bigint"))
    return frames.join(F.broadcast(start)).withColumn("due", F.floor((F.col("received_at") - F.col("_start")) / speed).cast("bigint")).drop("_start")


def emit(frames: DataFrame, speed: float, clock: Callable[[], int] = time.monotonic_ns, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, str]]:
    """Receive times and frames in order of arrival, each when it is due at that speed (at once for a speed of 0 or less): a replay that looks like a live feed.

    Rows come to the driver a partition at a time, as a live client's would."""
    began = clock()
    for row in paced(frames, speed).orderBy("arrival").select("received_at", "data", "due").toLocalIterator():
        ahead = row["due"] - (clock() - began)
        if ahead > 0:
            sleep(ahead / 1e9)
        yield row["received_at"], row["data"]
