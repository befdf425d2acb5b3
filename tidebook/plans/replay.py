"""A recording from its files to the dump of its books."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidebook import tables
from tidebook.operators import book
from tidebook.operators.decode import decode
from tidebook.operators.tracker import track
from tidebook.sources import replay
from tidebook.streaming import sinks


class Diverged(AssertionError):
    """Two replays of one recording gave different books."""


@dataclass(frozen=True)
class Result:
    """The dump, and counts of frames, of frames that could not be decoded, and of frames lost before recording."""

    dump: str
    frames: int
    decode_errors: int
    dropped: int


def run(spark: SparkSession, path: str, repeat: int = 1, mode: str = "FAILFAST") -> Result:
    """Replay the files of path ``repeat`` times from nothing; the dumps must be equal.

    Frames that cannot be decoded are counted and left out.  A symbol of which
    only trades were recorded has no book."""
    opened = replay.open_replay(spark, path, mode)
    decoded = tables.written(decode(opened.frames, opened.instruments).drop("data"), "decoded")
    frames, errors = decoded.agg(F.count("*"), F.count("decode_error")).first()
    events = replay.tracker_rows(decoded, opened.snapshots).where("kind <> 'trade'")
    dumps = set()
    for _ in range(max(1, repeat)):
        rows = tables.written(track(events, levels=True), "tracked")
        dumps.add(sinks.dump(book.tracked_view(rows), rows.where("side IS NOT NULL")))
        if len(dumps) > 1:
            raise Diverged(path)
    return Result(dumps.pop(), frames, errors, opened.dropped)
