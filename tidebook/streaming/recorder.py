"""Recording beside a live feed: a bounded queue that never holds up the feed, and marks in the recording where records were lost."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.sources import recording

QUEUE = 4096


class Recorder:
    """Takes frames and snapshots without waiting; a thread writes them to hourly files.

    While ``capacity`` records wait, new ones are dropped and counted, and a
    marker with their number goes ahead of the next record that is written.
    Every file begins with the metadata."""

    def __init__(self, folder: str, metadata: str, capacity: int = QUEUE) -> None:
        if not metadata or len(metadata.encode()) > recording.LONGEST:
            raise ValueError("a recording needs metadata of at most 16 MiB")
        if capacity <= 0:
            raise ValueError("a queue needs a positive capacity")
        self.folder, self.metadata, self.capacity = folder, metadata.encode(), capacity
        self.waiting: deque = deque()
        self.ready = threading.Condition()
        self.dropped = self.marked = self.written = 0
        self.closed = False
        self.thread: threading.Thread | None = None
        self.failed: Exception | None = None

    def offer(self, kind: str, received_at: int, payload: bytes) -> bool:
        """Whether the record was taken; it never waits for the disk."""
        with self.ready:
            if self.closed or len(self.waiting) >= self.capacity:
                self.dropped += 1
                return False
            self.waiting.append((kind, received_at, payload))
            self.ready.notify()
            return True

    def tee(self, fetch: Callable[[str], tuple], received_at: Callable[[], int]) -> Callable[[str], tuple]:
        """fetch(symbol) -> (last_id, bids, asks, truncated) that also records each snapshot it gives."""

        def fetched(symbol: str) -> tuple:
            found = fetch(symbol)
            self.offer("snapshot", received_at(), recording.snapshot_payload(symbol, *found))
            return found

        return fetched

    def start(self) -> None:
        if self.thread is not None:
            raise RuntimeError("already started")
        self.thread = threading.Thread(target=self._run, name="recorder", daemon=True)
        self.thread.start()

    def _run(self) -> None:
        writer, hour = None, ""
        files, folder = recording.filesystem(self.folder)
        files.create_dir(folder, recursive=True)
        try:
            while True:
                with self.ready:
                    while not self.waiting and not self.closed:
                        self.ready.wait()
                    if not self.waiting:
                        return
                    kind, at, payload = self.waiting.popleft()
                    lost = self.dropped - self.marked
                if recording.hour_name(at) != hour:
                    if writer is not None:
                        writer.close()
                    hour = recording.hour_name(at)
                    writer = recording.FileWriter(files.open_output_stream(f"{folder}/{hour}{recording.SUFFIX}", compression=None))
                    writer.write("metadata", at, self.metadata)
                if lost:
                    writer.write("drop", at, recording.drop_marker(lost))
                    self.marked += lost
                writer.write(kind, at, payload)
                self.written += 1
        except Exception as e:  # noqa: BLE001  told by close(); the feed goes on
            self.failed = e
            with self.ready:
                self.closed = True
        finally:
            if writer is not None:
                writer.close()

    def close(self) -> None:
        """Write what waits and end the file; closing again does nothing."""
        with self.ready:
            self.closed = True
            self.ready.notify()
        if self.thread is not None:
            self.thread.join()
        if self.failed is not None:
            raise self.failed


def keep_oldest(records: DataFrame, capacity: int, burst: str) -> DataFrame:
    """What a recorder's queue keeps of each burst (a column) of records (arrival, received_at, ..): the oldest ``capacity``, by arrival, with dropped null;
    and for a burst that loses some a marker: the arrival and receive time of the first one lost, dropped their number, and all else null.

    A burst is bounded by its nature: what comes in between two writes."""
    own = Window.partitionBy(burst)
    rows = records.withColumns({"_rank": F.row_number().over(own.orderBy("arrival")), "_all": F.count("*").over(own)}).where(F.col("_rank") <= capacity + 1)
    lost = F.col("_rank") > capacity
    kept = [F.col(c) if c in ("arrival", "received_at", burst) else F.when(~lost, F.col(c)).alias(c) for c in records.columns]
    return rows.select(*kept, F.when(lost, F.col("_all") - capacity).alias("dropped"))
