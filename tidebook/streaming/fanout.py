"""Fan-out of events to subscribers: each has a query, a checkpoint and a bounded queue of its own."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Consume = Callable[[DataFrame, int], None]


def keep_newest(events: DataFrame, capacity: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """What a subscriber's queue keeps of a burst: the newest ``capacity`` events by arrival (of each of keys)."""
    newest = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("arrival"))
    if not keys:
        return events.orderBy(F.desc("arrival")).limit(capacity)
    return events.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= capacity).drop("_rank")


def dropped(events: DataFrame, capacity: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, kept, dropped: how many of a burst a queue of that capacity loses, the oldest first."""
    n = events.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.select(*keys, F.least("n", F.lit(capacity).cast("bigint")).alias("kept"), F.greatest(F.col("n") - capacity, F.lit(0).cast("bigint")).alias("dropped"))


class NotSettled(TimeoutError):
    """A query still had rows to take when the time was up."""


def settle(query: StreamingQuery, limit: float = 30.0, pause: float = 0.05, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
    """Wait until the query has taken all that is there, for ``limit`` seconds at most, and stop it; what it failed of is raised."""
    end = clock() + limit
    while query.isActive:
        status = query.status
        if not status["isDataAvailable"] and not status["isTriggerActive"] and query.lastProgress:
            break
        if clock() >= end:
            query.stop()
            raise NotSettled(f"not settled within {limit} seconds")
        sleep(pause)
    if query.exception() is not None:
        raise query.exception()
    query.stop()


@dataclass
class Publisher:
    """Subscribers are added before the start, under distinct names, with a positive capacity."""

    subscribers: dict[str, tuple[int, Consume]] = field(default_factory=dict)
    lost: dict[str, int] = field(default_factory=dict)
    running: list[StreamingQuery] = field(default_factory=list)
    started: bool = False

    def subscribe(self, name: str, capacity: int, consume: Consume) -> None:
        if self.started:
            raise RuntimeError("subscribers are added before the start")
        if capacity <= 0:
            raise ValueError("a queue needs a positive capacity")
        if name in self.subscribers:
            raise ValueError(f"a subscriber named {name} exists")
        self.subscribers[name], self.lost[name] = (capacity, consume), 0

    def start(self, events: DataFrame, checkpoints: str) -> None:
        """Start a query per subscriber over what is available; a burst is a micro-batch."""
        if self.started:
            raise RuntimeError("already started")
        self.started = True
        for name, (capacity, consume) in self.subscribers.items():

            def deliver(batch: DataFrame, number: int, name: str = name, capacity: int = capacity, consume: Consume = consume) -> None:
                batch.persist()  # counted, and then delivered
                try:
                    lost = max(0, batch.count() - capacity)
                    consume(keep_newest(batch, capacity), number)
                finally:
                    batch.unpersist()
                self.lost[name] += lost

            query = events.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{checkpoints}/{name}").trigger(availableNow=True)
            self.running.append(query.start())

    def depths(self) -> dict[str, int]:
        """Rows of the burst that each subscriber has last been handed: what has waited for it."""
        return {q.name or name: int((q.lastProgress or {}).get("numInputRows", 0)) for name, q in zip(self.subscribers, self.running, strict=False)}

    def close(self) -> None:
        """Wait until all that was available has been delivered; closing again does nothing."""
        while self.running:
            self.running.pop().awaitTermination()

    def dropped(self) -> dict[str, int]:
        return dict(sorted(self.lost.items()))
