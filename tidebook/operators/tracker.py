"""The one stateful operator: a book per symbol through gaps and resynchronisation.

``Tracker`` is the transition function on plain values; ``TrackerProcessor``
keeps one per symbol in a state store and runs it alike over a batch and a
stream.  Snapshots come as rows of the same input; each is served once, in
recorded order, when the tracker asks for one.
"""

from __future__ import annotations

import pickle
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebook.workers import reachable

BUFFER = 2048
Levels = list[tuple[int, int]]

EVENT_SCHEMA = "symbol string, arrival bigint, kind string, first_id bigint, last_id bigint, truncated boolean, bids array<struct<price: bigint, qty: bigint>>, asks array<struct<price: bigint, qty: bigint>>"
OUTPUT_SCHEMA = "symbol string, arrival bigint, status string, live boolean, last_id bigint"
VIEW_SCHEMA = "symbol string, live boolean, last_id bigint, bid_floor bigint, ask_ceil bigint, side string, price bigint, qty bigint"
COUNTER_SCHEMA = "symbol string, live boolean, last_id bigint, held bigint, family string, value bigint"
#: Counters of a tracker, in the order in which they are shown.
FAMILIES = ("applied", "discarded", "buffered", "gapped", "dropped", "refetches", "resyncs")


def _valid(*sides: Levels) -> bool:
    return all(price > 0 and qty >= 0 for side in sides for price, qty in side)


@dataclass
class Tracker:
    """A symbol's book, its position in the update ids, and what waits for a snapshot."""

    symbol: str
    capacity: int = BUFFER
    last: int = 0
    live: bool = False
    bids: dict[int, int] = field(default_factory=dict)
    asks: dict[int, int] = field(default_factory=dict)
    bid_floor: int | None = None
    ask_ceil: int | None = None
    fetching: bool = False
    held: deque = field(default_factory=deque)
    counts: Counter = field(default_factory=Counter)

    def _hold(self, delta: tuple) -> None:
        if len(self.held) >= self.capacity:
            self.held.popleft()
            self.counts["dropped"] += 1
        self.held.append(delta)

    def _write(self, bids: Levels, asks: Levels) -> None:
        for book, side in ((self.bids, bids), (self.asks, asks)):
            for price, qty in side:
                if qty:
                    book[price] = qty
                else:
                    book.pop(price, None)

    def _advance(self, delta: tuple) -> str:
        """stale, contiguous, invalid or gapped; position and book move only with a valid contiguous update."""
        first, last, bids, asks = delta
        if last <= self.last:
            return "stale"
        if first > self.last + 1:
            self.live = False
            return "gapped"
        self.last = last
        if not _valid(bids, asks):
            self.live = False
            return "invalid"
        self._write(bids, asks)
        return "contiguous"

    def apply(self, symbol: str, first: int, last: int, bids: Levels, asks: Levels) -> str:
        """applied, discarded, buffered, gapped or error."""
        if symbol != self.symbol:
            return "error"
        delta = (first, last, bids, asks)
        if not self.live:
            self._hold(delta)
            self.counts["buffered"] += 1
            return "buffered"
        met = self._advance(delta)
        if met in ("gapped", "invalid"):
            self._hold(delta)
        status = {"stale": "discarded", "contiguous": "applied", "gapped": "gapped", "invalid": "error"}[met]
        if status != "error":
            self.counts[status] += 1
        return status

    def begin_fetch(self) -> bool:
        """Whether to ask for a snapshot now; at most one is asked for at a time."""
        if self.fetching or self.live:
            return False
        self.fetching = True
        return True

    def fetch_failed(self) -> None:
        self.fetching = False

    def load(self, symbol: str, last: int, bids: Levels, asks: Levels, truncated: bool = False) -> str:
        """anchored, behind, refetch (too old for what is held) or error."""
        self.fetching = False
        if symbol != self.symbol:
            return "error"
        if self.live and last < self.last:
            return "behind"
        kept = [[x for x in side if x[1]] for side in (bids, asks)]
        if not _valid(bids, asks) or any(len({p for p, _ in side}) < len(side) for side in kept):
            return "error"
        self.bids, self.asks = dict(kept[0]), dict(kept[1])
        self.last, self.live = last, True
        self.bid_floor = min((p for p, _ in bids), default=None) if truncated else None
        self.ask_ceil = max((p for p, _ in asks), default=None) if truncated else None
        while self.held:
            met = self._advance(self.held[0])
            if met == "gapped":
                self.counts["refetches"] += 1
                return "refetch"
            if met == "invalid":
                return "error"
            self.held.popleft()
        self.counts["resyncs"] += 1
        return "anchored"

    def levels(self) -> Iterator[tuple[str, int, int]]:
        """Both sides, the touch first."""
        yield from (("B", p, self.bids[p]) for p in sorted(self.bids, reverse=True))
        yield from (("A", p, self.asks[p]) for p in sorted(self.asks))


@dataclass
class Desk:
    """A tracker with the snapshots that wait to be served to it."""

    tracker: Tracker
    snapshots: deque = field(default_factory=deque)

    def _serve(self) -> list[str]:
        out = []
        while self.snapshots and self.tracker.begin_fetch():
            out.append(self.tracker.load(self.tracker.symbol, *self.snapshots.popleft()))
        return out

    def handle(self, row: Row) -> list[str]:
        """The statuses that one input row leads to."""
        bids, asks = ([(x["price"], x["qty"]) for x in row[c] or ()] for c in ("bids", "asks"))
        if row["kind"] == "trade":
            return ["trade"]
        if row["kind"] == "snapshot":
            self.snapshots.append((row["last_id"], bids, asks, bool(row["truncated"])))
            return ["snapshot", *self._serve()]
        early = self._serve()
        return [*early, self.tracker.apply(row["symbol"], row["first_id"], row["last_id"], bids, asks), *self._serve()]


class TrackerProcessor(StatefulProcessor):
    """A desk per symbol, kept as one value; rows of a batch are taken in order of arrival."""

    def __init__(self, shown: str, capacity: int) -> None:
        self.shown, self.capacity = shown, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("desk", "desk binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        desk = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else Desk(Tracker(key[0], self.capacity))
        tracker = desk.tracker
        for row in sorted(rows, key=lambda r: r["arrival"]):
            for status in desk.handle(row):
                if self.shown == "statuses":
                    yield Row(symbol=key[0], arrival=row["arrival"], status=status, live=tracker.live, last_id=tracker.last)
        self.state.update((pickle.dumps(desk),))
        if self.shown == "levels":
            for side, price, qty in list(tracker.levels()) or [(None, None, None)]:
                yield Row(symbol=key[0], live=tracker.live, last_id=tracker.last, bid_floor=tracker.bid_floor, ask_ceil=tracker.ask_ceil, side=side, price=price, qty=qty)
        if self.shown == "counters":
            for family in FAMILIES:
                yield Row(symbol=key[0], live=tracker.live, last_id=tracker.last, held=len(tracker.held), family=family, value=tracker.counts[family])

    def close(self) -> None:
        """Nothing is held open."""


def _run(events: DataFrame, shown: str, schema: str, capacity: int) -> DataFrame:
    reachable(events.sparkSession)
    _ = events.sparkSession.streams.active  # starts the coordinator of state stores, which a batch needs too
    return events.groupBy("symbol").transformWithState(TrackerProcessor(shown, capacity), outputStructType=schema, outputMode="Append" if shown == "statuses" else "Update", timeMode="None")


def track(events: DataFrame, levels: bool = False, capacity: int = BUFFER) -> DataFrame:
    """Run a tracker per symbol over events (EVENT_SCHEMA), batch or stream.

    Returns a row per status, or with ``levels`` each symbol's book as it
    stands after the rows at hand, with the bounds within which a truncated
    snapshot lets it be known; an empty book is a row without a level."""
    return _run(events, "levels" if levels else "statuses", VIEW_SCHEMA if levels else OUTPUT_SCHEMA, capacity)


def counters(events: DataFrame, capacity: int = BUFFER) -> DataFrame:
    """A row per symbol and counter of FAMILIES after the rows at hand, with the number of updates that wait for a snapshot."""
    return _run(events, "counters", COUNTER_SCHEMA, capacity)


def positions(levels: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of tracked books (VIEW_SCHEMA) what a comparison with snapshots (symbol, snapshot_id) needs: positions, and the bounds of the books."""
    at = levels.groupBy("symbol").agg(F.first("live").alias("live"), F.first("last_id").alias("local_id"), F.first("bid_floor").alias("bid_floor"), F.first("ask_ceil").alias("ask_ceil"))
    return at.join(snapshots, "symbol").select("symbol", "live", "local_id", "snapshot_id"), at.select("symbol", "bid_floor", "ask_ceil")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("symbol", "status").agg(F.count("*").alias("n"))
