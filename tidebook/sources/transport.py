"""Seams of a live connection: addresses, retry waits, and fetches through a function that is handed in."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

#: Fixed stream names of a venue's public feed.
STREAMS = ("aggTrade", "depth@100ms")
SHUTDOWN = b"serverShutdown"
MOST_LEVELS, QUOTED = 5000, 512

Fetch = Callable[[str], tuple[int, bytes]]


class Source(Protocol):
    """Live and replayed frames look alike downstream."""

    def frames(self) -> Iterator[tuple[int, bytes]]: ...


class FetchFailed(RuntimeError):
    """The venue answered with another status than 200."""


def stream_path(symbols: Sequence[str], raw_of: dict[str, str]) -> str:
    """The combined stream of all symbols' trades and updates."""
    if not symbols:
        raise ValueError("no symbols")
    missing = [s for s in symbols if s not in raw_of]
    if missing:
        raise LookupError(f"unknown symbols: {', '.join(missing)}")
    return "/stream?streams=" + "/".join(f"{raw_of[s].lower()}@{name}" for s in symbols for name in STREAMS)


def parse_symbols(texts: Iterable[str]) -> list[str]:
    """BASE-QUOTE symbols, trimmed and in upper case; malformed or repeated ones are refused."""
    out: list[str] = []
    for text in texts:
        s = text.strip().upper()
        base, dash, quote = s.partition("-")
        if not (base and dash and quote) or "-" in quote:
            raise ValueError(f"{text!r} is not BASE-QUOTE")
        if s in out:
            raise ValueError(f"{s} is given twice")
        out.append(s)
    return out


@dataclass
class Backoff:
    """Waits that double up to a cap, each with up to a quarter more at random; a delivered frame starts them anew."""

    first: float = 0.5
    cap: float = 60.0
    chance: Callable[[], float] = random.random
    now: float = field(default=0.0, init=False)

    def base(self) -> float:
        self.now = min(self.now * 2, self.cap) if self.now else self.first
        return self.now

    def wait(self) -> float:
        return self.base() * (1 + 0.25 * self.chance())

    def delivered(self) -> None:
        self.now = 0.0


def is_shutdown(frame: bytes) -> bool:
    """A frame that announces the server's end: not passed on; the client reconnects at once."""
    return SHUTDOWN in frame


@dataclass
class Connection:
    """A feed that is held up by reconnecting. dial() connects and yields frames until the connection ends or fails; which client does so is the caller's.

    After a connection has delivered a frame the waits begin anew; a frame that
    announces the server's end is not passed on and no wait follows it."""

    dial: Callable[[], Iterable[bytes]]
    clock: Callable[[], int] = time.time_ns
    sleep: Callable[[float], None] = time.sleep
    stopped: Callable[[], bool] = lambda: False
    backoff: Backoff = field(default_factory=Backoff)
    connects: int = 0

    def frames(self) -> Iterator[tuple[int, bytes]]:
        """Receive times and frames, over all connections, until stopped."""
        while not self.stopped():
            self.connects += 1
            planned = False
            try:
                for frame in self.dial():
                    if self.stopped():
                        return
                    if is_shutdown(frame):
                        planned = True
                        break
                    self.backoff.delivered()
                    yield self.clock(), frame
            except (OSError, EOFError):
                pass
            if planned:
                self.backoff.delivered()
            elif not self.stopped():
                self.sleep(self.backoff.wait())

    @property
    def reconnects(self) -> int:
        return max(0, self.connects - 1)


def depth_limit(limit: int) -> int:
    return limit if 0 < limit <= MOST_LEVELS else MOST_LEVELS


def _fetched(fetch: Fetch, path: str) -> bytes:
    status, body = fetch(path)
    if status != 200:
        raise FetchFailed(f"{path}: status {status}: {body[:QUOTED].decode(errors='replace')}")
    return body


def depth_body(fetch: Fetch, raw: str, limit: int = 0) -> bytes:
    return _fetched(fetch, f"/api/v3/depth?symbol={raw}&limit={depth_limit(limit)}")


def metadata_body(fetch: Fetch, raws: Sequence[str] = ()) -> bytes:
    names = ",".join(f'"{r}"' for r in raws)
    return _fetched(fetch, "/api/v3/exchangeInfo" + (f"?symbols=[{names}]" if raws else ""))
