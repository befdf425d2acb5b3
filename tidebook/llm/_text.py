"""Byte-level text helpers shared by the operators of this subpackage.

Texts arrive as Arrow string arrays.  Their UTF-8 bytes are handled as one
``uint8`` array with offsets, so that splitting into words and hashing them are
a few numpy passes for a whole batch instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_RNG = np.random.RandomState(20260115)
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
#: A random 64-bit value per byte; upper-case ASCII letters share their lower-case value.
_BYTE_VALUE = np.array([int.from_bytes(_RNG.bytes(8), "little") for _ in range(256)], dtype=np.uint64)[LOWER]


def space_words() -> np.ndarray:
    """Word bytes are all but space and tab to carriage return."""
    table = np.ones(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table


def alnum_words() -> np.ndarray:
    """Word bytes are ASCII letters and digits and everything beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different seeds give independent hashes."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + _BASE) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, SEGMENT + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_POWERS = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 2 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` text bytes; one longer text is a part of its own, and no part has more than ``rows`` rows."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(at, at[first] + most, "right")) - 1
        end = min(max(end, first + 1), batch.num_rows, first + rows)
        yield batch.slice(first, end - first)
        first = end


def word_spans(buf: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words end where their text ends."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edge = at[(at < len(buf)) & (at >= 0)]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge[edge > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _POWERS.to(len(buf))
    total = np.empty(len(buf) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_VALUE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased bytes of ascending, disjoint spans."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + SEGMENT, "right")), first + 1)
        hashes[first:last] = _hash_spans(buf[base : ends[last - 1]], starts[first:last] - base, ends[first:last] - base)
        first = last
    return hashes


def words(buf: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes (of the lower-cased bytes) of all words, and the offsets of each text's words.

    Long inputs are hashed in segments that end between words, so that memory
    follows the segment and not the text."""
    starts, ends = word_spans(buf, at, word)
    return starts, ends, hash_spans(buf, starts, ends), np.searchsorted(starts, at)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k word hashes, whatever text it lies in: len(hashes) - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[j : j + n]
    return mix(out, k)


def shingle_sets(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, concatenated, and their offsets.

    A text of fewer than k words, but not none, has one shingle of all its words."""
    runs = shingle_hashes(hashes, k)
    parts, sizes = [], np.zeros(len(at) - 1, dtype=np.int64)
    for i in range(len(at) - 1):
        n = at[i + 1] - at[i]
        if n >= k:
            one = np.sort(runs[at[i] : at[i + 1] - k + 1])
            if len(one) > 1:
                keep = np.empty(len(one), dtype=bool)
                keep[0] = True
                np.not_equal(one[1:], one[:-1], out=keep[1:])
                one = one[keep]
        elif n:
            one = shingle_hashes(hashes[at[i] : at[i + 1]], int(n))
        else:
            continue
        parts.append(one)
        sizes[i] = len(one)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])
