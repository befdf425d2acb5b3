"""Arrow functions over many small groups at once.

A group per call costs about a millisecond whatever its size.  Here rows are
dealt by key and sorted, and a call gets all groups that end in a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Work = Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]


def map_groups(rows: DataFrame, keys: list[str], work: Work, schema: str, most: int = 4096) -> DataFrame:
    """work(rows of whole groups, offsets of the groups) for all groups of integer keys, about ``most`` rows at a time.

    A group must fit in memory: callers cut larger ones into blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(last: bool) -> pa.RecordBatch | None:
            if not held:
                return None
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            columns = [whole.column(whole.schema.get_field_index(k)).to_numpy() for k in keys]
            edge = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            at = np.concatenate([[0], edge, [len(whole)]])
            held.clear()
            if not last:
                at = at[:-1]
                held.append(whole.slice(at[-1]))
                whole = whole.slice(0, at[-1])
            return work(whole, at) if len(at) > 1 else None

        size = 0
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                held.append(batch.slice(first, most))
                size += held[-1].num_rows
                if size >= most:
                    out = ready(False)
                    size = sum(b.num_rows for b in held)
                    if out is not None:
                        yield out
        out = ready(True)
        if out is not None:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def close_pairs(at: np.ndarray, most: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs x < y inside each of the groups of at most ``most`` rows, a distance at a time."""
    size = np.diff(at)
    group = np.repeat(np.arange(len(size)), size)
    group[size[group] > most] = -1
    for d in range(1, min(most, int(size.max(initial=0)))):
        x = np.flatnonzero((group[:-d] == group[d:]) & (group[d:] >= 0))
        if len(x):
            yield x, x + d


def pair_chunks(at: np.ndarray, most: int = 64, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs x < y inside groups, about ``chunk`` at a time whatever the groups' sizes."""
    yield from close_pairs(at, most)
    for g in np.flatnonzero(np.diff(at) > most):
        lo, hi = int(at[g]), int(at[g + 1])
        step = max(1, chunk // (hi - lo))
        for first in range(lo, hi, step):
            x, y = np.meshgrid(np.arange(first, min(first + step, hi)), np.arange(first + 1, hi), indexing="ij")
            keep = x < y
            yield x[keep], y[keep]


def labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 over edges (x, y)."""
    label = np.arange(n)
    while len(x):
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label
