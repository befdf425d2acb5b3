"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics are a few numpy passes over a batch's bytes.  Trees are grown on
binned statistics with gradient histograms, and flattened into arrays that a
batch walks through in one vectorised step per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import _store, _text
from tidebook.llm.language_id import held_out


@dataclass(frozen=True)
class Params:
    """sample: labelled rows that the trees are grown on at most, chosen by a hash of the id."""

    sample: int = 20_000
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    least: int = 5
    smoothing: float = 1.0


FEATURES = [
    "log_bytes", "log_words", "mean_word", "share_upper", "share_lower", "share_digit", "share_space", "share_beyond_ascii", "share_control",
    "share_stop", "share_comma", "share_bang", "share_bar", "share_symbol", "share_bracket", "share_quote_dash",
    "words_distinct", "words_repeated_next", "words_upper", "words_with_symbol", "words_single_byte", "log_longest_word",
    "lines_per_word", "lines_distinct", "mean_line", "words_plain_end",
]


def _class_table() -> np.ndarray:
    """A class for each byte: upper, lower, digit, space, beyond ASCII, control, and groups of marks."""
    table = np.full(256, 9, dtype=np.int64)
    table[65:91], table[97:123], table[48:58], table[128:] = 0, 1, 2, 4
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
    table[[c for c in range(32) if c not in range(9, 14)] + [127]] = 5
    for k, marks in ((6, "."), (7, ",;:"), (8, "!?"), (10, "|"), (11, "()[]{}<>"), (12, "'\"-_/\\")):
        table[[ord(c) for c in marks]] = k
    return table


_CLASS, _CLASSES = _class_table(), 13


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null counts as empty."""
    buf, at = _text.text_bytes(column)
    n, size = len(at) - 1, np.diff(at)
    text_of = np.repeat(np.arange(n), size)
    kind = _CLASS[buf]
    share = np.bincount(text_of * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, hashes, words = _text.words(buf, at, _text.space_words())
    count = np.diff(words)
    some = np.maximum(count, 1)
    own = np.repeat(np.arange(n), count)
    length = ends - starts
    per = lambda weights: np.bincount(own, weights, n) / some
    order = np.lexsort((hashes, own))
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (own[order][1:] != own[order][:-1])
    again = np.zeros(len(own), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    upto = lambda k: np.concatenate([[0], np.cumsum(kind == k)])
    upper, lower, symbol, bar, bang = (upto(k) for k in (0, 1, 9, 10, 8))
    inside = lambda total: total[ends] - total[starts]
    loud = (inside(upper) >= 2) & (inside(lower) == 0)
    marked = inside(symbol) + inside(bar) + inside(bang) > 0
    longest = np.zeros(n)
    if len(own):
        longest[count > 0] = np.maximum.reduceat(length, words[:-1][count > 0])
    line_starts, line_ends, line_hashes, lines = _text.words(buf, at, _LINE)
    line_count = np.diff(lines)
    line_own = np.repeat(np.arange(n), line_count)
    by_line = np.lexsort((line_hashes, line_own))
    new_line = np.ones(len(line_own), dtype=bool)
    new_line[1:] = (line_hashes[by_line][1:] != line_hashes[by_line][:-1]) | (line_own[by_line][1:] != line_own[by_line][:-1])
    some_lines = np.maximum(line_count, 1)
    plain_end = np.isin(kind[ends - 1], (0, 1, 4, 6, 7)) if len(ends) else np.zeros(0)
    columns = [
        np.log1p(size), np.log1p(count), per(length), share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5],
        share[:, 6], share[:, 7], share[:, 8], share[:, 10], share[:, 9], share[:, 11], share[:, 12],
        np.bincount(own[order], fresh, n) / some, per(again), per(loud), per(marked), per(length == 1), np.log1p(longest),
        line_count / some, np.bincount(line_own[by_line], new_line, n) / some_lines, np.log1p(size / some_lines), per(plain_end),
    ]
    return np.stack(columns, 1).astype(np.float32)


_LINE = np.ones(256, dtype=bool)
_LINE[[0x0A, 0x0D]] = False


@dataclass(frozen=True)
class Forest:
    """All trees in one set of arrays; a leaf points at itself and holds a value."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.repeat(self.roots[None], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, p: Params) -> Forest:
    """Boosting by the logistic loss; one class alone, or no rows, give a constant score."""
    positive = float(y.sum())
    base = float(np.log((positive + 1) / (len(y) - positive + 1)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if 0 < positive < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        offset = np.arange(x.shape[1]) * p.bins
        margin = np.full(len(y), base)
        for _ in range(p.trees):
            chance = 1 / (1 + np.exp(-margin))
            roots.append(len(nodes))
            nodes.append([0, 0, 0, 0, 0])
            todo = [(roots[-1], np.arange(len(y)), 0)]
            gradient, hessian = y - chance, chance * (1 - chance)
            while todo:
                at, rows, depth = todo.pop()
                total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
                best = (1e-6, -1, -1)
                if depth < p.depth and len(rows) >= 2 * p.least:
                    flat = (binned[rows] + offset).ravel()
                    shape = (x.shape[1], p.bins)
                    g = np.bincount(flat, np.repeat(gradient[rows], shape[0]), shape[0] * shape[1]).reshape(shape).cumsum(1)
                    h = np.bincount(flat, np.repeat(hessian[rows], shape[0]), shape[0] * shape[1]).reshape(shape).cumsum(1)
                    c = np.bincount(flat, minlength=shape[0] * shape[1]).reshape(shape).cumsum(1)
                    s = p.smoothing
                    gain = g**2 / (h + s) + (total_g - g) ** 2 / (total_h - h + s) - total_g**2 / (total_h + s)
                    gain[(c < p.least) | (len(rows) - c < p.least)] = 0
                    k = int(gain.argmax())
                    best = max(best, (float(gain.flat[k]), *divmod(k, p.bins)), key=lambda z: z[0])
                if best[1] < 0:
                    step = p.rate * total_g / (total_h + p.smoothing)
                    nodes[at] = [0, 0, at, at, step]
                    margin[rows] += step
                    continue
                goes = binned[rows, best[1]] <= best[2]
                nodes[at] = [best[1], float(edges[best[1]][best[2]]), len(nodes), len(nodes) + 1, 0]
                todo += [(len(nodes), rows[goes], depth + 1), (len(nodes) + 1, rows[~goes], depth + 1)]
                nodes += [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]
    a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return Forest(base, np.array(roots, dtype=np.int64), a[:, 0].astype(np.int64), a[:, 1].astype(np.float32), a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], p.depth)


def _with_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch):
                x = statistics(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<float>")


def labelled(labels: DataFrame, label: str, fold) -> DataFrame:
    """One label per doc_id outside the held-out fold; of repeated and differing labels the larger holds."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    return rows.where(~fold).groupBy("doc_id").agg(F.max("y").alias("y"))


def bounded(rows: DataFrame, most: int, seed: int = 1) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of doc_id."""
    n = rows.count()
    share = 1.0 if n <= most else most / n
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def one_text_each(rows: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, the column and y: of several texts (or their statistics) of an id that with the least hash."""
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(column, "y"), F.xxhash64(column)).alias("r")).select("doc_id", "r.*")


def fit(stats: DataFrame, labels: DataFrame, p: Params | None = None) -> Forest:
    """Grow trees from statistics (doc_id, x) and labels (doc_id, y)."""
    p = p or Params()
    chosen = bounded(labels, p.sample)
    rows = one_text_each(stats.join(F.broadcast(chosen), "doc_id"), "x").orderBy("doc_id").toArrow()
    x = np.array(rows["x"].combine_chunks().flatten(), dtype=np.float32).reshape(-1, len(FEATURES))
    return grow(x, rows["y"].to_numpy().astype(np.float64), p)


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(x))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, p: Params | None = None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (chance of label 1), predicted, for each row of docs.

    Labels are learnt from ids outside the held-out fold only.  Null and empty
    texts are scored by the statistics of an empty text, very long ones by those
    of the whole text; repeated rows get equal scores; a null doc_id is never
    held out; of an id with several texts one is learnt from, that with the
    least hash, of differing labels the larger.  Equally good splits go to the
    first statistic and the lowest threshold.  Without labels of both classes
    the score is a constant.  Only doc_id and text of docs are read; an empty
    table gives none."""
    p = p or Params()
    _store.shared_dir(docs.sparkSession)
    stats = _store.save(_with_statistics(docs), "statistics")
    forest = fit(stats, labelled(labels, "quality", held_out()), p)
    out = score(stats, forest)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
