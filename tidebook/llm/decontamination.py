"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words, a window into
shingles of ``shingle`` words.  A document contains a window only if it holds
all its shingles, so the join may probe the window's rarest shingle alone (the
prefix that full containment needs).  Rarity comes from counting the
benchmark's shingles over all documents.  A probe's position in its window
bounds where the window starts and ends in the document; what lies within the
document is compared word by word.

Windows up to a bound are held by every task.  More of them are joined by a
shuffle: documents are read three times, however large the benchmark is, and a
bitmap of the shingles that are looked for keeps most of theirs out of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import _store, _text

RUNS = "array<struct<first: long, last: long>>"


@dataclass(frozen=True)
class Params:
    """window, shingle: words. block_windows: benchmark windows held in a task's memory at most; those of
    a larger benchmark are joined by a shuffle. bitmap_bits: logarithm of the size of its bitmap."""

    window: int = 10
    shingle: int = 5
    block_windows: int = 100_000
    bitmap_bits: int = 27


def _words(column: pa.Array):
    buf, at = _text.text_bytes(column)
    starts, ends, hashes, words = _text.words(buf, at, _text.alnum_words())
    return buf, starts, ends, hashes, words


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(_text.LOWER[buf[s:e]].tobytes() for s, e in zip(starts, ends, strict=True))


def windows_of(benchmark: DataFrame, p: Params) -> DataFrame:
    """item_id, words (lower-cased, joined by spaces), n words, their hashes, for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch):
                buf, starts, ends, hashes, at = _words(part.column(1))
                out = []
                for i, item in enumerate(part.column(0).to_pylist()):
                    n = int(at[i + 1] - at[i])
                    size = min(n, p.window)
                    for s in range(at[i], at[i + 1] - size + 1) if n else ():
                        out.append((item, _joined(buf, starts[s : s + size], ends[s : s + size]), size, hashes[s : s + size].tobytes()))
                ids, text, size, raw = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(text, pa.binary()), pa.array(size, pa.int32()), pa.array(raw, pa.binary())], ["item_id", "words", "n", "hashes"])

    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item_id long, words binary, n int, hashes binary").distinct()


class _Block:
    """The windows of one pass: arrays sorted for searching."""

    def __init__(self, rows: list, p: Params) -> None:
        self.p = p
        self.words = [bytes(r["words"]) for r in rows]
        self.items = [list(r["items"]) for r in rows]
        self.n = np.array([r["n"] for r in rows], dtype=np.int64)
        self.hashes = np.zeros((len(rows), p.window), dtype=np.uint64)
        owner, place, value, size = [], [], [], []
        for i, r in enumerate(rows):
            h = np.frombuffer(bytes(r["hashes"]), dtype=np.uint64)
            self.hashes[i, : len(h)] = h
            k = min(p.shingle, len(h))
            s = _text.shingle_hashes(h, k)
            owner.append(np.full(len(s), i))
            place.append(np.arange(len(s)))
            value.append(s)
            size.append(np.full(len(s), k))
        self.owner, self.place, self.value, self.size = (np.concatenate(x) for x in (owner, place, value, size))
        self.tokens, self.token = np.unique(self.value, return_inverse=True)
        self.sizes = np.unique(self.size)

    def restrict(self, count: np.ndarray) -> None:
        """Keep the prefix of each window: its rarest shingle, the first of equally rare ones."""
        rank = np.lexsort((self.place, count[self.token], self.owner))
        first = np.concatenate([[True], self.owner[rank][1:] != self.owner[rank][:-1]])
        keep = rank[first]
        keep = keep[np.argsort(self.value[keep], kind="stable")]
        self.owner, self.place, self.value, self.size = (x[keep] for x in (self.owner, self.place, self.value, self.size))
        self.tokens = np.unique(self.value)
        self._filter = None

    def filter_bits(self) -> np.ndarray:
        if getattr(self, "_filter", None) is None:
            self._filter = np.zeros(1 << 22, dtype=bool)
            self._filter[(self.tokens >> np.uint64(42)).astype(np.int64)] = True
        return self._filter

    def probes(self, hashes: np.ndarray, at: np.ndarray, k: int):
        """Positions of document shingles of k words that are tokens, with their values, inside one text each."""
        runs = _text.shingle_hashes(hashes, k)
        hit = np.flatnonzero(self.filter_bits()[(runs >> np.uint64(42)).astype(np.int64)])
        if not len(hit):
            return hit, runs[hit]
        place = np.minimum(np.searchsorted(self.tokens, runs[hit]), len(self.tokens) - 1)
        hit = hit[self.tokens[place] == runs[hit]]
        text = np.searchsorted(at, hit, "right")
        hit = hit[hit + k <= at[text]]
        return hit, runs[hit]

    def matches(self, part: pa.Array):
        """Word offsets of the texts; and of each occurrence of a window: its first word and the window."""
        buf, starts, ends, hashes, at = _words(part)
        found = []
        for k in self.sizes:
            pos, value = self.probes(hashes, at, int(k))
            if not len(pos):
                continue
            lo, hi = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
            pos = np.repeat(pos, hi - lo)
            row = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            pos, row = pos[self.size[row] == k], row[self.size[row] == k]
            w, first = self.owner[row], pos - self.place[row]
            text = np.searchsorted(at, pos, "right") - 1
            inside = (first >= at[text]) & (first + self.n[w] <= at[text + 1])
            w, first = w[inside], first[inside]
            for j in range(self.p.window):
                same = (self.n[w] <= j) | (hashes[np.minimum(first + j, len(hashes) - 1)] == self.hashes[w, j])
                w, first = w[same], first[same]
            found += [(f, x) for f, x in zip(first.tolist(), w.tolist(), strict=True) if _joined(buf, starts[f : f + self.n[x]], ends[f : f + self.n[x]]) == self.words[x]]
        return at, found


def _counts(docs: DataFrame, block, p: Params) -> np.ndarray:
    """How often each shingle of the block occurs in all documents; one number per shingle of the block reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        total = np.zeros(len(b.tokens), dtype=np.int64)
        for batch in batches:
            for part in _text.slices(batch):
                _, _, _, hashes, at = _words(part.column(0))
                for k in b.sizes:
                    _, value = b.probes(hashes, at, int(k))
                    total += np.bincount(np.searchsorted(b.tokens, value), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(block.value.tokens), dtype=np.int64)
    out[rows["token"].to_numpy()] = rows["n"].to_numpy()
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, p: Params | None = None) -> DataFrame:
    """docs with n_words, hit_runs (disjoint runs of hit words: first, last) and hit_items (sorted item ids) added.

    Null and empty texts have no words, very long ones are searched whole; of
    equally rare shingles of a window the first is probed.  Repeated rows get
    equal results.  Items without an id or without words
    are ignored; equal item ids name one item.  Columns of docs pass through;
    those with the three added names are replaced.  Rows are kept one for one."""
    p = p or Params()
    spark = docs.sparkSession
    _store.shared_dir(spark)
    windows = windows_of(benchmark, p).groupBy("words", "n", "hashes").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = _store.save(windows.withColumn("w", F.monotonically_increasing_id()), "windows")
    added = ["n_words", "hit_runs", "hit_items"]
    out = docs.drop(*added)
    empty = {"hit_runs": F.array().cast(RUNS), "hit_items": F.array().cast("array<long>")}
    if windows.count() > p.block_windows:
        few = _store.small(_joined_hits(docs, windows, p))
        out = out.withColumns({"_k1": _key(0), "_k2": _key(1)}).join(few.toDF("_k1", "_k2", "_runs", "_items"), ["_k1", "_k2"], "left")
        out = out.withColumns({"n_words": F.lit(None).cast("long"), "hit_runs": F.coalesce("_runs", empty["hit_runs"]), "hit_items": F.coalesce("_items", empty["hit_items"])}).drop("_k1", "_k2", "_runs", "_items")
        return _marked(out, spark.sparkContext.broadcast(None))
    out = out.withColumns({"n_words": F.lit(None).cast("long")} | empty)
    rows = windows.collect()  # at most block_windows rows
    block = _Block(rows, p) if rows else None
    if block is not None:
        counted = spark.sparkContext.broadcast(block)
        block.restrict(_counts(docs, counted, p))
        counted.unpersist()
    return _marked(out, spark.sparkContext.broadcast(block))


def _key(seed: int):
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(text, F.lit(1)) if seed else F.xxhash64(text)


def _bitmap(tokens: DataFrame, p: Params) -> np.ndarray:
    """A bit for the first bits of each token; 2**(bitmap_bits - 6) words reach the driver at most."""
    at = F.shiftrightunsigned("token", 64 - p.bitmap_bits)
    words = tokens.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(token, {64 - p.bitmap_bits}) & 63 AS INT))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (p.bitmap_bits - 6), dtype=np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _hits(runs: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = runs >> np.uint64(64 - bits)
    return np.flatnonzero(bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))


def _probes(docs: DataFrame, held, sizes: list[int], p: Params, context: bool) -> DataFrame:
    """Shingles of docs that the bitmap lets through: token and their number in a batch; or, with context, text, token, first word of the context and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch):
                buf, starts, ends, hashes, at = _words(part.column(part.schema.get_field_index("text")))
                for k in sizes:
                    values = _text.shingle_hashes(hashes, k)
                    pos = _hits(values, held.value, p.bitmap_bits)
                    text = np.searchsorted(at, pos, "right") - 1
                    inside = pos + k <= at[text + 1]
                    pos, text = pos[inside], text[inside]
                    if not len(pos):
                        continue
                    if not context:
                        token, n = np.unique(values[pos].view(np.int64), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], ["token", "n"])
                        continue
                    lo, hi = np.maximum(at[text], pos - p.window + k), np.minimum(at[text + 1], pos + p.window)
                    for first in range(0, len(pos), 4096):
                        cut = slice(first, first + 4096)
                        words = [[_text.LOWER[buf[s:e]].tobytes() for s, e in zip(starts[f:t], ends[f:t], strict=True)] for f, t in zip(lo[cut], hi[cut], strict=True)]
                        keys = [part.column(c).take(pa.array(text[cut])) for c in (0, 1)]
                        columns = [*keys, pa.array(values[pos[cut]].view(np.int64)), pa.array(pos[cut] - at[text[cut]]), pa.array(lo[cut] - at[text[cut]]), pa.array(words, pa.list_(pa.binary())).cast(pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "token", "pos", "start", "context"])

    rows = docs.select(_key(0).alias("k1"), _key(1).alias("k2"), F.col("text").cast("string").alias("text")) if context else docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "k1 long, k2 long, token long, pos long, start long, context array<string>" if context else "token long, n long")


def _shingles(windows: DataFrame, p: Params) -> DataFrame:
    """w, token, place, k: the shingles of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(raw, dtype=np.uint64)
                k = min(p.shingle, len(h))
                out += [(w, t, i, k) for i, t in enumerate(_text.shingle_hashes(h, k).view(np.int64).tolist())]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["w", "token", "place", "k"])

    return windows.select("w", "hashes").mapInArrow(run, "w long, token long, place long, k long")


def _joined_hits(docs: DataFrame, windows: DataFrame, p: Params) -> DataFrame:
    """k1, k2, runs, items of the texts that hold a window."""
    spark = docs.sparkSession
    shingles = _store.save(_shingles(windows, p), "window-shingles")
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # as many as words in a shingle at most
    held = spark.sparkContext.broadcast(_bitmap(shingles.select("token").distinct(), p))
    counts = _probes(docs, held, sizes, p, False).groupBy("token").agg(F.sum("n").alias("n")).join(shingles.select("token").distinct(), "token", "left_semi")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "token", "k")).alias("r")
    prefix = _store.save(shingles.join(_store.save(counts, "shingle-counts"), "token", "left").groupBy("w").agg(rarest).select("w", "r.token", "r.place"), "prefixes")
    held.unpersist()
    held = spark.sparkContext.broadcast(_bitmap(prefix.select("token").distinct(), p))
    probe = prefix.join(windows.select("w", "n", F.col("words").cast("string").alias("words")), "w")
    found = _probes(docs, held, sizes, p, True).join(_store.small(_store.save(probe, "probes")), "token")
    first = F.col("pos") - F.col("place")
    own = F.array_join(F.slice("context", F.greatest(first - F.col("start") + 1, F.lit(1)).cast("int"), F.col("n")), " ")
    found = found.where((first >= F.col("start")) & (first - F.col("start") + F.col("n") <= F.size("context"))).where(own == F.col("words"))
    found = _store.save(found.select("k1", "k2", first.alias("first"), (first + F.col("n") - 1).alias("last"), "w").distinct(), "window-hits")
    runs = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    items = found.select("k1", "k2", "w").distinct().join(windows.select("w", F.explode("items").alias("item")), "w").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return _store.save(runs.join(items, ["k1", "k2"]), "contaminated")


def _marked(docs: DataFrame, held) -> DataFrame:
    names = docs.columns
    text, runs_at, items_at = names.index("text"), names.index("hit_runs"), names.index("hit_items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            for part in _text.slices(batch):
                column = part.column(text).cast(pa.string())
                at, found = b.matches(column) if b is not None else (_words(column)[4], [])
                runs: list[list] = [[(r["first"], r["last"]) for r in old or ()] for old in part.column(runs_at).to_pylist()]
                items: list[set] = [set(old or ()) for old in part.column(items_at).to_pylist()]
                for first, w in found:
                    i = int(np.searchsorted(at, first, "right")) - 1
                    runs[i].append((first - int(at[i]), first - int(at[i]) + int(b.n[w]) - 1))
                    items[i].update(b.items[w])
                columns = dict(zip(names, part.columns, strict=True))
                columns["n_words"] = pa.array(np.diff(at).astype(np.int64))
                columns["hit_runs"] = pa.array([[{"first": f, "last": t} for f, t in _merged(x)] for x in runs], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
                columns["hit_items"] = pa.array([sorted(x) for x in items], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(run, docs.schema)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, p: Params | None = None) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    return find_contamination(docs, benchmark, p).where("size(hit_items) = 0").select(*docs.columns)


def contamination_digest(docs: DataFrame, benchmark: DataFrame, p: Params | None = None) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark, p)
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda total, r: total + r["last"] - r["first"] + 1)
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
