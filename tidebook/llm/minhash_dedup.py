"""Near-duplicate documents by HyperMinHash.

Each document's shingle set is hashed into ``bands * rows`` buckets; a bucket
keeps the smallest hash as a 16-bit register: its leading-zero count and ten
mantissa bits after the leading one.  Bands of registers propose candidates, a
collision-corrected Jaccard estimate from the registers drops most wrong ones,
and the rest is confirmed on the full shingle sets.

No step emits the pairs of a group.  Documents with equal sets are one node.  In each band bucket all members are first compared with the smallest id
only.  Buckets that still hold several components are then compared member by
member, inside blocks of bounded size, and families of estimated neighbours
are confirmed block by block; tasks emit spanning links only.  A family of more
than one block is read once per block pair, so it costs time in its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import _store, _text
from tidebook.llm._groups import close_pairs, labels, map_groups
from tidebook.llm.components import connected_components, id_components, repeated_ids

#: Chance that two different minima share leading zeros and the first r mantissa bits, times 2**r.
COLLISION = 0.1699
MANTISSA_BITS = 10


@dataclass(frozen=True)
class Params:
    """words: per shingle; percent: Jaccard threshold in hundredths; bands * rows: registers.

    slack: standard deviations of the estimate below the threshold that still
    lead to confirmation on full sets.  block: members compared in one task."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 8
    slack: float = 4.0
    block: int = 1024
    block_bytes: int = 8 << 20

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def registers_of(sets: np.ndarray, at: np.ndarray, p: Params) -> np.ndarray:
    """A row of 16-bit registers for each set; 0 marks a bucket without shingles."""
    out = np.zeros((len(at) - 1, p.registers), dtype=np.uint16)
    if not len(sets):
        return out
    bucket = ((sets >> np.uint64(32)) * np.uint64(p.registers) >> np.uint64(32)).astype(np.int64)
    key = np.repeat(np.arange(len(at) - 1), np.diff(at)) * p.registers + bucket
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    least = np.minimum.reduceat(_text.mix(sets, 7), first)
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 62)
    mantissa = (least << zeros.astype(np.uint64)) >> np.uint64(63 - MANTISSA_BITS)
    out.reshape(-1)[key[first]] = 1 + (zeros << MANTISSA_BITS) + (mantissa.astype(np.int64) & ((1 << MANTISSA_BITS) - 1))
    return out


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the number of buckets each rests on."""
    used = ((x > 0) | (y > 0)).sum(-1)
    same = ((x == y) & (x > 0)).sum(-1)
    return np.maximum(same - used * COLLISION / (1 << MANTISSA_BITS), 0) / np.maximum(used, 1), used


def _plausible(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, p: Params) -> np.ndarray:
    j = p.percent / 100
    guess, used = estimate(x, y)
    return (guess >= j - p.slack * np.sqrt(j * (1 - j) / np.maximum(used, 1))) & (np.minimum(nx, ny) * 100 >= p.percent * np.maximum(nx, ny))


def sets_of(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    buf, at = _text.text_bytes(column)
    _, _, hashes, words = _text.words(buf, at, _text.space_words())
    return _text.shingle_sets(hashes, words, p.words)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (total[at[1:]] - total[at[:-1]]).astype(np.int64)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a 128-bit fingerprint of the shingle set, and the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch):
                sets, at = sets_of(part.column(1), p)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(at)), pa.array(_sums(_text.mix(sets, 11), at)), pa.array(_sums(_text.mix(sets, 12), at)), _binary(registers_of(sets, at, p))],
                    ["doc_id", "th", "n_shingles", "fp1", "fp2", "regs"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, th long, n_shingles long, fp1 long, fp2 long, regs binary")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and th: two rows of an id differ in th where they differ in text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th"))


def _bands(sigs: DataFrame, p: Params) -> DataFrame:
    width = 2 * p.rows
    empty = F.expr(f"unhex('{'00' * width}')")
    parts = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.when(F.substring(F.col("regs"), i * width + 1, F.lit(width)) != empty, F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width)))))
    return sigs.select("doc_id", F.explode(F.filter(parts, lambda k: k.isNotNull())).alias("key"))


def _estimated(pairs: DataFrame, sigs: DataFrame, p: Params) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), dtype=np.uint16).reshape(-1, p.registers) for k in (2, 3))
                keep = _plausible(x, y, part.column(4).to_numpy(), part.column(5).to_numpy(), p)
                yield part.select([0, 1]).filter(pa.array(keep))

    side = lambda k: sigs.select(F.col("doc_id").alias(k), F.col("regs").alias(f"regs_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _texts_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame, again: bool) -> DataFrame:
    """The text of each of nodes (doc_id, a node, and other columns): that of the row its class goes by; again: whether rows may repeat."""
    named = nodes.join(reps.select(F.col("node").alias("doc_id"), "rep", "th"), "doc_id")
    texts = _texts(docs).withColumnRenamed("doc_id", "rep").join(_store.small(_store.save(named, "wanted")), ["rep", "th"])
    texts = texts.drop("rep", "th")
    return texts.dropDuplicates(["doc_id"]) if again else texts


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, again: bool, p: Params) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in _text.slices(batch, "text_a"):
                for part in _text.slices(whole, "text_b"):
                    (x, xa), (y, ya) = sets_of(part.column(2), p), sets_of(part.column(3), p)
                    keep = [_linked(x[xa[i] : xa[i + 1]], y[ya[i] : ya[i + 1]], p) for i in range(part.num_rows)]
                    yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = _texts_of(ids, reps, docs, again)
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, p: Params) -> bool:
    if not len(x) or not len(y) or min(len(x), len(y)) * 100 < p.percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[place] == x).sum())
    return 100 * both >= p.percent * (len(x) + len(y) - both)


def _blocked(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks of its key that it belongs to: every two rows of a key meet in exactly one (key, i, j)."""
    return (
        rows.withColumn("blk", F.expr(f"CAST(pmod(xxhash64(doc_id, 5), {blocks}) AS INT)"))
        .withColumn("other", F.explode(F.expr(f"sequence(0, CAST({blocks} AS INT) - 1)")))
        .withColumn("i", F.least("blk", "other"))
        .withColumn("j", F.greatest("blk", "other"))
        .drop("other", blocks)
    )


def _families(rows: DataFrame, p: Params) -> DataFrame:
    """Edges (a, b) that join members of a bucket whose registers make a link between components plausible."""

    def work(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        ids, comp, n, blk, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "comp", "n_shingles", "blk", "i", "j"))
        regs = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("regs")).to_pylist()), dtype=np.uint16).reshape(len(ids), -1)
        found = []

        def consider(x: np.ndarray, y: np.ndarray) -> None:
            ok = (comp[x] != comp[y]) & ((i[x] == j[x]) | (blk[x] != blk[y]))
            x, y = x[ok], y[ok]
            for first in range(0, len(x), 8192):
                s, t = x[first : first + 8192], y[first : first + 8192]
                near = _plausible(regs[s], regs[t], n[s], n[t], p)
                found.append((s[near], t[near]))

        for x, y in close_pairs(at):
            consider(x, y)
        for g in np.flatnonzero(np.diff(at) > 64):
            for k in range(at[g], at[g + 1] - 1):
                rest = np.arange(k + 1, at[g + 1])
                consider(np.full(len(rest), k), rest)
        x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        label = labels(len(ids), x, y)
        keep = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[label[keep]])], ["a", "b"])

    return map_groups(rows, ["key", "i", "j"], work, "a long, b long")


def _family_links(rows: DataFrame, p: Params) -> DataFrame:
    """Spanning links between components inside families, confirmed on full sets."""

    def work(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        ids, comp, blk, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "comp", "blk", "i", "j"))
        sets, bound = sets_of(batch.column(batch.schema.get_field_index("text")), p)
        n, regs, out = np.diff(bound), registers_of(sets, bound, p), []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            _, root = np.unique(comp[lo:hi], return_inverse=True)  # the component of each row, as far as it is known
            for k in range(lo, hi):
                rest = np.arange(k + 1, hi)
                rest = rest[(root[k + 1 - lo :] != root[k - lo]) & ((i[k] == j[k]) | (blk[rest] != blk[k]))]
                rest = rest[_plausible(regs[k], regs[rest], n[k], n[rest], p)] if len(rest) else rest
                while len(rest):  # one partner at a time: a link rules out all others of its component
                    m = rest[0]
                    if _linked(sets[bound[k] : bound[k + 1]], sets[bound[m] : bound[m + 1]], p):
                        out.append((ids[k], ids[m]))
                        root[root == root[m - lo]] = root[k - lo]
                        rest = rest[root[rest - lo] != root[k - lo]]
                    else:
                        rest = rest[1:]
        a, b = (np.array([x[c] for x in out], dtype=np.int64) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_groups(rows, ["family", "i", "j"], work, "a long, b long", 512)


def minhash_components(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Words are runs of bytes other than space and tab to carriage return, with
    A-Z lower-cased.  Null and empty texts have no shingles, link with nothing
    and are kept.  A null doc_id has a null component_id and kept is false.
    Repeated rows and equal texts form one component; a doc_id on rows with
    several texts links by each of them and joins what they reach, n_shingles
    being that of the row.  A very long text is hashed in segments and its
    distinct shingles are held at once.  Other columns of docs are not read, so
    their names cannot clash.  An empty table gives none.
    A link at the threshold is proposed by some band with a probability of
    1 - (1 - J**rows)**bands (by default 0.9972 at J 0.80, the default threshold, and 0.99996 at 0.85)."""
    p = p or Params()
    _store.shared_dir(docs.sparkSession)
    sigs = _store.save(signatures(docs, p), "sigs")
    filled = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    repeated = repeated_ids(filled, ["fp1", "fp2", "n_shingles"], "repeated-ids")
    shared, again = repeated.where("several"), bool(repeated.take(1))
    plain = not shared.take(1)
    reps = filled.groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    reps = reps.select("fp1", "fp2", "n_shingles", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("th"))
    reps = _store.save(reps.withColumn("node", F.col("rep") if plain else F.monotonically_increasing_id()), "reps")
    named = reps.withColumnRenamed("rep", "doc_id").select("doc_id", "th", "fp1", "fp2", "node")
    nodes = filled.join(named, ["doc_id", "th", "fp1", "fp2"]).select(F.col("node").alias("doc_id"), "n_shingles", "regs")
    nodes = _store.save(nodes.dropDuplicates(["doc_id"]) if again else nodes, "nodes")

    bands = _bands(nodes, p)
    buckets = bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("c")).where("c > 1")
    members = _store.save(bands.join(buckets, "key"), "members")
    star = members.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    star = _store.save(_estimated(star, nodes, p), "star")
    links = _store.save(_confirmed(star, reps, docs, again, p), "links")
    first = connected_components(links, "first")

    residue = members.where("c > 2").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
    mixed = residue.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", F.ceil(F.col("n") / p.block).alias("blocks"))
    rows = residue.select("key", "doc_id", "comp").join(mixed, "key").join(nodes, "doc_id")
    edges = _store.save(_families(_blocked(rows, "key", "blocks"), p).distinct(), "edges")
    total = first
    if edges.take(1):
        family = connected_components(edges, "families").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
        sized = family.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
        texts = _store.save(_texts_of(sized, reps, docs, again), "family-texts")
        blocks = texts.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / p.block), F.ceil(F.sum(F.octet_length("text")) / p.block_bytes)).alias("blocks"))
        more = _store.save(_family_links(_blocked(texts.join(blocks, "family"), "family", "blocks"), p), "more")
        if plain:
            total = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "final")
        links = links.unionByName(more)
        _store.drop(texts)
    if not plain:
        several = filled.join(shared, "doc_id").select("doc_id", "fp1", "fp2", "n_shingles").distinct().join(reps, ["fp1", "fp2", "n_shingles"]).select("doc_id", "rep")
        total = id_components(links, reps, several, "final")
    _store.drop(members, star)
    named = reps.join(total.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("found"))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return (
        sigs.drop("regs")
        .join(named, ["fp1", "fp2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", found.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def sigma(p: Params) -> float:
    """Standard deviation of the estimate at the threshold when all registers are in use."""
    return math.sqrt(p.percent / 100 * (1 - p.percent / 100) / p.registers)
