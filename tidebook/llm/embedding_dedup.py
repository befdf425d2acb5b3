"""Near-duplicate embeddings: sign hashing by random hyperplanes in several tables, exact cosines, components.

A vector's code in a table is the sign pattern of its products with ``bits``
random hyperplanes.  Vectors that share a code meet in one bucket; buckets are
cut into blocks of bounded size, every two of which meet in one task.  A pair
counts in the first table that proposes it, so tasks return counts and spanning
links, never the pairs themselves.

Only codes travel with the buckets' rows.  Pairs whose codes differ in more bits
than a pair at the threshold ever does go first; vectors are sent to the blocks
that still need them, mostly one for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import _store, _text
from tidebook.llm._groups import labels, map_groups, pair_chunks
from tidebook.llm.components import id_components, repeated_ids
from tidebook.llm.minhash_dedup import _blocked


@dataclass(frozen=True)
class Params:
    """bits, tables: of the codes; where 0, ``sized`` sets them by the number of vectors. miss: chance at most that a pair
    at the threshold shares no code. block: vectors compared in one task. slack: standard deviations of the differing
    bits of a pair at the threshold that are still looked at."""

    threshold: float = 0.95
    bits: int = 0
    tables: int = 0
    miss: float = 0.004
    slack: float = 6.0
    block: int = 512
    seed: int = 7

    @property
    def agree(self) -> float:
        """Chance that one bit of a pair at the threshold is equal."""
        return 1 - math.acos(min(max(self.threshold, -1.0), 1.0)) / math.pi

    @property
    def differing(self) -> float:
        n, q = self.bits * self.tables, 1 - self.agree
        return n * q + self.slack * math.sqrt(n * q * (1 - q)) + 0.5

    @property
    def code_bytes(self) -> int:
        return 2 if self.bits <= 16 else 4


def sized(n: int, p: Params) -> Params:
    """p with bits that leave about 32 strangers to a bucket however many vectors there are, and the tables that the chance of a miss asks for."""
    bits = p.bits or min(max(math.ceil(math.log2(max(n, 1))) - 5, 8), 31)
    return replace(p, bits=bits, tables=p.tables or max(1, math.ceil(math.log(p.miss) / math.log1p(-min(p.agree**bits, 1 - 1e-9)))))


@lru_cache(maxsize=8)
def hyperplanes(dim: int, p: Params) -> np.ndarray:
    return np.random.RandomState(p.seed + dim).standard_normal((dim, p.tables * p.bits))


def codes_of(unit: np.ndarray, p: Params) -> np.ndarray:
    """A code for each vector and table."""
    signs = (unit @ hyperplanes(unit.shape[1], p) >= 0).reshape(len(unit), p.tables, p.bits)
    return (signs << np.arange(p.bits)).sum(-1).astype(f"<u{p.code_bytes}")


def units_of(x: np.ndarray) -> np.ndarray:
    u = x / np.abs(x).max(axis=1)[:, None]
    return u / np.linalg.norm(u, axis=1)[:, None]


def _hash_rows(raw: np.ndarray, seed: int) -> np.ndarray:
    out = np.full(len(raw), seed, dtype=np.uint64)
    for column in raw.T:
        out = _text.mix(out * np.uint64(0x2545F4914F6CDD1D) + column, seed)
    return out


def _prepared(vectors: DataFrame, p: Params) -> DataFrame:
    """vec_id as doc_id, dim (0 where the vector links with nothing), a 128-bit fingerprint, the vector's bytes and its codes."""
    kind = vectors.schema["embedding"].dataType
    kept = np.dtype("<f4" if kind.simpleString() == "array<float>" else "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                lists = part.column(1)
                size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], dtype=np.int64)
                values = np.array(lists.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False), dtype=np.float64)
                at = np.concatenate([[0], np.cumsum(size)])
                dim = np.zeros(len(size), dtype=np.int32)
                fp = np.zeros((2, len(size)), dtype=np.int64)
                raw: list[bytes | None] = [None] * len(size)
                codes: list[bytes | None] = [None] * len(size)
                for d in np.unique(size[size > 0]):
                    own = np.flatnonzero(size == d)
                    x = values[at[own][:, None] + np.arange(d)] + 0.0
                    top = np.abs(x).max(axis=1)
                    good = np.isfinite(top) & (top > 0)
                    own, x = own[good], x[good]
                    if not len(own):
                        continue
                    code, bits = codes_of(units_of(x), p), x.view(np.uint64)
                    dim[own], fp[0, own], fp[1, own] = d, _hash_rows(bits, 3).view(np.int64), _hash_rows(bits, 4).view(np.int64)
                    for i, k in enumerate(own):
                        raw[k], codes[k] = x[i].astype(kept).tobytes(), code[i].tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dim), pa.array(fp[0]), pa.array(fp[1]), pa.array(raw, pa.binary()), pa.array(codes, pa.binary())], ["doc_id", "dim", "fp1", "fp2", "raw", "codes"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kept.itemsize == 4 else "array<double>"))
    return rows.mapInArrow(run, "doc_id long, dim int, fp1 long, fp2 long, raw binary, codes binary")


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _proposed(batch: pa.RecordBatch, at: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's rows that are first proposed here and differ in few bits, some thousand candidates at a time."""
    blk, table, i, j = (_column(batch, c).to_numpy() for c in ("blk", "tab", "i", "j"))
    codes = np.frombuffer(b"".join(_column(batch, "codes").to_pylist()), dtype=f"<u{p.code_bytes}").reshape(len(blk), p.tables)
    wide = -(-p.tables * p.code_bytes // 8)
    words = np.zeros((len(blk), wide * 8), dtype=np.uint8)
    words[:, : p.tables * p.code_bytes] = np.ascontiguousarray(codes).view(np.uint8)
    words = words.view(np.uint64)
    for x, y in pair_chunks(at):
        ok = np.bitwise_count(words[x] ^ words[y]).sum(-1, dtype=np.int32) <= p.differing
        ok &= (i[x] == j[x]) | (blk[x] != blk[y])
        x, y = x[ok], y[ok]
        if len(x):
            earlier = ((codes[x] == codes[y]) & (np.arange(p.tables) < table[x][:, None])).any(axis=1)
            yield x[~earlier], y[~earlier]


def _needed(rows: DataFrame, p: Params) -> DataFrame:
    """The rows of buckets that have a plausible partner there."""

    def work(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        need = np.zeros(batch.num_rows, dtype=bool)
        for x, y in _proposed(batch, at, p):
            need[x] = need[y] = True
        return batch.select(["key", "tab", "doc_id", "blk", "i", "j", "codes"]).filter(pa.array(need))

    return map_groups(rows, ["key", "i", "j"], work, "key long, tab int, doc_id long, blk int, i int, j int, codes binary")


def _block_links(rows: DataFrame, p: Params, width: int, dim: int) -> DataFrame:
    """For each block pair of a bucket: links of its vectors first found in this table, weighted by copies, and a spanning edge."""
    most = max(256, min(4096, (32 << 20) // (8 * max(dim, 1))))

    def work(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        ids, copies, dims = (_column(batch, c).to_numpy() for c in ("doc_id", "copies", "dim"))
        raw = _column(batch, "raw").to_pylist()
        u = np.zeros((len(ids), dims.max()))
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            u[own, :d] = units_of(np.frombuffer(b"".join([raw[k] for k in own]), dtype=f"<f{width}").reshape(-1, d).astype(np.float64))
        del raw
        links, label, step = np.zeros(len(ids)), np.arange(len(ids)), max(64, (8 << 20) // (8 * u.shape[1]))
        for xs, ys in _proposed(batch, at, p):
            for first in range(0, len(xs), step):
                x, y = xs[first : first + step], ys[first : first + step]
                near = np.einsum("ij,ij->i", u[x], u[y]) >= p.threshold
                x, y = x[near], y[near]
                if len(x):
                    links += np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
                    label = labels(len(ids), np.concatenate([x, np.arange(len(ids))]), np.concatenate([y, label]))
        keep = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep].astype(np.int64)), pa.array(ids[label[keep]])], ["doc_id", "links", "root"])

    return map_groups(rows, ["key", "i", "j"], work, "doc_id long, links long, root long", most)


def embedding_components(vectors: DataFrame, p: Params | None = None) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id (smallest vec_id reachable), kept.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing and are kept; vectors of different lengths never link,
    and of any length a block's are held at once.  Equal vectors are collapsed
    before the search and counted with their copies.  A vec_id on rows with
    several vectors links by each of them, n_links being that of the row, and
    joins what they reach.  A null vec_id has a null component_id and kept is
    false.  Only the columns vec_id and embedding are read; an empty table
    gives none."""
    _store.shared_dir(vectors.sparkSession)
    p = sized(vectors.count(), p or Params())
    rows = _store.save(_prepared(vectors, p), "vectors")
    named = rows.where("dim > 0 AND doc_id IS NOT NULL")
    reps = named.groupBy("fp1", "fp2", "dim").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("raw").alias("raw"), F.any_value("codes").alias("codes"))
    shared = repeated_ids(named, ["fp1", "fp2", "dim"], "shared-ids").where("several")
    plain = not shared.take(1)
    reps = _store.save(reps.withColumn("node", F.col("rep") if plain else F.monotonically_increasing_id()), "vector-reps")
    nodes = reps.select(F.col("node").alias("doc_id"), "dim", "raw", "codes", "copies")

    size = p.code_bytes
    code = F.transform(F.sequence(F.lit(0), F.lit(p.tables - 1)), lambda t: F.struct(t.alias("tab"), F.xxhash64(t, F.col("dim"), F.substring(F.col("codes"), t * size + 1, F.lit(size))).alias("key")))
    slim = nodes.select("doc_id", "codes", F.inline(code))
    large = _store.save(slim.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > p.block).select("key", F.ceil(F.col("c") / p.block).alias("blocks")), "vector-buckets")
    met = slim.join(_store.small(large), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    needed = _store.save(_needed(_blocked(met, "key", "blocks"), p), "vector-needed")
    dim = nodes.agg(F.max("dim")).first()[0] or 1
    found = _store.save(_block_links(needed.join(nodes.drop("codes"), "doc_id"), p, 4 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else 8, dim), "vector-links")

    several = None if plain else named.join(shared, "doc_id").select("doc_id", "fp1", "fp2", "dim").distinct().join(reps, ["fp1", "fp2", "dim"]).select("doc_id", "rep")
    parts = id_components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")), reps, several, "vector-components")
    counts = found.groupBy(F.col("doc_id").alias("node")).agg(F.sum("links").alias("links"))
    classes = reps.join(counts, "node", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("fp1", "fp2", "dim", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("linked"), F.coalesce("component", "rep").alias("found"))
    _store.drop(needed, large)
    known = F.col("doc_id").isNotNull()
    return (
        rows.select("doc_id", "fp1", "fp2", "dim")
        .join(classes, ["fp1", "fp2", "dim"], "left")
        .select(F.col("doc_id").alias("vec_id"), F.when(known, F.coalesce("linked", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(known, F.coalesce("found", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
