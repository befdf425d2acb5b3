"""Language identification by nearest centroids of TF-IDF byte n-grams.

A text's vector holds its hashed three-byte n-grams, weighted by TF-IDF and
normalised.  Each language has several centroids, found by spherical k-means;
the nearest one by cosine decides, and a text farther from it than its training
texts of that length are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm import _store, _text


@dataclass(frozen=True)
class Params:
    """dims: hashed n-grams. centroids: per language. sample, sample_total: distinct texts per language and in all
    that k-means sees at most, but one of each language always (document frequencies and limits come from all texts).
    reject: cosine below which a text is always rejected. tail: share of the training texts of a centroid and length
    that may fall below the learnt quantile. margin: share of that quantile from which on a text is near enough, so that
    what lies just beyond the training texts stays. trust: number of texts from which a length's quantile counts as much
    as that of the next shorter texts."""

    dims: int = 4096
    centroids: int = 4
    sample: int = 500
    sample_total: int = 20_000
    iterations: int = 12
    reject: float = 0.05
    tail: float = 0.001
    margin: float = 0.7
    trust: int = 100
    seed: int = 3


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray | None = None  # by centroid and length, where learnt


def held_out(column: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text has that remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


#: Bytes that end n-grams become a space: everything in ASCII but letters.
_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def counts_of(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, a row per text; and which texts hold a letter."""
    buf, at = _text.text_bytes(pc.utf8_lower(column.cast(pa.string()).fill_null("")))
    n = len(at) - 1
    out = np.zeros((n, p.dims), dtype=np.float32)
    lower = _LETTERS[buf]
    shift = np.uint32(32 - int(np.log2(p.dims)))
    total = np.concatenate([[0], np.cumsum((lower != 0x20) & (lower < 0x80))])
    letters = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~letters & (at[1:] > at[:-1])):
        letters[i] = any(c.isalpha() for c in buf[at[i] : at[i + 1]].tobytes().decode())
    for first in range(0, n, 64):
        last = min(first + 64, n)
        row = np.zeros((last - first) * p.dims, dtype=np.int64)
        for base in range(at[first], at[last], _text.SEGMENT):  # segments overlap by two bytes
            part = lower[base : min(base + _text.SEGMENT + 2, at[last])].astype(np.uint32)
            if len(part) < 3:
                continue
            gram = ((part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]) * np.uint32(0x9E3779B1) >> shift
            start = base + np.arange(len(gram))
            text = np.searchsorted(at[first : last + 1], start, "right") - 1
            inside = (start + 3 <= at[first + 1 : last + 1][text]) & ((part[:-2] != 0x20) | (part[1:-1] != 0x20))
            row += np.bincount(text[inside] * p.dims + gram[inside], minlength=len(row))
        out[first:last] = row.reshape(last - first, p.dims)
    return out, letters


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _frequencies(docs: DataFrame, p: Params) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram occurs, and the number of texts; dims + 1 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.dims + 1, dtype=np.int64)
        for batch in batches:
            for part in _text.slices(batch, rows=256):
                counts, _ = counts_of(part.column(0), p)
                total[:-1] += (counts > 0).sum(0)
                total[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.dims + 1)), pa.array(total)], ["gram", "n"])

    out = np.zeros(p.dims + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out[:-1], int(out[-1])


def _sample(docs: DataFrame, p: Params) -> list:
    """lang, h, counts: about ``sample`` distinct texts of each language, chosen by a hash of the text, in the order of it.

    A text counts once however many copies it has, so a hot one cannot fill the
    sample, and the choice does not depend on how rows are partitioned.  The
    text of the least hash is always taken, so no language is without any."""
    rows = docs.withColumn("h", F.xxhash64("text", F.lit(p.seed)))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("least"))
    languages = sizes.count()
    share = min(p.sample, p.sample_total / max(languages, 1)) / F.col("n")
    drawn = (F.pmod("h", F.lit(1 << 30)) / (1 << 30) < share) | (F.col("h") == F.col("least"))
    chosen = rows.join(F.broadcast(sizes) if languages <= 10_000 else sizes, "lang").where(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
            for part in _text.slices(batch.take(pa.array(new, pa.int64())), rows=256):
                counts, _ = counts_of(part.column(2), p)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([np.concatenate([(k := np.flatnonzero(c)).astype(np.float32), c[k]]).tobytes() for c in counts], pa.binary())], ["lang", "h", "counts"])

    drawn = chosen.select("lang", "h", "text").mapInArrow(run, "lang string, h long, counts binary").groupBy("lang", "h").agg(F.min("counts").alias("counts"))
    return sorted(drawn.collect(), key=lambda r: (r["lang"], r["h"]))


#: Lengths are octaves of the number of distinct n-grams, so that a text of one repeated word is short. Bins of cosines from 0 to 1.
LENGTHS, BINS = 32, 200


def _nearest(counts: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, cosine and length of each text; cosines are rounded, so that they do not depend on what else is in a batch."""
    near = np.round(_vectors(counts, m.idf).astype(np.float64) @ m.centroids.T.astype(np.float64), 9)
    best = near.argmax(1)
    length = np.log2(np.maximum((counts > 0).sum(1), 1)).astype(np.int64)
    return best, np.clip(near[np.arange(len(best)), best], 0, 1), length


def _limits(docs: DataFrame, model: Model, p: Params) -> np.ndarray:
    """The limit below which texts are rejected, ``margin`` of the cosine that all but ``tail`` of the texts reach, by centroid and length; LENGTHS * BINS numbers a centroid reach the driver at most.

    Where there are few texts of a length, the limit of the next shorter ones tells more."""
    held, shape = docs.sparkSession.sparkContext.broadcast(model), (len(model.centroids), LENGTHS, BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, rows=256):
                counts, letters = counts_of(part.column(0), p)
                best, score, length = (a[letters] for a in _nearest(counts, held.value))
                cell, n = np.unique(np.ravel_multi_index((best, length, np.minimum(score * BINS, BINS - 1).astype(np.int64)), shape), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

    total = np.zeros(shape, dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total.flat[r["cell"]] = r["n"]
    out = np.full(shape[:2], p.reject)
    for centroid, length in np.ndindex(*shape[:2]):
        before = out[centroid, length - 1] if length else p.reject
        up = total[centroid, length].cumsum()
        own = np.searchsorted(up, p.tail * up[-1], "right") / BINS if up[-1] else before
        out[centroid, length] = max(p.reject, before + (own - before) * up[-1] / (up[-1] + p.trust))
    return np.maximum(p.reject, p.margin * out)


def _clusters(x: np.ndarray, p: Params) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    rng = np.random.RandomState(p.seed)
    centres = x[rng.randint(len(x))][None]
    while len(centres) < min(p.centroids, len(x)):
        far = np.clip(1 - (x @ centres.T).max(1), 0, None)
        if far.sum() <= 1e-9:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(p.iterations):
        own = (x @ centres.T).argmax(1)
        centres = np.vstack([x[own == k].sum(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, p: Params | None = None) -> Model | None:
    """Learn from text and lang of docs; None where there is nothing to learn from. The model is the same however docs is partitioned."""
    p = p or Params()
    _store.shared_dir(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang IS NOT NULL AND text IS NOT NULL")
    df, n = _frequencies(rows, p)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    by_language: dict[str, list] = {}
    for r in _sample(rows, p):
        a = np.frombuffer(r["counts"], dtype=np.float32).reshape(2, -1)
        if a.size:
            by_language.setdefault(r["lang"], []).append(a)
    centroids, owner, languages = [], [], sorted(by_language)
    for k, lang in enumerate(languages):
        x = np.zeros((len(by_language[lang]), p.dims), dtype=np.float32)
        for row, (gram, count) in zip(x, by_language[lang], strict=True):
            row[gram.astype(np.int64)] = count
        centroids.append(_clusters(_vectors(x, idf), p))
        owner += [k] * len(centroids[-1])
    if not languages:
        return None
    model = Model(languages, idf, np.vstack(centroids).astype(np.float32), np.array(owner))
    return replace(model, limits=_limits(rows, model, p))


def identify(docs: DataFrame, model: Model | None, p: Params | None = None) -> DataFrame:
    """docs with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected added.

    A text that is null or has no letter is `und` with score 0 and rejected; so
    is every text where no model could be learnt.  Of equally near languages
    the first by name holds; a very long text is counted in segments.  Columns of docs pass through,
    rows one for one; those with the three added names are replaced."""
    p = p or Params()
    added = ["lang_pred", "score", "rejected"]
    out = docs.drop(*added).withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "rejected": F.lit(None).cast("boolean")})
    names, held = out.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in _text.slices(batch, rows=256):
                counts, letters = counts_of(part.column(names.index("text")), p)
                if m is None:
                    lang, score, limit = np.full(len(counts), "und", dtype=object), np.zeros(len(counts)), p.reject
                else:
                    best, score, length = _nearest(counts, m)
                    lang = np.array(m.languages, dtype=object)[m.owner[best]]
                    limit = p.reject if m.limits is None else m.limits[best, length]
                lang[~letters], score[~letters] = "und", 0.0
                columns = dict(zip(names, part.columns, strict=True)) | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "rejected": pa.array((score < limit) | (lang == "und"))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return out.mapInArrow(run, out.schema)


def language_digest(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected (too far from its centroid, or `und`), a row for each of docs, learnt outside the held-out fold."""
    p = p or Params()
    _store.shared_dir(docs.sparkSession)
    model = fit(docs.where(~held_out()).select("lang", "text"), p)
    return identify(docs.select("doc_id", "text"), model, p).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
