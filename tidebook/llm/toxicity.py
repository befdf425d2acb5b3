"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over the words of a document and their first bytes.  In
labelled sentences identity terms are swapped for each other one of their row;
the model pays for the square of every score change, so that naming a group is
not what decides.  A labelled text without such a term lends a sentence in
which one is planted, and is learnt from a second time with that term among its
words: so the penalty has pairs, under both labels, whatever the texts name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import _store, _text
from tidebook.llm.language_id import held_out
from tidebook.llm.quality import bounded, labelled, one_text_each

#: Terms that name groups; those of one row stand for each other in a sentence.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
)


@dataclass(frozen=True)
class Params:
    """sample: labelled rows learnt from at most, chosen by a hash of the id. features: kept, those that
    speak most clearly for the label (what speaks against it must not outvote an insult). sentences: counterfactual
    sentences at most, half of them of either label, chosen by a hash; each is paired with one sentence for every other
    term of the row. penalty: weight of the squared score change. cut: score at which the two labels part."""

    sample: int = 40_000
    hash_bits: int = 20
    features: int = 3000
    least_z: float = 3.0
    least_count: int = 3
    sentences: int = 4_000
    penalty: float = 20.0
    shrink: float = 0.01
    steps: int = 300
    cut: float = 0.6
    prefixes: tuple[int, ...] = (4, 5, 6, 8)
    identity: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)


@dataclass(frozen=True)
class Model:
    bins: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: int = 0  # counterfactual pairs that it was fitted with


def bins_of(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words and word beginnings of each text, concatenated and sorted, and their offsets."""
    buf, at = _text.text_bytes(pc.utf8_lower(column.cast(pa.string()).fill_null("")))
    starts, ends, hashes, words = _text.words(buf, at, _text.alnum_words())
    own = np.repeat(np.arange(len(at) - 1), np.diff(words))
    keys, owners = [_text.mix(hashes, 1)], [own]
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    for k in p.prefixes:
        long = ends - starts > k
        value = np.zeros(int(long.sum()), dtype=np.uint64)
        for j in range(k):
            value = value << np.uint64(8) | padded[starts[long] + j]
        keys.append(_text.mix(value, 100 + k))
        owners.append(own[long])
    key = np.concatenate(owners).astype(np.uint64) << np.uint64(p.hash_bits) | np.concatenate(keys) >> np.uint64(64 - p.hash_bits)
    key = np.unique(key)
    return (key & np.uint64((1 << p.hash_bits) - 1)).astype(np.int64), np.searchsorted(key, np.arange(len(at), dtype=np.uint64) << np.uint64(p.hash_bits))


def _counts(rows: DataFrame, p: Params) -> DataFrame:
    """bin, pos, neg: in how many texts of either label a feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << p.hash_bits), dtype=np.int32)
        for batch in batches:
            for part in _text.slices(batch):
                bins, at = bins_of(part.column(0), p)
                y = np.repeat(part.column(1).to_numpy() > 0, np.diff(at))
                for k in (0, 1):
                    total[k] += np.bincount(bins[y == k], minlength=1 << p.hash_bits).astype(np.int32)
        some = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1, some].astype(np.int64)), pa.array(total[0, some].astype(np.int64))], ["bin", "pos", "neg"])

    return rows.select("text", "y").mapInArrow(run, "bin long, pos long, neg long").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


@dataclass(frozen=True)
class Swap:
    """A labelled sentence, the same with each other term of the row in the place of one, and the term, where it was planted."""

    sentence: str
    others: list[str]
    planted: str | None


def _swaps(text: str, p: Params) -> list[Swap]:
    """A swap for every identity term of text; where there is none, one for a term planted in a sentence, both chosen by a hash of the text."""
    rows = {t: row for row in p.identity for t in row}
    if not rows or not text:
        return []
    found = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, rows)) + r")(?!\w)", re.I)
    sentences = [s for s in re.split(r"(?<=[.!?\n])\s*", text) if s.strip()]
    out = []
    for s in sentences if found.search(text) else ():
        for m in found.finditer(s):
            out.append(Swap(s, [s[: m.start()] + t + s[m.end() :] for t in rows[m[1].lower()] if t != m[1].lower()], None))
    if out or not sentences:
        return out
    draw = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=16).digest(), "little")
    draw, k = divmod(draw, len(sentences))
    words = sentences[k].split()
    draw, at = divmod(draw, len(words) + 1)
    draw, r = divmod(draw, len(p.identity))
    row = p.identity[r]
    term = row[draw % len(row)]
    planted = lambda t: " ".join([*words[:at], t, *words[at:]])
    return [Swap(planted(term), [planted(t) for t in row if t != term], term)]


def _learnt_rows(rows: DataFrame, chosen: np.ndarray, p: Params) -> tuple[list, list]:
    """For each labelled text its label and chosen features; and the counterfactual sentences that are learnt from, chosen by a hash among those of either label.

    A sentence is its label, the features of the text it was planted in (null
    if it was not) and, for each other term, the features that the swap takes away and adds."""
    held = rows.sparkSession.sparkContext.broadcast(chosen)

    def own(bins: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(held.value, bins), len(held.value) - 1)
        return place[held.value[place] == bins].astype(np.uint16)

    def sets(texts: list[str]) -> list[np.ndarray]:
        b, a = bins_of(pa.array(texts, pa.string()), p)
        return [own(b[a[i] : a[i + 1]]) for i in range(len(texts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch):
                bins, at = bins_of(part.column(0), p)
                features = [own(bins[at[i] : at[i + 1]]) for i in range(part.num_rows)]
                swaps = []
                for text, x in zip(part.column(0).to_pylist(), features, strict=True):
                    swaps.append([])
                    for k, swap in enumerate(_swaps(text or "", p)):
                        first, *others = sets([swap.sentence, *swap.others])
                        gone, come = ([np.setdiff1d(*ab) for ab in pairs] for pairs in ([(first, o) for o in others], [(o, first) for o in others]))
                        h = int.from_bytes(hashlib.blake2b(f"{k} {swap.sentence}".encode(), digest_size=8).digest(), "little", signed=True)
                        grown = np.union1d(x, sets([swap.planted])[0]).tobytes() if swap.planted else None
                        swaps[-1].append({"h": h, "x": grown, "pairs": [np.concatenate([[len(g)], g, c]).astype(np.uint16).tobytes() for g, c in zip(gone, come, strict=True)]})
                kind = pa.list_(pa.struct([("h", pa.int64()), ("x", pa.binary()), ("pairs", pa.list_(pa.binary()))]))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([x.tobytes() for x in features], pa.binary()), pa.array(swaps, kind)], ["y", "x", "swaps"])

    learnt = _store.save(rows.select("text", "y").mapInArrow(run, "y int, x binary, swaps array<struct<h: long, x: binary, pairs: array<binary>>>"), "learnt")
    swaps = learnt.select(F.least("y", F.lit(1)).alias("y"), F.inline("swaps"))
    picked = [r for y in (0, 1) for r in swaps.where(F.col("y") == y).orderBy("h", "x", "pairs").limit(p.sentences // 2).collect()]
    seen = learnt.select("y", "x").collect()
    _store.drop(learnt)
    return sorted(seen, key=lambda r: (r["y"], r["x"])), picked


def _optimise(x: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int, p: Params) -> tuple[np.ndarray, float]:
    """Adam on the logistic loss, a ridge, and the mean squared change over counterfactual pairs."""
    row, col = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    sign = np.concatenate([s for a, b in pairs for s in (np.ones(len(a)), -np.ones(len(b)))]) if pairs else np.zeros(0)
    pair = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    pair_col = np.concatenate([v for ab in pairs for v in ab]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    w, bias = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for step in range(1, p.steps + 1):
        error = each * (1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(x)), -30, 30))) - y) / len(y)
        gradient = np.bincount(col, error[row], n) + p.shrink * w / n
        if pairs:
            change = np.bincount(pair, sign * w[pair_col], len(pairs))
            gradient += 2 * p.penalty * np.bincount(pair_col, sign * change[pair], n) / len(pairs)
        g = np.append(gradient, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def _shift(margins: np.ndarray, y: np.ndarray, p: Params) -> float:
    """What to add to margins so that the cut with the least balanced error on them scores ``cut``; amid equal cuts the middle."""
    order = np.argsort(margins)
    m, t = margins[order], y[order]
    missed = np.concatenate([[0], np.cumsum(t)]) / t.sum()
    alarms = 1 - np.concatenate([[0], np.cumsum(1 - t)]) / (1 - t).sum()
    error = missed + alarms
    edges = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    error[1:-1][m[1:] == m[:-1]] = np.inf
    best = int(error.argmin())
    return float(np.log(p.cut / (1 - p.cut)) - edges[best])


def fit(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> Model:
    """Learn from texts of docs and labels (doc_id, y); without both classes the score is a constant."""
    p = p or Params()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = _store.save(one_text_each(texts.join(F.broadcast(bounded(labels, p.sample, 2)), "doc_id")).select("text", "y"), "labelled")
    pos, neg = rows.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    if not pos or not neg:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((pos + 1) / (neg + 1))))
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    z = (F.log(a / b) - np.log(pos / neg).item()) / F.sqrt(1 / a + 1 / b)
    strong = _counts(rows, p).where(F.col("pos") + F.col("neg") >= p.least_count).withColumn("z", z).where(F.col("z") >= p.least_z)
    chosen = np.sort(np.array([r["bin"] for r in strong.orderBy(F.desc("z"), "bin").limit(p.features).select("bin").collect()], dtype=np.int64))
    if p.identity:
        terms, _ = bins_of(pa.array([" ".join(t for row in p.identity for t in row)]), p)
        chosen = np.union1d(chosen, terms)
    seen, swaps = _learnt_rows(rows, chosen, p)
    pairs = [(v[1 : 1 + v[0]], v[1 + v[0] :]) for r in swaps for raw in r["pairs"] if len(v := np.frombuffer(raw, dtype=np.uint16)) > 1]
    seen += [r for r in swaps if r["x"] is not None]
    x, y = [np.frombuffer(r["x"], dtype=np.uint16) for r in seen], np.array([float(r["y"] > 0) for r in seen])
    w, bias = _optimise(x, y, pairs, len(chosen), p)
    margins = bias + np.bincount(np.repeat(np.arange(len(x)), [len(v) for v in x]), w[np.concatenate(x).astype(np.int64)], len(x))
    _store.drop(rows)
    return Model(chosen, w, bias + _shift(margins, y, p), len(pairs))


def score(docs: DataFrame, model: Model, p: Params | None = None) -> DataFrame:
    p = p or Params()
    table = np.zeros(1 << p.hash_bits, dtype=np.float32)
    table[model.bins] = model.weights
    held = docs.sparkSession.sparkContext.broadcast((table, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            for part in _text.slices(batch):
                bins, at = bins_of(part.column(1), p)
                margin = bias + np.bincount(np.repeat(np.arange(part.num_rows), np.diff(at)), weights[bins], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, p: Params | None = None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (chance of label 1), predicted, for each row of docs.

    Labels are learnt from ids outside the held-out fold only.  Null and empty
    texts have no words and score what the bias gives; of a very long text all
    words count, each once; a null doc_id is never held out.  Repeated rows get
    equal scores; of an id with several texts one is learnt from, that with the
    least hash, of differing labels the larger.  Ties between features and
    between sentences go by their hashes.  Only doc_id and text of docs are
    read; an empty table gives none."""
    p = p or Params()
    _store.shared_dir(docs.sparkSession)
    fold = held_out("doc_id", 3, 1)
    model = fit(docs, labelled(labels, "toxic", fold), p)
    out = score(docs, model, p)
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
