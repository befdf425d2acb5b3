"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every partition tokenises its documents, cuts what is longer than a sequence,
and packs the pieces by best fit in order of decreasing length.  Nearly full
bins are emitted.  Underfull bins become items of the next round, in which
fewer tasks pack the bins of several partitions by best fit again, up to one
last merge.  A bin carries its members, so no join puts the rounds together.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import _store, _text

MEMBER = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
BIN_SCHEMA = "sequence_id long, size int, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long, ids: binary>>"


@dataclass(frozen=True)
class Params:
    """tokenizer: a name for public_tokenizers.path or a file's path. size: tokens of a sequence.

    nearly_full: share of a sequence from which a bin is emitted. fan_in:
    partitions merged into one by a round. block: items packed together in a
    task, which bounds its memory. keep_ids: return the pieces' ids too."""

    tokenizer: str = "word_bpe_49k.json"
    size: int = 2048
    end_id: int = 0
    nearly_full: float = 0.99
    fan_in: int = 8
    block: int = 50_000
    keep_ids: bool = False
    cache_words: int = 300_000


@lru_cache(maxsize=4)
def _tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are ASCII letters, and which are marks that may follow the letters of a plain word."""
    letters, marks = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    letters[65:91] = letters[97:123] = True
    marks[[ord(c) for c in ".,;:!?|*#$%&"]] = True
    return letters, marks


_LETTER, _MARK = _tables()


#: Texts whose ids show whether a tokenizer goes word by word and does not tell cases apart.
PROBES = ("The quick Brown fox, jumps! over; the lazy dog.", "ÉTÉ à l'école naïve façade? Straße: über", "one  two\tthree\nfour", "word, word. word: WORD|x *y #z $5 100% a&b", "UPPER lower MiXeD aaa bbb's ccc'll")


def goes_by_words(tokenizer) -> bool:
    """Whether ids of a text are those of its lower-case words and of the marks behind them, one after the other."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    vocabulary = tokenizer.get_vocab()
    if not any(t.endswith("</w>") for t in vocabulary) or any(c.isspace() for t in vocabulary for c in t):
        return False
    for probe in PROBES:
        apart = []
        for word in probe.split():
            letters = word.rstrip(".,;:!?|*#$%&")
            apart += ids(letters.lower()) + ids(word[len(letters) :]) if letters.isalpha() else ids(word.lower())
        if ids(probe) != apart:
            return False
    return True


class WordEncoder:
    """Ids of whole texts, word by word; of a tokenizer that does not go by words, text by text.

    The vocabulary's tokens never span white space, and in a word of letters
    with marks behind them it splits before the marks and nowhere else.  So a
    batch is cut into such spans, equal spans are found by their hashes, and
    only spans not met before are encoded: letters and marks many in one call,
    told apart by the tokens that end a word.  Spans are remembered while they
    fit in ``most``; what is forgotten is encoded again."""

    LONGEST = 64

    def __init__(self, name: str, most: int) -> None:
        self.tokenizer, self.most = _tokenizer(name), most
        vocabulary, self.by_words = self.tokenizer.get_vocab(), goes_by_words(self.tokenizer)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, dtype="<u4")
        self.at = np.zeros(1 << 14, dtype=np.int64)  # where the ids of the nth span begin; its end is the next one's begin

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _remember(self, hashes: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(hashes)
        while len(self.at) < n + m + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.pool) < self.at[n] + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.at[n] : self.at[n] + len(ids)] = ids
        self.at[n + 1 : n + m + 1] = self.at[n] + np.cumsum(sizes)
        self.known.update(zip(hashes, range(n, n + m), strict=True))

    def _learn(self, hashes: list[int], spans: list[bytes], plain: np.ndarray) -> None:
        simple, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        for first in range(0, len(simple), 4000):
            group = simple[first : first + 4000].tolist()
            text = b"\n".join([spans[k] for k in group]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                self._remember([hashes[k] for k in group], ids, np.diff(stops, prepend=0))
            else:
                odd = np.concatenate([odd, simple[first : first + 4000]])
        if len(odd):
            each = [self._ids(spans[k].decode()) for k in odd.tolist()]
            self._remember([hashes[k] for k in odd.tolist()], np.concatenate(each), np.array([len(x) for x in each]))

    def _spans(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of spans, whether each is letters or marks of a plain word, and the offsets of each text's spans."""
        starts, ends = _text.word_spans(buf, at, _text.space_words())
        stop = ends.copy()
        going = np.arange(len(ends))
        for _ in range(16):
            going = going[(stop[going] > starts[going]) & _MARK[buf[np.maximum(stop[going] - 1, 0)]]]
            if not len(going):
                break
            stop[going] -= 1
        # Letters of two bytes from U+00C0 to U+00FF, but the two signs among them.
        lead, after = buf == 0xC3, (buf >= 0x80) & (buf <= 0xBF) & (buf != 0x97) & (buf != 0xB7)
        pair = lead[:-1] & after[1:] if len(buf) else lead
        letter = _LETTER[buf]
        letter[:-1] |= pair
        letter[1:] |= pair
        other = np.concatenate([[0], np.cumsum(~letter)])
        plain = (stop > starts) & (other[stop] == other[starts]) & (ends - starts <= self.LONGEST)
        stop = np.where(plain, stop, ends)
        two = stop < ends
        count = 1 + two
        first = np.concatenate([[0], np.cumsum(count)])
        begin, end = np.repeat(starts, count), np.repeat(ends, count)
        end[first[:-1]] = stop
        begin[first[1:][two] - 1] = stop[two]
        return begin, end, np.repeat(plain, count), first[np.searchsorted(starts, at)]

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes and offsets), and the offsets of each text's ids."""
        n, raw = len(at) - 1, buf.tobytes()
        if not self.by_words or b"<|" in raw:  # special tokens are told apart by case
            each = [self._ids(raw[at[i] : at[i + 1]].decode()) for i in range(n)]
            return np.concatenate([*each, np.zeros(0, "<u4")]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        starts, ends, plain, spans_at = self._spans(buf, at)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
        unique, where, inverse = np.unique(_text.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        keys = unique.tolist()
        if len(self.known) + len(keys) > self.most:
            self._forget()
        number = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            own = where[fresh]
            lower = _text.LOWER[buf].tobytes()
            self._learn([keys[k] for k in fresh.tolist()], [lower[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)], plain[own])
            number[fresh] = np.fromiter(map(self.known.__getitem__, [keys[k] for k in fresh.tolist()]), np.int64, len(fresh))
        spot = number[inverse]
        begin, size = self.at[spot], self.at[spot + 1] - self.at[spot]
        before = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(begin - before[:-1], size) + np.arange(before[-1])], before[spans_at]


@lru_cache(maxsize=2)
def _encoder(name: str, cache_words: int) -> WordEncoder:
    return WordEncoder(name, cache_words)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices of sizes: each item, largest first, goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit c is set while some bin has c tokens free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = open_ >> size
        if above:
            c = size + (above & -above).bit_length() - 1
            b = free[c].pop()
            if not free[c]:
                open_ ^= 1 << c
            bins[b].append(i)
        else:
            b, c = len(bins), capacity
            bins.append([i])
        left = c - size
        if left:
            free[left].append(b)
            open_ |= 1 << left
    return bins


def _struct(rows: dict[str, np.ndarray | pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays([rows[n] if isinstance(rows[n], pa.Array) else pa.array(rows[n], t) for n, t in MEMBER], [n for n, _ in MEMBER])


class _Numbers:
    """Sequence ids that no other task of any round gives out."""

    def __init__(self, round_: int) -> None:
        self.next = round_ << 56 | TaskContext.get().partitionId() << 32

    def take(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next)


def _bins_batch(sizes: np.ndarray, members: pa.ListArray, numbers: _Numbers, least: int) -> pa.RecordBatch:
    final = sizes >= least
    ids = np.zeros(len(sizes), dtype=np.int64)
    ids[final] = numbers.take(int(final.sum()))
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=~final), pa.array(sizes.astype(np.int32)), members], ["sequence_id", "size", "members"])


def _pieces(docs: DataFrame, p: Params, least: int) -> DataFrame:
    """Round 0: the bins of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, numbers = _encoder(p.tokenizer, p.cache_words), _Numbers(0)
        end = np.array([p.end_id], dtype="<u4").tobytes()
        held: list[tuple] = []

        def packed() -> Iterator[pa.RecordBatch]:
            for first in range(0, len(held), p.block):
                some = held[first : first + p.block]
                sizes = np.array([x[3] for x in some], dtype=np.int64)
                yield _composed(sizes, pa.array([dict(zip([n for n, _ in MEMBER], x, strict=True)) for x in some], pa.struct(MEMBER)), np.arange(len(some) + 1), p, numbers, least)
            held.clear()

        for batch in batches:
            for part in _text.slices(batch):
                ids, at = encoder.encode(*_text.text_bytes(part.column(1)))
                raw = ids.tobytes()
                for k, doc in enumerate(part.column(0).to_pylist()):
                    one = raw[4 * at[k] : 4 * at[k + 1]] + end
                    for number, s in enumerate(range(0, len(one), 4 * p.size)):
                        piece = one[s : s + 4 * p.size]
                        held.append((doc, number, s // 4, len(piece) // 4, zlib.crc32(piece), 0, piece if p.keep_ids else None))
                if len(held) >= p.block:
                    yield from packed()
        yield from packed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BIN_SCHEMA)


def _composed(sizes: np.ndarray, flat: pa.StructArray, at: np.ndarray, p: Params, numbers: _Numbers, least: int) -> pa.RecordBatch:
    """Pack items into bins; item i holds the members flat[at[i]:at[i + 1]], whose offsets count from the item's start."""
    bins = best_fit(sizes, p.size)
    order = np.concatenate([np.array(b) for b in bins]) if bins else np.zeros(0, np.int64)
    counts = np.array([len(b) for b in bins], dtype=np.int64)
    totals = np.add.reduceat(sizes[order], np.concatenate([[0], np.cumsum(counts)[:-1]])) if bins else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(sizes[order])[:-1]]) if len(order) else np.zeros(0, np.int64)
    before = before - np.repeat(np.concatenate([[0], np.cumsum(totals)[:-1]]) if len(totals) else totals, counts)
    each = at[order + 1] - at[order]
    rows = np.repeat(at[order] - np.concatenate([[0], np.cumsum(each)[:-1]]) if len(order) else order, each) + np.arange(each.sum())
    taken = flat.take(pa.array(rows))
    fields = {n: taken.field(n) for n, _ in MEMBER}
    fields["offset"] = fields["offset"].to_numpy() + np.repeat(before, each)
    ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
    return _bins_batch(totals, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _struct(fields)), numbers, least)


def _merged(bins: DataFrame, p: Params, round_: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held = _Numbers(round_), []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= p.block:
                yield one(held, numbers)
                held = []
        if held:
            yield one(held, numbers)

    def one(held: list[pa.RecordBatch], numbers: _Numbers) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        members = table["members"].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.struct(MEMBER)))
        at = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        return _composed(table["size"].to_numpy().astype(np.int64), members.flatten(), at, p, numbers, least)

    return bins.mapInArrow(run, BIN_SCHEMA)


def pack(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where asked for.

    A document is its ids and one end id; null and empty texts are the end id
    alone.  Only documents longer than a sequence are cut, at its multiples.
    Repeated rows are packed as often as they occur and a null doc_id is kept.
    Pieces of equal length are packed in the order in which they come.
    Only doc_id and text are read; an empty table gives no rows."""
    p = p or Params()
    _store.shared_dir(docs.sparkSession)
    least = int(np.ceil(p.nearly_full * p.size))
    rounds = [_store.save(_pieces(docs, p, least), "bins")]
    tasks = rounds[0].rdd.getNumPartitions()
    while True:
        under = rounds[-1].where("sequence_id IS NULL")
        n = under.count()
        if not n:
            break
        tasks = max(1, -(-tasks // p.fan_in), -(-n // p.block))
        last = tasks == 1 or (len(rounds) > 1 and n > 0.98 * before)
        rounds.append(_store.save(_merged(under.repartition(tasks), p, len(rounds), 0 if last else least), "bins"))
        before = n
        if last:
            break
    bins = rounds[0].where("sequence_id IS NOT NULL")
    for more in rounds[1:]:
        bins = bins.unionByName(more.where("sequence_id IS NOT NULL"))
    pieces = bins.select("sequence_id", F.inline("members"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pieces.select(*columns, *["ids"] * p.keep_ids)
