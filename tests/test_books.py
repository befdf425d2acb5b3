from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import book, compare, histogram, sequence
from tidebook.operators.tracker import Tracker, track
from tidebook.streaming import sinks

LEVEL = "symbol string, side string, price bigint, qty bigint"


def test_last_writer_equals_a_map(spark):
    rng = random.Random(1)
    rows, model = [], {}
    for k in range(4000):
        side, price, qty = rng.choice("BA"), rng.randint(1, 200), rng.choice([0, rng.randint(1, 9), rng.randint(1, 9)])
        rows.append(("X", side, price, qty, k // 3, k % 3))
        model[side, price] = qty
    df = spark.createDataFrame(rows, LEVEL + ", arrival bigint, pos int")
    for n in (1, 8):
        got = {(r["side"], r["price"]): r["qty"] for r in book.last_writer(df.repartition(n)).collect()}
        assert got == {k: q for k, q in model.items() if q}


SEQUENCES = [
    ("contiguous", 10, [(11, 12), (13, 13), (14, 20)], ["contiguous"] * 3),
    ("stale first", 10, [(5, 8), (9, 10), (9, 11), (12, 12)], ["stale", "stale", "contiguous", "contiguous"]),
    ("gap latches", 10, [(11, 11), (13, 14), (12, 15), (16, 16)], ["contiguous", "gapped", "buffered", "buffered"]),
    ("gap at once", 10, [(12, 13), (11, 14)], ["gapped", "buffered"]),
    ("equal last", 10, [(10, 10), (11, 11), (11, 11)], ["stale", "contiguous", "stale"]),
]


@pytest.mark.parametrize("block", [1, 2, 1 << 16])
def test_closed_form_of_sequencing(spark, block):
    rows = [(name, k, first, last, anchor) for name, anchor, ids, _ in SEQUENCES for k, (first, last) in enumerate(ids)]
    df = spark.createDataFrame(rows, "symbol string, arrival bigint, first_id bigint, last_id bigint, anchor bigint")
    got = sequence.latch(sequence.classify(df, F.col("anchor"), block)).collect()
    assert {(r["symbol"], r["arrival"]): r["class"] for r in got} == {(name, k): c for name, _, _, want in SEQUENCES for k, c in enumerate(want)}


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_numbers_and_earlier_rows_in_blocks(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice("XXXY"), k * 3, rng.randint(0, 99)) for k in range(200)]
    df = spark.createDataFrame(rows, "symbol string, arrival bigint, v bigint").repartition(5)
    got = sequence.previous(sequence.numbered(df, block=block), "v", "before", block).collect()
    for symbol in "XY":
        own = [r for r in rows if r[0] == symbol]
        want = {a: (n + 1, own[n - 1][2] if n else None) for n, (_, a, _) in enumerate(own)}
        assert {r["arrival"]: (r["rn"], r["before"]) for r in got if r["symbol"] == symbol} == want


def test_comparison_refuses_and_reports(spark):
    local = spark.createDataFrame([("X", "B", 5, 1), ("X", "A", 9, 2)], LEVEL)
    compare.refuse_duplicates(local)
    compare.refuse_strangers(local, local)
    with pytest.raises(compare.Refused, match="X: price 5 stands 2 times"):
        compare.refuse_duplicates(local.unionByName(local.where("side = 'B'")))
    with pytest.raises(compare.Refused, match="no book of Y"):
        compare.refuse_strangers(local, local.withColumn("symbol", F.lit("Y")))
    remote = spark.createDataFrame([("X", "B", p, p) for p in range(1, 6)] + [("X", "A", 9, 3)], LEVEL)
    text = compare.report(compare.differences(local, remote), most=3).first()["text"]
    assert text.splitlines() == ["bid 5: local 1, snapshot 5", "bid 4: local 0, snapshot 4", "bid 3: local 0, snapshot 3", "3 more"]


def test_reads_of_a_book(spark):
    rows = [("X", "B", 10, 1), ("X", "B", 9, 2), ("X", "A", 11, 3), ("Y", "B", 5, 1), ("Z", "B", 7, 1), ("Z", "A", 7, 1)]
    df = spark.createDataFrame(rows, LEVEL)
    views = {r["symbol"]: r for r in book.view(df).collect()}
    assert (views["X"]["bid_price"], views["X"]["ask_price"], views["X"]["crossed"], views["X"]["bids"]) == (10, 11, False, 2)
    assert views["Y"]["ask_price"] is None and not views["Y"]["crossed"]
    assert views["Z"]["crossed"]
    assert book.top(df, 0).count() == 0
    assert [(r["price"], r["rank"]) for r in book.top(df, 1).where("symbol = 'X' AND side = 'B'").collect()] == [(10, 1)]
    view, top = book.query(df, "X", 5)
    assert view.count() == 1 and top.count() == 3
    with pytest.raises(book.UnknownSymbol):
        book.query(df, "NO", 5)


def test_bounds_and_duplicates(spark):
    rows = [("X", "B", 10, 1, True), ("X", "B", 8, 0, True), ("X", "A", 11, 3, True), ("Y", "B", 5, 1, False)]
    snap = spark.createDataFrame(rows, LEVEL + ", truncated boolean")
    assert [tuple(r) for r in book.bounds(snap).collect()] == [("X", 8, 11)]
    assert [tuple(r) for r in book.bounds(snap, zero_filtered=True).collect()] == [("X", 10, 11)]
    twice = spark.createDataFrame([("X", "B", 1, 2), ("X", "B", 1, 3), ("X", "A", 1, 0), ("X", "A", 1, 4)], LEVEL)
    assert [tuple(r) for r in book.duplicate_prices(twice).collect()] == [("X", "B", 1, 2)]


def test_comparison_and_verdicts(spark):
    local = spark.createDataFrame([("X", "B", 10, 1), ("X", "B", 5, 9), ("X", "A", 11, 3), ("Y", "B", 1, 1), ("Z", "B", 1, 1), ("W", "B", 1, 1)], LEVEL)
    remote = spark.createDataFrame([("X", "B", 10, 2), ("X", "A", 11, 3), ("X", "A", 12, 0), ("Y", "B", 1, 1), ("Z", "B", 1, 2), ("W", "B", 1, 5)], LEVEL)
    edges = spark.createDataFrame([("X", 9, 12)], "symbol string, bid_floor bigint, ask_ceil bigint")
    diffs = compare.describe(compare.differences(local, remote, edges)).where("symbol = 'X'").collect()
    assert [r["text"] for r in diffs] == ["bid 10: local 1, snapshot 2"]
    at = spark.createDataFrame([("X", True, 5, 7), ("Y", True, 5, 9), ("Z", True, 5, 5), ("W", False, 5, 5)], "symbol string, live boolean, local_id bigint, snapshot_id bigint")
    got = {r["symbol"]: (r["verdict"], r["id_skew"], r["compared"], r["diffs"]) for r in compare.summary(local, remote, at, edges).collect()}
    assert got == {"X": ("skewed", 2, 2, 1), "Y": ("ok", 4, 1, 0), "Z": ("diverged", 0, 1, 1), "W": ("skipped", 0, 1, 1)}


def _quantile(values, bounds, q):
    values = [v for v in values if v >= 0]
    counts = [0] * (len(bounds) + 1)
    for v in values:
        counts[next((k for k, b in enumerate(bounds) if v <= b), len(bounds))] += 1
    if not values:
        return 0
    cum, lower = 0, 0
    for k, n in enumerate(counts):
        cum += n
        if cum >= q * len(values):
            if k == len(bounds):
                return bounds[-1]
            return bounds[k] if not n else lower + int((bounds[k] - lower) * ((q * len(values) - (cum - n)) / n))
        lower = bounds[min(k, len(bounds) - 1)]
    return bounds[-1]


@pytest.mark.parametrize("values", [[], [5], [-3, 0, 10, 11, 99, 100, 101, 5000], list(range(0, 300, 7))])
def test_histogram(spark, values):
    bounds = [10, 100, 1000]
    df = spark.createDataFrame([(v,) for v in values], "ns bigint")
    hist = histogram.buckets(df, "ns", [100, 10, 10, 1000])
    assert [r["le"] for r in hist.orderBy("bucket").collect()] == [10, 100, 1000, None]
    for q in (-1, 0, 0.25, 0.5, 0.99, 1, 2):
        assert histogram.quantile(hist, q).first()["value"] == _quantile(values, bounds, min(max(q, 0), 1)), q
    t = histogram.totals(df, "ns").first()
    good = [v for v in values if v >= 0]
    assert (t["n"], t["total"], t["negative"], t["mean"]) == (len(good), sum(good), len(values) - len(good), sum(good) // len(good) if good else 0)


def test_exposition(spark):
    df = spark.createDataFrame([(1_000_000,), (2_000_000_000,), (-1,)], "ns bigint")
    text = histogram.exposition("x_seconds", "Help.", histogram.buckets(df, "ns", histogram.RESYNC), histogram.totals(df, "ns"))
    assert 'x_seconds_bucket{le="0.01"} 1' in text and 'x_seconds_bucket{le="2.5"} 2' in text and 'x_seconds_bucket{le="+Inf"} 2' in text
    assert "x_seconds_sum 2.001\nx_seconds_count 2\n" in text and text.endswith("x_seconds_negative_total 1\n")
    labelled = histogram.exposition("x", "Help.", histogram.buckets(df, "ns", [10]), histogram.totals(df.where("ns >= 0"), "ns"), 'a="b"')
    assert 'x_bucket{a="b",le="+Inf"}' in labelled and "negative" not in labelled
    with pytest.raises(ValueError, match="bound"):
        histogram.buckets(df, "ns", [])


def test_tracker_transitions():
    t = Tracker("X", capacity=3)
    assert t.apply("Y", 1, 1, [], []) == "error"
    assert t.begin_fetch() and not t.begin_fetch()
    assert [t.apply("X", k, k, [(k, 1)], []) for k in (8, 9, 10, 11)] == ["buffered"] * 4 and t.counts["dropped"] == 1
    assert t.load("X", 7, [(1, 1)], []) == "refetch" and not t.live and len(t.held) == 3
    assert t.begin_fetch()
    assert t.load("X", 9, [(1, 1), (2, 0)], [(5, 4)]) == "anchored" and t.live and t.last == 11 and t.bids == {1: 1, 10: 1, 11: 1}
    assert t.apply("X", 10, 11, [(99, 1)], []) == "discarded" and 99 not in t.bids
    assert t.apply("X", 12, 12, [(10, 0), (777, 0)], [(6, 2), (6, 3)]) == "applied" and t.bids == {1: 1, 11: 1} and t.asks == {5: 4, 6: 3}
    assert t.load("X", 11, [(4, 4)], []) == "behind" and t.last == 12
    assert t.load("X", 12, [(4, 4), (4, 5)], []) == "error" and t.last == 12 and t.live
    assert t.apply("X", 13, 13, [(0, 1)], []) == "error" and not t.live and t.bids == {1: 1, 11: 1}
    assert t.load("X", 13, [(3, 3), (2, 0)], [(9, 9)], truncated=True) == "anchored" and (t.bid_floor, t.ask_ceil) == (2, 9) and not t.held
    assert t.apply("X", 15, 16, [(8, 8)], []) == "gapped" and t.counts["gaps" if "gaps" in t.counts else "gapped"] == 1
    t.begin_fetch()
    t.fetch_failed()
    assert t.begin_fetch() and t.load("X", 3, [], []) == "refetch" and t.load("X", 14, [], []) == "anchored" and t.bids == {8: 8} and t.last == 16
    assert t.load("X", 16, [(1, 1)], []) == "anchored" and t.bids == {1: 1}


EVENT = "symbol string, arrival bigint, kind string, first_id bigint, last_id bigint, truncated boolean, bids array<struct<price: bigint, qty: bigint>>, asks array<struct<price: bigint, qty: bigint>>"


def _venue(symbols: int, deltas: int):
    """Updates with some lost, snapshots of the true book now and then, and the true book at the end."""
    rng, rows, truth, arrival = random.Random(3), [], {}, 0
    for s in (f"S{k}" for k in range(symbols)):
        last, sides = 1000, ({}, {})
        for k in range(deltas):
            change = [[(rng.randint(1, 40) + 100 * side, rng.randint(0, 5)) for _ in range(rng.randint(0, 3))] for side in (0, 1)]
            for side, levels in zip(sides, change, strict=True):
                for p, q in levels:
                    side.pop(p, None) if q == 0 else side.__setitem__(p, q)
            step = rng.randint(1, 3)
            first, last = last + 1, last + step
            arrival += 1
            if k % 17 != 16:
                rows.append((s, arrival, "delta", first, last, None, *change))
            if k % 17 in (3, 16) or k == 0:
                arrival += 1
                rows.append((s, arrival, "snapshot", None, last, False, *([*side.items()] for side in sides)))
        truth[s] = ({(b, p): q for b, side in zip("BA", sides, strict=True) for p, q in side.items()}, last)
    return rows, truth


def test_tracker_over_a_lossy_feed_in_batch_and_stream(spark, tmp_path):
    rows, truth = _venue(4, 60)
    df = spark.createDataFrame(rows, EVENT)
    for n in (1, 8):
        got = {}
        for r in track(df.repartition(n), levels=True).collect():
            assert r["live"]
            got.setdefault(r["symbol"], {})[r["side"], r["price"]] = r["qty"]
        assert got == {s: b for s, (b, _) in truth.items()}
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    query = track(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    batch = sorted(tuple(r) for r in track(df).collect())
    assert sorted(tuple(r) for r in seen) == batch
    assert {r["symbol"]: r["last_id"] for r in sorted(seen, key=lambda r: r["arrival"])} == {s: last for s, (_, last) in truth.items()}


def test_dump_is_equal_whatever_the_partitions(spark):
    rows = [(s, side, p, p % 7 + 1) for s in ("A-B", "C-D") for side in "BA" for p in range(1, 20)]
    at = spark.createDataFrame([("A-B", True, 5), ("C-D", False, 9)], "symbol string, live boolean, last_id bigint")
    texts = set()
    for n in (1, 8):
        df = spark.createDataFrame(rows, LEVEL).repartition(n)
        texts.add(sinks.dump(book.view(df, at), df))
    (text,) = texts
    lines = text.splitlines()
    assert lines[1] == "symbol A-B live=true last_id=5 crossed=true bids=19 asks=19" and lines[2] == "B 19 6" and lines[21] == "A 1 2" and text.endswith("\n")


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_asof_join_equals_a_scan(spark, block):
    from tidebook.operators.asof import asof_join

    rng = random.Random(11)
    left = [(rng.choice("XY"), k, k * 10) for k in range(0, 200, 3)]
    right = [(rng.choice("XYZ"), k, k + 1) for k in range(40, 200, 4)]
    got = asof_join(spark.createDataFrame(left, "symbol string, arrival bigint, v bigint"), spark.createDataFrame(right, "symbol string, arrival bigint, w bigint"), ["w"], block).collect()
    want = {}
    for s, k, v in left:
        seen = [(a, w) for z, a, w in right if z == s and a < k]
        want[s, k, v] = max(seen, default=(None, None))
    assert {(r["symbol"], r["arrival"], r["v"]): (r["matched_arrival"], r["w"]) for r in got} == want and len(got) == len(left)
