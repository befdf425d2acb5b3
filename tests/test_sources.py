from __future__ import annotations

import json
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from tidebook.operators.decode import decode, event_of, parse_depth, parse_instruments
from tidebook.operators.tracker import track
from tidebook.sources import recording, replay, transport
from tidebook.streaming import fanout, recorder, sinks

#: name, base, quote, status, tick, step.
LISTED = [("OAKELM", "OAK", "ELM", "TRADING", "0.0500", "0.002"), ("FIRASH", "FIR", "ASH", "TRADING", "0.5", "10"), ("YEWELM", "YEW", "ELM", "HALT", "1", "1")]


def _listing(name, base, quote, status, tick, step) -> dict:
    return {"symbol": name, "status": status, "baseAsset": base, "quoteAsset": quote, "filters": [{"filterType": "LOT_SIZE", "stepSize": step}, {"filterType": "PRICE_FILTER", "tickSize": tick}]}


META = json.dumps({"symbols": [_listing(*x) for x in LISTED]})


def _delta(first: int, last: int, bids: str = "[]", asks: str = "[]", symbol: str = "OAKELM") -> str:
    return f'{{"stream":"x","data":{{"e":"depthUpdate","E":1712345678901,"s":"{symbol}","U":{first},"u":{last},"b":{bids},"a":{asks}}}}}'


@pytest.fixture(scope="module")
def instruments(spark):
    return parse_instruments(spark.createDataFrame([(META,)], "body string"))


def test_instruments(instruments):
    assert {tuple(r)[:4] for r in instruments.collect()} == {("OAKELM", "OAK-ELM", 2, 3), ("FIRASH", "FIR-ASH", 1, 0)}


def _shown(units: int, decimals: int, rng: random.Random) -> str:
    """units of 10**-decimals as text, padded with zeros beyond what the instrument has."""
    return f"{units // 10**decimals}.{str(units % 10**decimals).zfill(decimals) if decimals else ''}" + "0" * rng.randrange(4)


def test_frames_decode_to_what_they_were_made_of(spark, instruments):
    rng = random.Random(21)
    frames, want = [], []
    for k in range(200):
        raw, symbol, price, qty = rng.choice([("OAKELM", "OAK-ELM", 2, 3), ("FIRASH", "FIR-ASH", 1, 0)])
        level = lambda: (rng.randrange(1, 10**7), rng.randrange(10**6))  # noqa: B023, E731
        text = lambda x: [_shown(x[0], price, rng), _shown(x[1], qty, rng)]  # noqa: B023, E731
        body: dict = {"s": raw, "E": rng.randrange(1, 2**40)}
        if rng.random() < 0.5:
            x, maker = level(), rng.random() < 0.5
            body |= {"e": "aggTrade", "a": k, "p": text(x)[0], "q": text(x)[1], "m": maker, "M": True, "T": 3}
            want.append(("trade", symbol, body["E"] * 10**6, not maker, None, None, *x, None, None, None))
        else:
            first = rng.randrange(10**12)
            bids, asks = ([level() for _ in range(rng.randrange(4))] for _ in "ba")
            body |= {"e": "depthUpdate", "U": first, "u": first + k, "b": [text(x) for x in bids], "a": [text(x) for x in asks]}
            want.append(("delta", symbol, body["E"] * 10**6, None, first, first + k, None, None, bids, asks, None))
        members = list(body.items())
        rng.shuffle(members)
        out = json.dumps(dict(members), indent=rng.choice([None, 1]))
        frames.append((k, out if rng.random() < 0.5 else json.dumps({"stream": "y", "data": dict(members)})))
    rows = spark.createDataFrame(frames, "k int, data string").withColumn("kind", F.lit("clash"))
    got = sorted(decode(rows, instruments).collect(), key=lambda r: r["k"])
    plain = lambda v: [tuple(x) for x in v] if isinstance(v, list) else v
    assert [tuple(plain(v) for v in r[2:]) for r in got] == want and [r["data"] for r in got] == [f for _, f in frames]


@pytest.mark.parametrize(
    ("frame", "error"),
    [
        ('{"data":{"data":{"e":"aggTrade"}}}', "unknown type"), ('{"e":"ticker","s":"OAKELM"}', "unknown type"), ("[]", "unknown type"), (None, "unknown type"), ('{"data":3,"e":"aggTrade"}', "unknown type"),
        ('{"e":"aggTrade","s":"ELMOAK"}', "unknown symbol"), ('{"e":"aggTrade"}', "unknown symbol"), ('{"e":"aggTrade","s":"OAKELM"}', "syntax"), ('{"e":"aggTrade","s":"OAKELM","p":"3.004","q":"1"}', "too_many_decimals"),
        ('{"e":"aggTrade","s":"OAKELM","p":"3","q":"92233720368547758.08"}', "overflow"), ('{"e":"depthUpdate","s":"OAKELM","U":9223372036854775808}', "malformed"), ('{"e":"depthUpdate","s":"OAKELM","U":1e3}', "malformed"),
        ('{"e":"depthUpdate","s":"OAKELM","U":true}', "malformed"), ('{"e":"depthUpdate","s":"OAKELM","E":NaN}', "malformed"), ('{"e":"depthUpdate","s":"OAKELM"', "malformed"), ('{"e":"depthUpdate","s":"OAKELM"}', None),
        ('{"x":' + "[" * 5000 + "]" * 5000 + ',"e":"depthUpdate","s":"OAKELM"}', None), ('{"stream":"\\"","data":{"e":"depthUpdate","s":"OAKELM"},', None), ('{"e":"depthUpdate","s":"OAKELM","B":[["7","7"]]}', None),
    ],
)
def test_errors_of_frames(frame, error):
    got = event_of(frame, {"OAKELM": ("OAK-ELM", 2, 3)})
    assert got[-1] == error and (got[0] is None) == (error is not None)
    if error is None:
        assert got[4:6] == (0, 0) and got[8] == ([(700, 7000)] if '"B"' in frame else [])


def test_depth(spark, instruments):
    body = '{"lastUpdateId":%s,"bids":[["4.0500","6"],["4","0.5"]],"asks":[["4.10","%s"]]}'
    rows = [("OAK-ELM", body % (31, "3"), 900), ("OAK-ELM", body % (31, "3"), 2), ("OAK-ELM", body % (0, "3"), 0), ("OAK-ELM", body % (31, "3.0001"), 0), ("NO-NO", body % (31, "3"), 0), ("OAK-ELM", "[]", 0), ("OAK-ELM", None, 0)]
    got = parse_depth(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "symbol string, body string, limit int, k int"), instruments).collect()
    found = sorted((str(r["truncated"]), r["parse_error"] or "") for r in got)
    assert found == sorted([("False", ""), ("True", ""), ("None", "bad last id"), ("None", "too_many_decimals"), ("None", "unknown symbol"), ("None", "malformed"), ("None", "malformed")])
    whole = next(r for r in got if r["truncated"] is False)
    assert (whole["last_id"], [tuple(x) for x in whole["bids"]], [tuple(x) for x in whole["asks"]]) == (31, [(405, 6000), (400, 500)], [(410, 3000)])


def _write(path, records):
    path.write_bytes(recording.encode(records))


HOUR = 1_788_264_000_000_000_000


def test_recording_round_trip_and_corruption(spark, tmp_path):
    records = [("metadata", HOUR, META.encode()), ("frame", HOUR + 1, b"{}"), ("snapshot", HOUR + 2, recording.snapshot_payload("OAK-ELM", 7, [(1, 2)], [], False)), ("drop", HOUR + 3, struct.pack("<Q", 3))]
    assert recording.encode(records) == recording.encode(records)
    _write(tmp_path / "a.msr.zst", records)
    rows = recording.read(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["kind"], r["received_at"], bytes(r["payload"])) for r in rows] == records and rows[3]["dropped"] == 3
    assert recording.read(spark, str(tmp_path), kind="drop").count() == 1
    import zstandard

    raw = zstandard.ZstdDecompressor().decompressobj().decompress((tmp_path / "a.msr.zst").read_bytes())
    head = recording.RECORD
    bad = {"cut": raw[:-3], "kind": raw + head.pack(9, 0, 0), "long": raw + head.pack(1, 0, (16 << 20) + 1), "marker": raw + head.pack(4, 0, 1) + b"x", "magic": b"NO" + raw[2:]}
    for name, data in bad.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "b.msr.zst").write_bytes(zstandard.ZstdCompressor().compress(data))
        with pytest.raises(Exception, match="(?s)record|recording"):
            recording.read(spark, str(tmp_path / name)).collect()
        assert recording.read(spark, str(tmp_path / name), "PERMISSIVE").count() == {"cut": 3, "magic": 0}.get(name, 4)
    with pytest.raises(ValueError, match="too long"):
        recording.encode([("frame", 0, b"x" * ((16 << 20) + 1))])


def test_writer_rotates_by_hour_with_metadata_first(spark, tmp_path):
    at = [HOUR + 60_000_000_000, HOUR + 3_540_000_000_000, HOUR + 3_660_000_000_000]
    recording.register(spark)
    spark.createDataFrame([("frame", t, bytearray(b"{}")) for t in at], "kind string, received_at bigint, payload binary").coalesce(1).write.format("msr").option("metadata", META).mode("append").save(str(tmp_path))
    names = sorted(p.name for p in tmp_path.glob("*.msr.zst"))
    assert names == ["2026-09-01T12.msr.zst", "2026-09-01T13.msr.zst"] or len(names) == 2
    kinds = [r["kind"] for r in recording.read(spark, str(tmp_path)).orderBy("file", "idx").collect()]
    assert kinds == ["metadata", "frame", "frame", "metadata", "frame"]


def test_replay_from_files_to_books(spark, tmp_path):
    frames = [_delta(1, 5), _delta(6, 8, '[["1.00","2.000"]]'), _delta(9, 9, "[]", '[["3.00","1.000"]]'), "junk"]
    snap = recording.snapshot_payload("OAK-ELM", 5, [(50, 7)], [], False)
    _write(tmp_path / "1.msr.zst", [("metadata", HOUR, META.encode()), ("frame", HOUR, frames[0].encode()), ("snapshot", HOUR, snap), ("frame", HOUR + 10, frames[1].encode())])
    _write(tmp_path / "2.msr.zst", [("metadata", HOUR, b"{}"), ("frame", HOUR + 20, frames[2].encode()), ("frame", HOUR + 30, frames[3].encode()), ("drop", HOUR, struct.pack("<Q", 2))])
    r = replay.open_replay(spark, str(tmp_path))
    assert r.dropped == 2 and r.frames.count() == 4 and [x["symbol"] for x in replay.symbols(r.snapshots).collect()] == ["OAK-ELM"]
    assert [x["serve"] for x in replay.serve_order(r.snapshots).collect()] == [1]
    assert [x["due"] for x in replay.paced(r.frames, 2.0).orderBy("arrival").collect()] == [0, 5, 10, 15] and replay.paced(r.frames, 0).agg(F.max("due")).first()[0] == 0
    for _ in range(2):  # repeated replays agree
        got = {(x["side"], x["price"], x["qty"], x["live"], x["last_id"]) for x in track(replay.tracker_events(r), levels=True).collect()}
        assert got == {("B", 50, 7, True, 9), ("B", 100, 2000, True, 9), ("A", 300, 1000, True, 9)}
    (tmp_path / "1.msr.zst").unlink()
    (tmp_path / "2.msr.zst").unlink()
    _write(tmp_path / "3.msr.zst", [("frame", HOUR, b"{}")])
    with pytest.raises(replay.NoMetadata):
        replay.open_replay(spark, str(tmp_path))


def test_transport_seams():
    raw = {"OAK-ELM": "OAKELM", "FIR-ASH": "FIRASH"}
    assert transport.stream_path(["OAK-ELM", "FIR-ASH"], raw).endswith("oakelm@aggTrade/oakelm@depth@100ms/firash@aggTrade/firash@depth@100ms")
    with pytest.raises(ValueError, match="no symbols"):
        transport.stream_path([], raw)
    with pytest.raises(LookupError, match="X-Y"):
        transport.stream_path(["X-Y"], raw)
    assert transport.parse_symbols([" oak-elm"]) == ["OAK-ELM"]
    for bad in (["BTC"], ["A-B-C"], ["-B"], ["A-"], ["A-B", "a-b"]):
        with pytest.raises(ValueError, match="BASE-QUOTE|twice"):
            transport.parse_symbols(bad)
    wait = transport.Backoff(chance=lambda: 1.0)
    assert [wait.wait() for _ in range(9)] == [x * 1.25 for x in (0.5, 1, 2, 4, 8, 16, 32, 60, 60)]
    wait.delivered()
    assert wait.base() == 0.5
    assert transport.is_shutdown(b'{"e":"serverShutdown"}') and not transport.is_shutdown(b"{}")
    assert [transport.depth_limit(n) for n in (0, -1, 20, 5000, 6000)] == [5000, 5000, 20, 5000, 5000]
    assert transport.depth_body(lambda path: (200, path.encode()), "OAKELM", 20) == b"/api/v3/depth?symbol=OAKELM&limit=20"
    assert transport.metadata_body(lambda path: (200, path.encode()), ["A", "B"]) == b'/api/v3/exchangeInfo?symbols=["A","B"]'
    with pytest.raises(transport.FetchFailed) as e:
        transport.depth_body(lambda path: (429, b"x" * 1000), "OAKELM")
    assert str(e.value).count("x") == 512


def test_connection_waits_and_begins_anew():
    waits, shown = [], []
    stages = iter([[b"a", b"b"], OSError("refused"), [], [b"c", b'{"e":"serverShutdown"}', b"never"], [b"d"], OSError("gone")])
    left = [9]

    def dial():
        found = next(stages, None)
        if found is None:
            left[0] = 0
            return []
        if isinstance(found, OSError):
            raise found
        return found

    wait = transport.Backoff(chance=lambda: 0.0)
    link = transport.Connection(dial, clock=lambda: 7, sleep=waits.append, stopped=lambda: left[0] == 0, backoff=wait)
    shown = list(link.frames())
    assert shown == [(7, b"a"), (7, b"b"), (7, b"c"), (7, b"d")]
    assert waits == [0.5, 1.0, 2.0, 0.5, 1.0] and link.reconnects == 6


def test_recorder_never_waits_and_marks_what_it_lost(spark, tmp_path):
    rec = recorder.Recorder(str(tmp_path), META, capacity=3)
    taken = [rec.offer("frame", HOUR + k, str(k).encode()) for k in range(7)]
    assert taken == [True] * 3 + [False] * 4 and rec.dropped == 4
    rec.start()
    while rec.written < 3:
        time.sleep(0.01)
    fetch = rec.tee(lambda symbol: (5, [(1, 2)], [], False), lambda: HOUR + 3_600_000_000_000)
    assert fetch("OAK-ELM") == (5, [(1, 2)], [], False)
    rec.close()
    rec.close()
    assert not rec.offer("frame", HOUR, b"")
    rows = recording.read(spark, str(tmp_path)).orderBy("file_no", "idx").collect()
    assert [(r["kind"], r["dropped"]) for r in rows] == [("metadata", None), ("drop", 4), *[("frame", None)] * 3, ("metadata", None), ("snapshot", None)]
    for bad in (("", 1), (META, 0)):
        with pytest.raises(ValueError, match="metadata|capacity"):
            recorder.Recorder(str(tmp_path), *bad)


def test_an_hour_in_parts_is_read_in_order(spark, tmp_path):
    rows = [("frame", HOUR + k * 100_000_000_000, bytearray(str(k).encode())) for k in range(70)]
    records = spark.createDataFrame(rows, "kind string, received_at bigint, payload binary").repartition(3)
    recording.record(records, f"file://{tmp_path}", META, parts=4)
    names = sorted(p.name for p in tmp_path.glob("*.msr.zst"))
    assert len(names) == 8 and len({n[:13] for n in names}) == 2
    got = recording.read(spark, str(tmp_path), kind="frame").orderBy("file_no", "idx").collect()
    assert [r["received_at"] for r in got] == [r[1] for r in rows]


def test_frames_are_emitted_when_they_are_due(spark):
    frames = spark.createDataFrame([(2, 1_500, "c"), (0, 1_000, "a"), (1, 1_200, "b")], "arrival bigint, received_at bigint, data string")
    now, waits = [0], []

    def sleep(seconds):
        waits.append(round(seconds * 1e9))
        now[0] += round(seconds * 1e9)

    assert list(replay.emit(frames, 2.0, lambda: now[0], sleep)) == [(1_000, "a"), (1_200, "b"), (1_500, "c")] and waits == [100, 150]
    assert len(list(replay.emit(frames, 0, lambda: now[0], sleep))) == 3 and len(waits) == 2


def test_a_query_settles_and_stops_or_runs_out_of_time(spark, tmp_path):
    spark.range(20).coalesce(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    seen = []
    query = source.writeStream.foreachBatch(lambda b, _: seen.extend(r[0] for r in b.collect())).option("checkpointLocation", str(tmp_path / "a")).start()
    fanout.settle(query, 60)
    assert sorted(seen) == list(range(20)) and not query.isActive
    stuck = source.writeStream.foreachBatch(lambda b, _: time.sleep(5)).option("checkpointLocation", str(tmp_path / "b")).start()
    with pytest.raises(fanout.NotSettled):
        fanout.settle(stuck, 0.5)


def test_publisher_drops_the_oldest(spark, tmp_path):
    spark.range(5).selectExpr("id AS arrival").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("arrival bigint").parquet(str(tmp_path / "in"))
    seen: dict[str, list] = {"slow": [], "quick": []}
    hub = fanout.Publisher()
    hub.subscribe("slow", 2, lambda b, _: seen["slow"].extend(r[0] for r in b.collect()))
    hub.subscribe("quick", 100, lambda b, _: seen["quick"].extend(r[0] for r in b.collect()))
    with pytest.raises(ValueError, match="exists"):
        hub.subscribe("slow", 2, print)
    with pytest.raises(ValueError, match="positive"):
        hub.subscribe("none", 0, print)
    hub.start(events, str(tmp_path / "cp"))
    hub.close()
    hub.close()
    with pytest.raises(RuntimeError):
        hub.subscribe("late", 1, print)
    assert sorted(seen["slow"]) == [3, 4] and sorted(seen["quick"]) == [0, 1, 2, 3, 4] and hub.dropped() == {"quick": 0, "slow": 3}


def test_sinks(spark, instruments, tmp_path):
    text = sinks.metrics_text({"frames": 3, "gaps": 1}, {1: 0, 0: 2}, {"b": 1, 'a"': 2})
    assert "tidebook_frames_total 3" in text and text.index('shard="0"} 2') < text.index('shard="1"} 0') and 'subscriber="a\\""} 2' in text and "tidebook_checks_total" not in text
    frames = spark.createDataFrame([(0, HOUR, _delta(1, 2)), (1, HOUR + 86_400_000_000_000, _delta(3, 4))], "arrival bigint, received_at bigint, data string")
    decoded = decode(frames, instruments)
    lines = [r["line"] for r in sinks.log_lines(decoded.withColumn("kind", F.when(F.col("arrival") == 1, "odd").otherwise(F.col("kind"))), instruments).orderBy("arrival").collect()]
    assert lines == ['{"msg":"book_delta","symbol":"OAK-ELM","first_id":1,"last_id":2,"bids":0,"asks":0}', '{"msg":"unknown event kind","kind":"odd"}']
    decoded.write.parquet(str(tmp_path / "in"))
    query = sinks.write_parquet(spark.readStream.schema(decoded.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("symbol", "date").distinct().count() == 2


def test_bars_stream_with_watermark(spark, tmp_path):
    rows = [("X", f"2026-01-01 0{h}:{m:02d}:00", k, 100 + k, 1) for k, (h, m) in enumerate([(0, 1), (0, 30), (1, 5), (3, 0)])]
    df = spark.createDataFrame(rows, "symbol string, t string, arrival bigint, price bigint, qty bigint").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    assert [(r["open"], r["close"], r["trades"]) for r in sinks.bars(df).orderBy("window").collect()] == [(100, 101, 2), (102, 102, 1), (103, 103, 1)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    query = sinks.bars(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="10 minutes").writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(r["open"] for r in out) == [100, 102]


def test_recording_by_spark_and_replay_to_a_dump(spark, tmp_path):
    from tidebook.plans.replay import run

    frames = [(HOUR + k * 60_000_000_000 * 7, _delta(k + 1, k + 1, f'[["{k + 1}.00","{k % 3}.000"]]')) for k in range(20)] + [(HOUR + 1, "junk")]
    snaps = [(HOUR, "OAK-ELM", 4, [(50, 7)], [(900, 1)], None), (HOUR, "FIR-ASH", 1, [], [], True)]
    rows = recording.frame_records(spark.createDataFrame(frames, "received_at bigint, data string").repartition(5))
    pair = "array<struct<price: bigint, qty: bigint>>"
    kept = recording.snapshot_records(spark.createDataFrame(snaps, f"received_at bigint, symbol string, last_id bigint, bids {pair}, asks {pair}, truncated boolean"))
    recording.record(rows.unionByName(kept), str(tmp_path), META)
    assert len(list(tmp_path.glob("*.msr.zst"))) == 3
    got = run(spark, str(tmp_path), repeat=2)
    assert (got.frames, got.decode_errors, got.dropped) == (21, 1, 0)
    lines = got.dump.splitlines()
    bids = [f"B {100 * (k + 1)} {1000 * (k % 3)}" for k in reversed(range(4, 20)) if k % 3]
    assert lines[1:] == ["symbol FIR-ASH live=true last_id=1 crossed=false bids=0 asks=0", f"symbol OAK-ELM live=true last_id=20 crossed=true bids={len(bids) + 1} asks=1", *bids, "B 50 7", "A 900 1"]
    with pytest.raises(ValueError, match="metadata"):
        recording.record(rows, str(tmp_path), "")
