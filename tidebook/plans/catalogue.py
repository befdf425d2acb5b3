"""Registered queries of the order-book engine, over the feed derived from ``events`` unless they say otherwise.

Each ends with explicit types, so that its rows compare exactly with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook import tables
from tidebook.functions import symbols as S
from tidebook.functions.fixed import format_fixed, notional, parse_fixed
from tidebook.operators import asof, book, compare, decode, histogram, sequence, tracker
from tidebook.sources import feed, recording, replay
from tidebook.streaming import fanout, recorder, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Arrival up to which a book is read back, share of the feed (one in so many) behind which derived snapshots are taken, levels of a truncated one, and capacity of a derived queue.
CUT, CUT_SHARE, SHOWN, CAPACITY = 2000, 5, 20, 100


def registered(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.last_writer(feed.levels(spark, sf_dir))


@registered
def book_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lww(spark, sf_dir)


@registered
def book_asof_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.last_writer(feed.levels(spark, sf_dir).where(F.col("arrival") <= CUT))


@registered
def best_bid_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.best(_lww(spark, sf_dir))


@registered
def book_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(book.top(_lww(spark, sf_dir), 5), "rank")


@registered
def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.depth(_lww(spark, sf_dir))


@registered
def book_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.view(_lww(spark, sf_dir))


@registered
def book_crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.view(book.last_writer(feed.levels(spark, sf_dir, uncrossed=True))).select("symbol", "crossed")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.classify(feed.dense_levels(spark, sf_dir))


@registered
def seq_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.classify(feed.levels(spark, sf_dir)).select("symbol", "arrival", "position", "class")


@registered
def seq_latched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.latch(_classified(spark, sf_dir)).select("symbol", "arrival", "class")


@registered
def seq_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.latch(_classified(spark, sf_dir)).groupBy("symbol", "class").agg(F.count("*").alias("n"))


@registered
def seq_first_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.first_gaps(_classified(spark, sf_dir))


@registered
def seq_contiguity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes and overlaps against the running position, per symbol."""
    placed = sequence.running_position(feed.dense_levels(spark, sf_dir))
    step = F.col("first_id") - F.col("position") - 1
    return placed.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(step == 0).alias("exact"), F.count_if(step > 0).alias("holes"), F.count_if(step < 0).alias("overlaps"), F.max(step).alias("widest"))


def _cut(spark: SparkSession, sf_dir: str) -> int:
    """The arrival at which derived snapshots are taken: behind a fifth of the feed."""
    return feed.events(spark, sf_dir).count() // CUT_SHARE


def _latched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense feed with anchor (the last id of each symbol's snapshot), early (the rows the snapshot holds) and class, written once."""
    rows = tables.written(feed.dense_levels(spark, sf_dir).withColumn("early", F.col("arrival") < _cut(spark, sf_dir)), "feed")
    anchors = rows.where("early").groupBy("symbol").agg(F.max("last_id").alias("anchor"))
    return tables.written(sequence.latch(sequence.classify(rows.join(anchors, "symbol"), F.col("anchor"))), "latched")


def _books(latched: DataFrame) -> DataFrame:
    return book.snapshot_and_book(latched, F.col("early"))


def _book(both: DataFrame, side: str) -> DataFrame:
    """One of paired books."""
    return both.where(F.col(side) != 0).select("symbol", "side", "price", F.col(side).alias("qty"))


def _positions(latched: DataFrame) -> DataFrame:
    """Whether each symbol's book is live, and its position, once the feed has ended."""
    at = latched.groupBy("symbol").agg((F.count_if(F.col("class") == "gapped") == 0).alias("live"), F.max(F.when(F.col("class") == "contiguous", F.col("last_id"))).alias("_last"), F.max("anchor").alias("snapshot_id"))
    return at.select("symbol", "live", F.coalesce("_last", "snapshot_id").alias("local_id"), "snapshot_id")


@registered
def book_after_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(_books(_latched(spark, sf_dir)), "local")


def _truncated(snap: DataFrame) -> DataFrame:
    return book.top(snap, SHOWN).withColumn("truncated", F.lit(True)).drop("rank")


@registered
def snapshot_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = feed.dense_levels(spark, sf_dir).where(F.col("arrival") < _cut(spark, sf_dir))
    return book.bounds(_truncated(book.last_writer(early)))


@registered
def snapshot_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.duplicate_prices(feed.levels(spark, sf_dir).where(F.col("arrival") < _cut(spark, sf_dir)))


@registered
def level_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = feed.levels(spark, sf_dir).withColumns({"price": F.col("price") - 3, "qty": F.col("qty") - 2})
    return shifted.select("arrival", S.bad_level(F.array(F.struct("price", "qty"))).alias("invalid"))


@registered
def compare_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.differing(_books(_latched(spark, sf_dir)))


@registered
def compare_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tables.written(_books(_latched(spark, sf_dir)), "books")
    remote = _truncated(_book(both, "remote"))
    return compare.describe(compare.differences(_book(both, "local"), remote, None, book.bounds(remote, zero_filtered=True)))


@registered
def check_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book at each symbol's first gap against the snapshot: skipped where it gapped, else by ids and levels."""
    latched = _latched(spark, sf_dir)
    return compare.verdicts(_books(latched), _positions(latched)).select("symbol", "live", "local_id", "snapshot_id", "compared", "diffs", "id_skew", "verdict")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds between events of a symbol; the 13th of every hundred runs backwards."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = feed.events(spark, sf_dir).select((F.col("user_id") % 8).alias("symbol"), F.col("event_id").alias("arrival"), us.alias("us"))
    rows = sequence.previous(rows, "us", "before")
    gap = (F.col("us") - F.col("before")) * 1000
    return rows.withColumn("ns", F.when(F.col("arrival") % 100 == 13, -gap).otherwise(gap) % 12_000_000_000).where("ns IS NOT NULL").select("symbol", "arrival", "ns")


@registered
def hist_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(histogram.buckets(_gaps(spark, sf_dir), "ns", histogram.RESYNC, ["symbol"]), "bucket")


@registered
def hist_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.totals(_gaps(spark, sf_dir), "ns", ["symbol"])


@registered
def hist_quantile_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = histogram.buckets(_gaps(spark, sf_dir), "ns", histogram.RESYNC, ["symbol"])
    shares = {"p00": 0.0, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    found = histogram.quantiles(hist, shares, ["symbol"])
    return found.select("symbol", F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(q).alias("value")) for q in shares])))


@registered
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run reports at its end: events, whole events a second, and percentiles of the time between a symbol's events."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = feed.events(spark, sf_dir).agg(F.count("*").alias("events"), (F.max(us) - F.min(us)).alias("_us"))
    rate = F.when(F.col("_us") > 0, F.expr("events * 1000000 div _us")).otherwise(F.lit(0).cast("bigint"))
    quantiles = histogram.summary(_gaps(spark, sf_dir), "ns", histogram.TICK_TO_BOOK, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return seen.select("events", rate.alias("per_second")).join(F.broadcast(quantiles))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode(feed.frames(spark, sf_dir), feed.instruments(spark))


@registered
def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.when(F.col("kind") == "delta", F.size(c)).cast("bigint")
    return _decoded(spark, sf_dir).select("arrival", "kind", "symbol", "exchange_time", "is_buy", "price", "qty", "first_id", "last_id", size("bids").alias("bids"), size("asks").alias("asks"), "decode_error")


@registered
def decode_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _decoded(spark, sf_dir).where("kind = 'delta'")
    return _longs(decode.level_rows(good), "pos")


@registered
def decode_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with all kinds of damage: what is refused, and what the rest is read as."""
    size = lambda c: F.when(F.col("kind") == "delta", F.size(c)).cast("bigint")
    value = F.when(F.col("kind") == "delta", F.aggregate(F.concat("bids", "asks"), F.lit(0).cast("bigint"), lambda a, x: a + x["price"] * x["qty"]))
    found = decode.decode(feed.damaged_frames(spark, sf_dir), feed.instruments(spark))
    return found.select("arrival", "kind", "symbol", "exchange_time", "is_buy", "price", "qty", "first_id", "last_id", size("bids").alias("bids"), size("asks").alias("asks"), value.alias("levels_value"), "decode_error")


@registered
def depth_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x["price"] * x["qty"])
    found = decode.parse_depth(feed.damaged_bodies(spark, sf_dir), feed.instruments(spark))
    return found.select("symbol", "last_id", "truncated", "parse_error", total("bids").alias("bid_value"), total("asks").alias("ask_value"))


@registered
def frame_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receive time less exchange time of decoded events, in buckets."""
    rows = _decoded(spark, sf_dir).where("decode_error IS NULL").select((F.col("received_at") - S.known_time(F.col("exchange_time"))).alias("ns"))
    return _longs(histogram.buckets(rows, "ns", histogram.DECODE), "bucket")


@registered
def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter families that follow from decoding and from the statuses of one anchor."""
    d = _decoded(spark, sf_dir).agg(F.count("*").alias("frames"), F.count("decode_error").alias("decode_errors"))
    c = F.col("class")
    s = sequence.latch(_classified(spark, sf_dir)).agg(F.count("*").alias("events"), F.count_if(c == "contiguous").alias("deltas_applied"), F.count_if(c == "stale").alias("deltas_discarded"), F.count_if(c == "buffered").alias("deltas_buffered"), F.count_if(c == "gapped").alias("gaps"))
    each = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).alias("value")) for n in df.columns])))
    return each(d).unionByName(each(s))


@registered
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.log_lines(_decoded(spark, sf_dir).where("decode_error IS NULL"), feed.instruments(spark))


@registered
def snapshot_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth bodies built from the derived books, parsed with a limit of SHOWN."""
    rows = book.top(_lww(spark, sf_dir), 30).withColumn("symbol", F.format_string("S%d-USDT", "symbol"))
    pair = F.struct(F.col("rank").alias("r"), F.format_string('["%d.%02d000000","%d.00000000"]', F.expr("price div 100"), F.col("price") % 100, "qty").alias("x"))
    side = lambda s: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, pair))), lambda p: p["x"]), ","), F.lit("]"))
    body = F.format_string('{"lastUpdateId":%d,"bids":%s,"asks":%s}', F.max("price"), side("B"), side("A"))
    bodies = rows.groupBy("symbol").agg(body.alias("body")).withColumn("limit", F.lit(SHOWN))
    parsed = decode.parse_depth(bodies, feed.instruments(spark))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x["price"] * x["qty"])
    return parsed.select("symbol", "last_id", "truncated", "parse_error", total("bids").alias("bid_value"), total("asks").alias("ask_value"))


_TEXT = """CASE event_id % 12
    WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat('-', event_id, '.5') WHEN 2 THEN concat(event_id, '.25000000')
    WHEN 3 THEN concat(event_id, '.125') WHEN 4 THEN '' WHEN 5 THEN concat('.', event_id % 10) WHEN 6 THEN concat(event_id, 'e5')
    WHEN 7 THEN concat('92233720368547758', event_id) WHEN 8 THEN '-' WHEN 9 THEN concat('+', event_id) WHEN 10 THEN concat(event_id, '.00a') ELSE '-.' END"""


@registered
def fixed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.events(spark, sf_dir).select("event_id", F.expr(_TEXT).alias("text"))
    parsed = parse_fixed("text", 2)
    return rows.select("event_id", "text", parsed["value"].alias("value"), parsed["error"].alias("error"))


@registered
def fixed_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("event_id") * F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    return feed.events(spark, sf_dir).select("event_id", format_fixed(v, (F.col("event_id") % 5).cast("int")).alias("text"))


@registered
def trade_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.events(spark, sf_dir).select("event_id", F.round(F.col("value") * 100).cast("bigint").alias("price"), (F.col("event_type") == "purchase").alias("is_buy"))
    return rows.select("event_id", "is_buy", format_fixed("price", 2).alias("price"))


@registered
def notional_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        (F.round(F.col("l_extendedprice") * 100).cast("bigint") * 100_000).alias("p"), ((F.col("l_quantity").cast("bigint") - 2) * 1_000_000).alias("q"),
    )
    value = notional("p", "q")
    return rows.select("l_orderkey", "l_linenumber", value.alias("notional"), value.isNull().alias("overflow"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.upper("n_name").alias("base"), F.upper("r_name").alias("quote"))


@registered
def symbol_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = S.normalised_symbol(F.col("base"), F.col("quote"))
    return _pairs(spark, sf_dir).select("n_nationkey", symbol.alias("symbol"), S.raw_symbol(symbol).alias("raw"))


@registered
def symbol_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE n_nationkey % 5 WHEN 0 THEN concat(' ', lower(base), '-', quote, ' ') WHEN 1 THEN base WHEN 2 THEN concat(base, '-', quote, '-X') WHEN 3 THEN concat('-', quote) ELSE concat(base, '-', quote) END")
    return _pairs(spark, sf_dir).select("n_nationkey", S.valid_symbol(text).alias("symbol"))


@registered
def fnv_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = S.normalised_symbol(F.col("base"), F.col("quote"))
    return _pairs(spark, sf_dir).select(symbol.alias("symbol"), *[S.fnv1a_shard(symbol, n).cast("bigint").alias(f"of_{n}") for n in (4, 7, 64)])


@registered
def size_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE event_id % 5 WHEN 0 THEN '0.01000000' WHEN 1 THEN '1.00000000' WHEN 2 THEN '1' WHEN 3 THEN concat('0.', lpad('1', CAST(event_id % 8 + 1 AS INT), '0'), '0') ELSE '10.' END")
    return feed.events(spark, sf_dir).select("event_id", S.size_decimals(text).cast("bigint").alias("decimals"))


@registered
def instrument_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata built from nations: every fourth symbol is on a break, every fifth lacks a lot size."""
    one = F.expr("""concat('{"symbol":"', base, quote, '","status":"', IF(n_nationkey % 4 = 3, 'BREAK', 'TRADING'), '","baseAsset":"', base, '","quoteAsset":"', quote,
        '","filters":[{"filterType":"PRICE_FILTER","tickSize":"0.1000"},{"filterType":"PRICE_FILTER","tickSize":"0.', lpad('1', CAST(n_nationkey % 6 + 1 AS INT), '0'), '00"}',
        IF(n_nationkey % 5 = 4, '', ',{"filterType":"LOT_SIZE","stepSize":"1.000"}'), ']}')""")
    body = F.concat(F.lit('{"symbols":['), F.array_join(F.sort_array(F.collect_list(one)), ","), F.lit("]}"))
    return _longs(decode.parse_instruments(_pairs(spark, sf_dir).agg(body.alias("body"))), "price_decimals", "qty_decimals")


@registered
def hourly_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.frames(spark, sf_dir)
    return rows.groupBy(recording.hour_of(F.col("received_at")).alias("hour")).agg(F.count("*").alias("n"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))


@registered
def drop_oldest_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.keep_newest(feed.levels(spark, sf_dir).select("symbol", "arrival"), CAPACITY, ("symbol",))


@registered
def drop_oldest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.dropped(feed.levels(spark, sf_dir), CAPACITY, ("symbol",))


@registered
def drop_newest_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of 1,000 frames against a recorder's queue: what is recorded, and markers of what is lost."""
    rows = feed.levels(spark, sf_dir).select("arrival", (F.col("arrival") * 10).alias("received_at"), F.expr("arrival div 1000").alias("burst"), "price")
    return recorder.keep_oldest(rows, CAPACITY, "burst").select("burst", "arrival", "received_at", "price", "dropped")


@registered
def snapshot_serve_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(replay.serve_order(feed.levels(spark, sf_dir).select("symbol", "arrival")), "serve")


def _tracker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot at CUT ahead of all updates, as rows for the tracker."""
    rows = _latched(spark, sf_dir)
    level = F.struct(F.col("price"), F.col("qty"))
    none = "CAST(array() AS array<struct<price: bigint, qty: bigint>>)"
    side = lambda s: F.collect_list(F.when(F.col("side") == s, level))
    anchors = rows.groupBy("symbol").agg(F.max("anchor").alias("anchor"))
    first = _book(_books(rows), "remote").groupBy("symbol").agg(side("B").alias("bids"), side("A").alias("asks")).join(anchors, "symbol")
    text = F.col("symbol").cast("string").alias("symbol")
    snapshot = first.select(text, F.lit(-1).cast("bigint").alias("arrival"), F.lit("snapshot").alias("kind"), F.lit(None).cast("bigint").alias("first_id"), F.col("anchor").alias("last_id"), F.lit(False).alias("truncated"), "bids", "asks")
    one = F.array(level).cast("array<struct<price: bigint, qty: bigint>>")
    bid = F.col("side") == "B"
    deltas = rows.select(text, "arrival", F.lit("delta").alias("kind"), "first_id", "last_id", F.lit(False).alias("truncated"), F.when(bid, one).otherwise(F.expr(none)).alias("bids"), F.when(bid, F.expr(none)).otherwise(one).alias("asks"))
    return snapshot.unionByName(deltas)


@registered
def tracker_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of the stateful tracker; the snapshot's own rows are left out."""
    found = tracker.track(_tracker_rows(spark, sf_dir), capacity=1 << 30)
    return tracker.status_counts(found.where("status NOT IN ('snapshot', 'anchored')"))


@registered
def tracker_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.track(_tracker_rows(spark, sf_dir), levels=True, capacity=1 << 30).where("side IS NOT NULL").select("symbol", "side", "price", "qty")


def _lossy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.written(feed.lossy_rows(spark, sf_dir), "lossy")
    return rows, tables.written(feed.lossy_events(rows), "lossy-events")


@registered
def tracker_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of the tracker over a feed with holes: gaps, snapshots too old to be of use, resyncs, and a buffer of the usual size that runs over."""
    return tracker.status_counts(tracker.track(_lossy(spark, sf_dir)[1]))


@registered
def tracker_resync_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.track(_lossy(spark, sf_dir)[1], levels=True).where("side IS NOT NULL").select("symbol", "side", "price", "qty")


@registered
def tracker_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.counters(_lossy(spark, sf_dir)[1])


@registered
def tracker_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked books against snapshots of all that was sent, within the bounds of both."""
    rows, events = _lossy(spark, sf_dir)
    levels = tables.written(tracker.track(events, levels=True), "tracked")
    at, bounds = tracker.positions(levels, rows.groupBy("symbol").agg(F.max("last_id").alias("snapshot_id")))
    local = levels.where("side IS NOT NULL").select("symbol", "side", "price", "qty")
    return compare.summary(local, book.last_writer(rows.where("fresh")), at, bounds).select("symbol", "live", "local_id", "snapshot_id", "compared", "diffs", "id_skew", "verdict")


@registered
def replay_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the dump of the anchored books, numbered within their symbol."""
    latched = _latched(spark, sf_dir)
    local = _book(tables.written(_books(latched), "books"), "local")
    at = _positions(latched).withColumnRenamed("local_id", "last_id")
    lines = sinks.dump_lines(book.view(local, at), local)
    return lines.select("symbol", F.row_number().over(Window.partitionBy("symbol").orderBy("section", "at")).cast("bigint").alias("number"), "line")


@registered
def ohlcv_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.events(spark, sf_dir).where("event_type = 'purchase'").select((F.col("user_id") % 8).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("arrival"), F.round(F.col("value") * 100).cast("bigint").alias("price"), (F.col("user_id") + 1).alias("qty"))
    out = sinks.bars(rows)
    return out.select("symbol", F.expr("unix_micros(window.start) div 3600000000").alias("hour"), "open", "high", "low", "close", "volume", "trades")


@registered
def asof_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest bid level of its symbol before it."""
    rows = feed.levels(spark, sf_dir)
    bids = rows.where("side = 'B'").select("symbol", "arrival", F.col("price").alias("bid_price"), F.col("qty").alias("bid_qty"))
    trades = feed.events(spark, sf_dir).where("event_type = 'purchase'").select((F.col("user_id") % 8).alias("symbol"), F.col("event_id").alias("arrival"), F.round(F.col("value") * 100).cast("bigint").alias("price"))
    return asof.asof_join(trades, bids, ["bid_price", "bid_qty"], block=1000)
