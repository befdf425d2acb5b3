"""An order-book feed derived from the ``events`` table, in integers that any engine reproduces."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.operators.sequence import numbered, running_position

#: Fixed instruments of the derived feed.
INSTRUMENTS = [(f"S{k}USDT", f"S{k}-USDT", 2, 0) for k in range(8)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def instruments(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, INSTRUMENTS)) + " AS t(raw, symbol, price_decimals, qty_decimals)")


def levels(spark: SparkSession, sf_dir: str, uncrossed: bool = False) -> DataFrame:
    """symbol, arrival, side, price, qty, pos, first_id, last_id, user_id: one level per event."""
    price = F.round(F.col("value") * 100).cast("bigint") % 97 + 1
    side = F.when(F.col("event_type").isin("view", "click"), "B").otherwise("A")
    if uncrossed:
        price = price + F.when(side == "A", 100).otherwise(0)
    return events(spark, sf_dir).select(
        (F.col("user_id") % 8).alias("symbol"),
        F.col("event_id").alias("arrival"),
        side.alias("side"),
        price.alias("price"),
        F.when(F.col("event_type") == "error", F.lit(0).cast("bigint")).otherwise(F.col("user_id") + 1).alias("qty"),
        F.lit(0).alias("pos"),
        F.col("event_id").alias("first_id"),
        (F.col("event_id") + F.col("user_id") % 5 * 10).alias("last_id"),
        "user_id",
    )


def dense_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same levels with ids that run on per symbol, overlaps, and a hole of ten updates in every 400."""
    rows = numbered(levels(spark, sf_dir, uncrossed=True)).where("rn % 400 < 390")
    last = 2 * F.col("rn") + F.when(F.col("user_id") % 5 == 0, 5).otherwise(0)
    return rows.withColumns({"first_id": 2 * F.col("rn") - 1, "last_id": last}).drop("rn")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arrival, received_at, data: JSON as a venue would send it; purchases are trades, every 50th frame is of an unknown type and every 70th of an unknown symbol."""
    rows = levels(spark, sf_dir).join(events(spark, sf_dir).select(F.col("event_id").alias("arrival"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "arrival")
    raw = F.when(F.col("arrival") % 70 == 69, F.lit("XXXUSDT")).otherwise(F.format_string("S%dUSDT", "symbol"))
    money = F.format_string("%d.%02d000000", F.expr("price div 100"), F.col("price") % 100)
    count = F.format_string("%d.00000000", "qty")
    millis = F.expr("us div 1000")
    trade = F.format_string('{"e":"aggTrade","E":%d,"s":"%s","p":"%s","q":"%s","m":%s}', millis, raw, money, count, F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"))
    pair = F.format_string('[["%s","%s"]]', money, count)
    bid = F.col("side") == "B"
    name = F.when(F.col("arrival") % 50 == 49, "bookTicker").otherwise("depthUpdate")
    delta = F.format_string('{"e":"%s","E":%d,"s":"%s","U":%d,"u":%d,"b":%s,"a":%s}', name, millis, raw, "first_id", "last_id", F.when(bid, pair).otherwise("[]"), F.when(bid, "[]").otherwise(pair))
    inner = F.when(F.col("event_type") == "purchase", trade).otherwise(delta)
    data = F.when(F.col("arrival") % 3 == 0, inner).otherwise(F.format_string('{"stream":"x","data":%s}', inner))
    return rows.select("arrival", (F.col("us") * 1000 + 5000).alias("received_at"), data.alias("data"))


def metadata() -> str:
    """Instrument metadata of the derived feed, as a venue would send it."""
    filters = lambda p, q: [{"filterType": "PRICE_FILTER", "tickSize": f"{10**-p:.{p}f}"}, {"filterType": "LOT_SIZE", "stepSize": f"{10**-q:.{q}f}"}]
    return json.dumps({"symbols": [{"symbol": raw, "status": "TRADING", "baseAsset": symbol.split("-")[0], "quoteAsset": symbol.split("-")[1], "filters": filters(p, q)} for raw, symbol, p, q in INSTRUMENTS]})


def whole_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, received_at, payload: a recording of the feed without holes: an empty snapshot of each symbol, then a frame for each update."""
    rows = numbered(levels(spark, sf_dir, uncrossed=True))
    money = F.format_string("%d.%02d000000", F.expr("price div 100"), F.col("price") % 100)
    pair = F.format_string('[["%s","%d.00000000"]]', money, "qty")
    bid = F.col("side") == "B"
    text = F.format_string('{"stream":"x","data":{"e":"depthUpdate","E":%d,"s":"S%dUSDT","U":%d,"u":%d,"b":%s,"a":%s}}', F.col("arrival") + 1, "symbol", 2 * F.col("rn") - 1, 2 * F.col("rn"), F.when(bid, pair).otherwise("[]"), F.when(bid, "[]").otherwise(pair))
    frames = rows.select(F.lit("frame").alias("kind"), F.lit(1_700_000_000_000_000_000).cast("bigint").alias("at"), F.col("arrival"), text.cast("binary").alias("payload"))
    empty = spark.createDataFrame([(f"S{k}-USDT",) for k in range(8)], "symbol string").select(F.to_json(F.struct(F.col("symbol").alias("Symbol"), F.lit(0).alias("LastID"), F.array().cast("array<int>").alias("Bids"), F.array().cast("array<int>").alias("Asks"), F.lit(False).alias("Truncated"))).cast("binary").alias("payload"))
    snapshots = empty.select(F.lit("snapshot").alias("kind"), F.lit(1_700_000_000_000_000_000).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("arrival"), "payload")
    return snapshots.unionByName(frames).select("kind", (F.col("at") + (F.col("arrival") + 1) * 1000).alias("received_at"), "payload")


#: Rows of the busy symbol before its first snapshot comes, and rows that this one holds.
LATE, TAKEN = 2600, 1000


def lossy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense levels before any is lost, three quarters of them of one symbol; kept: whether the update arrives; fresh: whether it is not stale. At ``arrival`` * 64 there is room for snapshots."""
    rows = levels(spark, sf_dir, uncrossed=True).withColumn("symbol", F.when(F.col("symbol") < 6, 0).otherwise(F.col("symbol")))
    rows = numbered(rows)
    last = 2 * F.col("rn") + F.when(F.col("user_id") % 5 == 0, 5).otherwise(0)
    rows = running_position(rows.withColumns({"symbol": F.format_string("S%d-USDT", "symbol"), "arrival": F.col("arrival") * 64, "first_id": 2 * F.col("rn") - 1, "last_id": last, "kept": F.col("rn") % 400 < 390}))
    return rows.withColumn("fresh", F.col("last_id") > F.col("position"))


def lossy_events(rows: DataFrame) -> DataFrame:
    """Rows for a tracker over lossy_rows: the updates that arrive, and snapshots.

    At the end of each hole of lost updates one snapshot is recorded that ends
    before it and is of no use, and one that covers it.  The busy symbol's first
    snapshot comes after LATE rows, when its buffer has run over, holds TAKEN
    rows, and is followed at once by those of the holes up to then.  The others
    begin with an empty snapshot."""
    none = F.expr("CAST(array() AS array<struct<price: bigint, qty: bigint>>)")
    level = F.array(F.struct("price", "qty")).cast("array<struct<price: bigint, qty: bigint>>")
    bid = F.col("side") == "B"
    unset = F.lit(None).cast("bigint")
    deltas = rows.where("kept").select("symbol", "arrival", F.lit("delta").alias("kind"), "first_id", "last_id", F.lit(False).alias("truncated"), F.when(bid, level).otherwise(none).alias("bids"), F.when(bid, none).otherwise(level).alias("asks"))
    busy = F.col("symbol") == "S0-USDT"
    late = rows.where(busy & (F.col("rn") == LATE)).select("symbol", F.col("arrival").alias("late_at"))
    ends = rows.where("rn % 400 = 399").select("symbol", "rn", "arrival").join(late, "symbol", "left")
    early = busy & (F.col("rn") <= LATE)
    useful = ends.where(~(busy & (F.col("rn") <= TAKEN))).select("symbol", F.col("rn").alias("upto"), F.when(early, F.col("late_at") + 2 + F.expr("rn div 400")).otherwise(F.col("arrival") + 1).alias("arrival"))
    useless = ends.where(~early).select("symbol", (F.col("rn") - 99).alias("upto"), "arrival")
    first = late.select("symbol", F.lit(TAKEN).cast("bigint").alias("upto"), (F.col("late_at") + 1).alias("arrival"))
    empty = rows.where(~busy).select("symbol").distinct().select("symbol", F.lit(0).cast("bigint").alias("upto"), F.lit(-1).cast("bigint").alias("arrival"))
    taken = useful.unionByName(useless).unionByName(first).unionByName(empty).where("arrival IS NOT NULL")
    # A level stands from its writing to the next of its price; snapshots are taken at some of the rows in between.
    after = F.lead("rn").over(Window.partitionBy("symbol", "side", "price").orderBy("rn"))
    total = rows.groupBy("symbol").agg(F.max("rn").alias("total"))
    spans = rows.where("fresh").select("symbol", "side", "price", "qty", "rn", after.alias("after")).join(total, "symbol").withColumn("until", F.coalesce(F.col("after") - 1, "total"))
    spans = spans.withColumn("hundred", F.explode(F.expr("sequence(rn div 100, until div 100)")))
    held = taken.withColumn("hundred", F.expr("upto div 100")).join(spans, ["symbol", "hundred"]).where("rn <= upto AND upto <= until AND qty <> 0")
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("price", "qty")))
    books = held.groupBy("symbol", "upto").agg(side("B").alias("bids"), side("A").alias("asks"))
    tops = rows.select("symbol", F.col("rn").alias("upto"), F.greatest("position", "last_id").alias("last_id"))
    snaps = taken.join(books, ["symbol", "upto"], "left").join(tops, ["symbol", "upto"], "left")
    snapshots = snaps.select("symbol", "arrival", F.lit("snapshot").alias("kind"), unset.alias("first_id"), F.coalesce("last_id", F.lit(0).cast("bigint")).alias("last_id"), F.lit(False).alias("truncated"), F.coalesce("bids", none).alias("bids"), F.coalesce("asks", none).alias("asks"))
    return deltas.unionByName(snapshots)


#: Damage done to derived trades, updates and snapshot bodies, by the number of a row: what is replaced, and by what.
TRADE_DAMAGE = (
    ("}", "}"), ('"m":true', '"m":"true"'), ('"m":true', '"m":null'), (',"m":true', ""), ('"E":', '"E":1.5,"f":'), ('"E":', '"E":"x","f":'), ('"E":', '"f":'), ('"p":"', '"p":7,"f":"'),
    ('"e":"aggTrade"', '"e":"aggTrade","e":"depthUpdate"'), ('"e":"aggTrade"', '"e":"depthUpdate","e":"aggTrade"'), ('"e":"aggTrade"', '"e":7'), ("}", "} x"), ("}", ""), ('"q":"', '"Q":"1","q":"'), ('"p":"', '"p":"x'), ("{", "[{"),
)
DELTA_DAMAGE = (
    ("}", "}"), ('"b":', '"b":"junk","x":'), ('"b":', '"b":[null],"x":'), ('"b":', '"b":[["1"]],"x":'), ('"b":', '"b":[["1","2","3"]],"x":'), ('"b":', '"b":[[1,2]],"x":'), ('"b":', '"b":null,"x":'), ('"b":', '"b":{},"x":'),
    ('"U":', '"x":'), ('"u":', '"u":"1","x":'), ('"b":', '"b":[["1","2"],null],"x":'), ('"b":', '"b":[["1",null]],"x":'), ('"b":', '"b":[["9","9"]],"b":'), ('"s":', '"s":7,"x":'), ('"e":', '"\\u0065":'), ("}", ",}"),
)
DEPTH_DAMAGE = (
    ("}", "}"), ('"bids":', '"bids":"junk","x":'), ('"bids":', '"bids":[null],"x":'), ('"lastUpdateId":', '"x":'), ('"lastUpdateId":', '"lastUpdateId":"1","x":'), ('"lastUpdateId":', '"lastUpdateId":-'),
    ('"asks":', '"asks":[["1.001","1"]],"x":'), ('"asks":', '"asks":[["1","1"]],"asks":'), ("}", ""), ('"bids":', '"bids":[["1",2]],"x":'), ('"bids":', '"bids":null,"x":'), ("{", "[{"),
)


def damaged(text: Column, number: Column, damage: tuple[tuple[str, str], ...]) -> Column:
    """text after the damage of that number, done where its pattern first occurs."""
    out = text
    for k, (what, by) in enumerate(damage):
        at = F.instr(text, F.lit(what))
        cut = F.concat(F.substr(text, F.lit(1), at - 1), F.lit(by), F.substr(text, at + len(what)))
        out = F.when((number == k) & (at > 0), cut).otherwise(out)
    return out


def damaged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arrival, received_at, data: trades and updates of one known symbol, each with the damage of its number."""
    money, k = F.format_string("%d.%02d000000", F.expr("event_id div 100 + 1"), F.col("event_id") % 100), (F.col("event_id") % 16).cast("int")
    pair = F.format_string('[["%s","%d.00000000"]]', money, F.col("event_id") + 1)
    trade = F.format_string('{"e":"aggTrade","E":%d,"s":"S1USDT","p":"%s","q":"%d.00000000","m":true}', F.col("event_id") + 1, money, F.col("event_id") + 1)
    delta = F.format_string('{"e":"depthUpdate","E":%d,"s":"S1USDT","U":%d,"u":%d,"b":%s,"a":%s}', F.col("event_id") + 1, "event_id", F.col("event_id") + 2, pair, pair)
    inner = F.when(F.col("event_id") % 32 < 16, damaged(trade, k, TRADE_DAMAGE)).otherwise(damaged(delta, k, DELTA_DAMAGE))
    data = F.when(F.col("event_id") % 3 == 0, F.format_string('{"stream":"x","data":%s}', inner)).otherwise(inner)
    return events(spark, sf_dir).select(F.col("event_id").alias("arrival"), F.col("event_id").alias("received_at"), data.alias("data"))


def damaged_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, body, limit: snapshot bodies whose position is the event's number and one more, each with the damage of its number."""
    money, k = F.format_string("%d.%02d", F.expr("event_id div 100 + 1"), F.col("event_id") % 100), (F.col("event_id") % 12).cast("int")
    body = F.format_string('{"lastUpdateId":%d,"bids":[["%s","1"],["0.50","2"]],"asks":[["%s","3"]]}', F.col("event_id") + 1, money, money)
    return events(spark, sf_dir).select(F.lit("S1-USDT").alias("symbol"), damaged(body, k, DEPTH_DAMAGE).alias("body"), F.lit(2).alias("limit"))
