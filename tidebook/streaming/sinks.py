"""Sinks: log lines, metrics text, book dumps, Parquet by symbol and date, and windowed bars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.functions.fixed import format_fixed

PREFIX = "tidebook"
#: Names of the counter families, in the order in which they are shown, and their help.
FAMILIES = {
    "frames": "Frames received.",
    "decode_errors": "Frames that could not be decoded.",
    "route_errors": "Events that no book took.",
    "events": "Events handled by books.",
    "deltas_applied": "Updates applied to a book.",
    "deltas_discarded": "Updates that a book already held.",
    "deltas_buffered": "Updates held until a snapshot.",
    "gaps": "Holes in update ids.",
    "snapshots": "Snapshots that anchored a book.",
    "refetches": "Snapshots too old for the updates held.",
    "fetch_failures": "Snapshot requests that failed.",
    "book_errors": "Events that a book refused.",
    "queries": "Book reads answered.",
    "checks": "Books compared with a snapshot.",
    "check_divergences": "Comparisons that differ at the same update id.",
    "check_skewed": "Comparisons that differ at different update ids.",
    "recorded": "Records written.",
    "record_dropped": "Frames lost before they were recorded.",
    "record_files": "Recording files opened.",
}


def log_lines(events: DataFrame, instruments: DataFrame) -> DataFrame:
    """arrival, level, line (JSON): what a log subscriber shows of each event; an unknown symbol is shown unscaled."""
    sized = events.join(instruments.select("symbol", "price_decimals", "qty_decimals"), "symbol", "left")
    price_d, qty_d = (F.coalesce(c, F.lit(0)) for c in ("price_decimals", "qty_decimals"))
    trade = F.to_json(F.struct(F.lit("trade").alias("msg"), "symbol", format_fixed("price", price_d).alias("price"), format_fixed("qty", qty_d).alias("qty"), F.when(F.col("is_buy"), "buy").otherwise("sell").alias("side")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(c)
    delta = F.to_json(F.struct(F.lit("book_delta").alias("msg"), "symbol", "first_id", "last_id", size("bids"), size("asks")))
    snap = F.to_json(F.struct(F.lit("snapshot").alias("msg"), "symbol", "last_id", size("bids"), size("asks")))
    kind = F.col("kind")
    line = F.when(kind == "trade", trade).when(kind == "delta", delta).when(kind == "snapshot", snap).otherwise(F.to_json(F.struct(F.lit("unknown event kind").alias("msg"), "kind")))
    return sized.select("arrival", F.when(kind.isin("trade", "delta", "snapshot"), "INFO").otherwise("WARN").alias("level"), line.alias("line"))


def metrics_text(counters: Mapping[str, int], backlog: Mapping[int, int] = {}, dropped: Mapping[str, int] = {}, histograms: str = "") -> str:  # noqa: B006
    """Text exposition of the counters at hand, the backlog of shards, histograms, and subscribers' losses by name."""
    out: list[str] = []
    for name, about in FAMILIES.items():
        if name in counters:
            full = f"{PREFIX}_{name}_total"
            out += [f"# HELP {full} {about}", f"# TYPE {full} counter", f"{full} {counters[name]}"]
    full = f"{PREFIX}_shard_queue_depth"
    out += [f"# HELP {full} Events waiting for a shard.", f"# TYPE {full} gauge", *(f'{full}{{shard="{k}"}} {n}' for k, n in sorted(backlog.items()))]
    full = f"{PREFIX}_subscriber_dropped_total"
    quoted = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    losses = [f"# HELP {full} Events dropped for a slow subscriber.", f"# TYPE {full} counter", *(f'{full}{{subscriber="{quoted(k)}"}} {n}' for k, n in sorted(dropped.items()))]
    return "\n".join(out) + "\n" + histograms + "\n".join(losses) + "\n"


def dump_lines(view: DataFrame, book: DataFrame) -> DataFrame:
    """symbol, section, at, line: the lines of a dump below its header; sorted by the first three they are its text.

    view has symbol, live, last_id, crossed, bids and asks.  Nothing of the machine, the clock or the partitioning is in it."""
    head = F.format_string("symbol %s live=%s last_id=%d crossed=%s bids=%d asks=%d", F.col("symbol").cast("string"), F.col("live").cast("string"), "last_id", F.col("crossed").cast("string"), "bids", "asks")
    bid = F.col("side") == "B"
    levels = book.select(F.col("symbol").cast("string").alias("symbol"), F.when(bid, 1).otherwise(2).alias("section"), F.when(bid, -F.col("price")).otherwise(F.col("price")).alias("at"), F.format_string("%s %d %d", "side", "price", "qty").alias("line"))
    return view.select(F.col("symbol").cast("string").alias("symbol"), F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("at"), head.alias("line")).unionByName(levels)


def dump(view: DataFrame, book: DataFrame) -> str:
    """The whole dump; byte-equal for equal books."""
    rows = dump_lines(view, book).orderBy("symbol", "section", "at").toLocalIterator()
    return "\n".join(["tidebook replay dump v1", *(r["line"] for r in rows)]) + "\n"


def date_of(ns: Column) -> Column:
    return F.to_date(F.timestamp_micros(F.floor(ns / 1000).cast("bigint")))


def write_parquet(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream decoded events to zstd Parquet by symbol and date."""
    return (
        events.withColumn("date", date_of(F.col("received_at")))
        .writeStream.format("parquet").option("compression", "zstd").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("symbol", "date").trigger(availableNow=True).start()
    )


def bars(trades: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """Open, high, low, close, volume and count per symbol and window of trades (symbol, ts, arrival, price, qty); with ``late`` as a watermark for streams."""
    rows = trades.withWatermark("ts", late) if late else trades
    return rows.groupBy("symbol", F.window("ts", every)).agg(
        F.min_by("price", "arrival").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "arrival").alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trades")
    )
