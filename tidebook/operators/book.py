"""Order books as rows (symbol, side, price, qty): building them and reading them.

Quantities are absolute, so a book is an aggregate: the last writer of each
price wins and a quantity of zero deletes.  The aggregate is combined before
the shuffle, and no symbol needs to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BID, ASK = "B", "A"


def last_writer(levels: DataFrame) -> DataFrame:
    """The book after all of levels (symbol, side, price, qty, arrival, pos), applied by (arrival, pos)."""
    last = levels.groupBy("symbol", "side", "price").agg(F.max_by("qty", F.struct("arrival", "pos")).alias("qty"))
    return last.where("qty <> 0")


def duplicate_prices(snapshot: DataFrame) -> DataFrame:
    """(symbol, side, price) that a snapshot holds more than once among its non-zero levels: it must be refused."""
    return snapshot.where("qty <> 0").groupBy("symbol", "side", "price").agg(F.count("*").alias("copies")).where("copies > 1")


def invalid_levels(levels: DataFrame) -> DataFrame:
    """Levels that make an update or a snapshot invalid as a whole."""
    return levels.where("price <= 0 OR qty < 0")


def after_snapshot(snapshot: DataFrame, levels: DataFrame, latched: DataFrame) -> DataFrame:
    """The book of one anchor per symbol: snapshot levels, then the levels of contiguous updates up to the first gap."""
    applied = latched.where(F.col("class") == "contiguous").select("symbol", "arrival")
    first = snapshot.select("symbol", "side", "price", "qty", F.lit(-1).cast("bigint").alias("arrival"), F.lit(0).alias("pos"))
    later = levels.join(applied, ["symbol", "arrival"], "left_semi").select("symbol", "side", "price", "qty", "arrival", F.col("pos").cast("int").alias("pos"))
    return last_writer(first.unionByName(later))


def snapshot_and_book(latched: DataFrame, early: Column) -> DataFrame:
    """symbol, side, price, local, remote: the book after the snapshot of all ``early`` rows and the contiguous updates behind it, and that snapshot.

    Both are one aggregate over latched levels (symbol, side, price, qty,
    arrival, pos, class), where the early ones are stale; 0 is an absent level."""
    order = F.struct("arrival", "pos")
    last = lambda which: F.max_by("qty", F.when(which, order))
    both = latched.groupBy("symbol", "side", "price").agg(last(early).alias("_first"), last(F.col("class") == "contiguous").alias("_later"))
    none = F.lit(0).cast("bigint")
    return both.select("symbol", "side", "price", F.coalesce("_later", "_first", none).alias("local"), F.coalesce("_first", none).alias("remote")).where("local <> 0 OR remote <> 0")


def _side_best() -> list[Column]:
    bid, ask = F.col("side") == BID, F.col("side") == ASK
    price = F.col("price")
    return [
        F.max(F.when(bid, price)).alias("bid_price"),
        F.max_by(F.when(bid, F.col("qty")), F.when(bid, price)).alias("bid_qty"),
        F.min(F.when(ask, price)).alias("ask_price"),
        F.min_by(F.when(ask, F.col("qty")), F.when(ask, price)).alias("ask_qty"),
    ]


def best(book: DataFrame) -> DataFrame:
    """Best bid and ask of each symbol; null where a side is empty."""
    return book.groupBy("symbol").agg(*_side_best())


def top(book: DataFrame, n: int) -> DataFrame:
    """The n levels nearest the touch on each side, with ``rank`` from 1; none for n of 0 or less."""
    nearest = Window.partitionBy("symbol", "side").orderBy(F.when(F.col("side") == BID, -F.col("price")).otherwise(F.col("price")))
    return book.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= n)


def depth(book: DataFrame) -> DataFrame:
    """Level counts of both sides."""
    return book.groupBy("symbol").agg(F.count_if(F.col("side") == BID).alias("bids"), F.count_if(F.col("side") == ASK).alias("asks"))


def view(book: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Best prices, depths and crossed of each symbol; with positions (symbol, live, last_id) also those of symbols without levels."""
    out = book.groupBy("symbol").agg(*_side_best(), F.count_if(F.col("side") == BID).alias("bids"), F.count_if(F.col("side") == ASK).alias("asks"))
    if positions is not None:
        out = positions.join(out, "symbol", "left").withColumns({"bids": F.coalesce("bids", F.lit(0)), "asks": F.coalesce("asks", F.lit(0))})
    return out.withColumn("crossed", F.coalesce(F.col("bid_price") >= F.col("ask_price"), F.lit(False)))


def tracked_view(rows: DataFrame) -> DataFrame:
    """The view of a tracker's books (symbol, live, last_id, side, price, qty; a row without a level for an empty book)."""
    position = [F.first("live").alias("live"), F.first("last_id").alias("last_id")]
    counts = [F.count_if(F.col("side") == BID).alias("bids"), F.count_if(F.col("side") == ASK).alias("asks")]
    return rows.groupBy("symbol").agg(*position, *_side_best(), *counts).withColumn("crossed", F.coalesce(F.col("bid_price") >= F.col("ask_price"), F.lit(False)))


class UnknownSymbol(LookupError):
    """No book of that symbol exists; asking for it creates none."""


def query(book: DataFrame, symbol: str, levels: int = 0) -> tuple[DataFrame, DataFrame]:
    """The view of one symbol and its top levels."""
    own = book.where(F.col("symbol") == symbol)
    if own.isEmpty():
        raise UnknownSymbol(symbol)
    return view(own), top(own, levels)


def bounds(snapshot: DataFrame, zero_filtered: bool = False) -> DataFrame:
    """symbol, bid_floor, ask_ceil known from a snapshot (symbol, side, price, qty, truncated): null is unbounded.

    A book's bounds use all levels, a compared snapshot's only those with a quantity."""
    rows = snapshot.where("qty <> 0") if zero_filtered else snapshot
    cut = rows.where("truncated")
    return cut.groupBy("symbol").agg(F.min(F.when(F.col("side") == BID, F.col("price"))).alias("bid_floor"), F.max(F.when(F.col("side") == ASK, F.col("price"))).alias("ask_ceil"))
