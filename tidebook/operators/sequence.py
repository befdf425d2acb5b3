"""Sequencing of incremental updates by their inclusive id ranges.

With one anchor per symbol the sequencer has a closed form: up to the first gap
the position is the larger of the anchor and the largest last_id seen so far.
The running maximum is computed in blocks of arrivals, so that one symbol with
most of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE, CONTIGUOUS, GAPPED, BUFFERED = "stale", "contiguous", "gapped", "buffered"


def running_position(deltas: DataFrame, anchor: Column | None = None, block: int = 1 << 16) -> DataFrame:
    """deltas (symbol, arrival, first_id, last_id, ..) with ``position``: the largest last_id before each row, at least the anchor."""
    anchor = F.lit(0).cast("bigint") if anchor is None else anchor
    rows = deltas.withColumn("_block", F.floor(F.col("arrival") / block))
    tops = rows.groupBy("symbol", "_block").agg(F.max("last_id").alias("_top"))
    earlier = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select("symbol", "_block", F.max("_top").over(earlier).alias("_before"))
    inside = Window.partitionBy("symbol", "_block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    position = F.greatest(anchor, F.col("_before"), F.max("last_id").over(inside))
    return rows.join(before, ["symbol", "_block"]).withColumn("position", position).drop("_block", "_before")


def numbered(rows: DataFrame, name: str = "rn", block: int = 1 << 16) -> DataFrame:
    """rows (symbol, arrival, ..) with the number of each in its symbol, from 1, in order of arrival."""
    cut = rows.withColumn("_block", F.floor(F.col("arrival") / block))
    earlier = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("symbol", "_block").agg(F.count("*").alias("_n"))
    before = sizes.select("symbol", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("symbol", "_block").orderBy("arrival"))
    return cut.join(before, ["symbol", "_block"]).withColumn(name, (F.col("_before") + inside).cast("bigint")).drop("_block", "_before")


def previous(rows: DataFrame, column: str, name: str, block: int = 1 << 16) -> DataFrame:
    """rows (symbol, arrival, ..) with the value that column, which holds no nulls, has in the row of the symbol before; null in its first."""
    cut = rows.withColumn("_block", F.floor(F.col("arrival") / block))
    lasts = cut.groupBy("symbol", "_block").agg(F.max_by(column, "arrival").alias("_last"))
    before = lasts.select("symbol", "_block", F.lag("_last").over(Window.partitionBy("symbol").orderBy("_block")).alias("_before"))
    inside = F.lag(column).over(Window.partitionBy("symbol", "_block").orderBy("arrival"))
    return cut.join(before, ["symbol", "_block"]).withColumn(name, F.coalesce(inside, "_before")).drop("_block", "_before")


def classify(deltas: DataFrame, anchor: Column | None = None, block: int = 1 << 16) -> DataFrame:
    """deltas with ``class``: what each update is against the running position, without latching."""
    placed = running_position(deltas, anchor, block)
    kind = F.when(F.col("last_id") <= F.col("position"), STALE).when(F.col("first_id") <= F.col("position") + 1, CONTIGUOUS).otherwise(GAPPED)
    return placed.withColumn("class", kind)


def first_gaps(classified: DataFrame) -> DataFrame:
    """symbol, gap_at: the arrival of the first gap of each symbol that has one."""
    return classified.where(F.col("class") == GAPPED).groupBy("symbol").agg(F.min("arrival").alias("gap_at"))


def latch(classified: DataFrame) -> DataFrame:
    """``class`` as a tracker sees it: everything after a symbol's first gap is buffered until a resync."""
    gaps = first_gaps(classified)
    kind = F.when(F.col("gap_at").isNull() | (F.col("arrival") <= F.col("gap_at")), F.col("class")).otherwise(F.lit(BUFFERED))
    return classified.join(gaps, "symbol", "left").withColumn("class", kind)
