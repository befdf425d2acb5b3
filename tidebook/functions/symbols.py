"""Symbols, instruments' decimals, shard numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value of 64-bit FNV-1a: its offset in two halves.
FNV_OFFSET_HIGH, FNV_OFFSET_LOW = 0xCBF29CE4, 0x84222325


def size_decimals(size: Column) -> Column:
    """Significant fractional digits of a tick or step size; 0 without a point."""
    dot = F.instr(size, F.lit("."))
    return F.when(dot > 0, F.length(F.rtrim(F.substr(size, dot + 1), F.lit("0")))).when(size.isNotNull(), F.lit(0)).cast("int")


def normalised_symbol(base: Column, quote: Column) -> Column:
    return F.concat(base, F.lit("-"), quote)


def raw_symbol(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("-"), F.lit(""))


def valid_symbol(text: Column) -> Column:
    """The trimmed upper-case BASE-QUOTE, or null unless it has exactly one dash between two non-empty parts."""
    clean = F.upper(F.trim(text))
    return F.when(clean.rlike(r"\A[^-]+-[^-]+\z"), clean)


def nanos(millis: Column) -> Column:
    """Milliseconds to nanoseconds; 0 stays 0."""
    return millis * F.lit(1_000_000).cast("bigint")


def known_time(ns: Column) -> Column:
    return F.nullif(ns, F.lit(0).cast("bigint"))


def fnv1a_shard(symbol: Column, shards: int) -> Column:
    """64-bit FNV-1a of the symbol's bytes modulo ``shards``.

    The state is two 32-bit halves in BIGINTs, so nothing overflows: the prime
    is 2**40 + 435, and 2**40 only moves the low half into the high one."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    byte = F.transform(F.sequence(F.lit(1), F.octet_length(symbol)), lambda i: F.conv(F.substr(F.hex(symbol), 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    byte = F.when(F.octet_length(symbol) > 0, byte).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(FNV_OFFSET_HIGH).cast("bigint").alias("high"), F.lit(FNV_OFFSET_LOW).cast("bigint").alias("low"))

    def step(state: Column, b: Column) -> Column:
        low = state["low"].bitwiseXOR(b)
        product = low * 435
        high = state["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    return F.aggregate(byte, start, step, lambda s: ((s["high"] % shards * ((1 << 32) % shards) + s["low"] % shards) % shards).cast("int"))


def any_symbol(*symbols: Column) -> Column:
    """The symbol of an event: that of its trade, delta or snapshot."""
    return F.coalesce(*symbols)


def bad_level(levels: Column) -> Column:
    """Whether any level of ARRAY<STRUCT<price, qty>> has a price of 0 or less or a negative quantity."""
    return F.exists(levels, lambda x: (x["price"] <= 0) | (x["qty"] < 0))


def side_name(side: Column) -> Column:
    """The name of a book's side."""
    return F.when(side == "B", "bid").when(side == "A", "ask").otherwise("unknown")


def trade_side(is_buy: Column) -> Column:
    """The side of the one who took a trade."""
    return F.when(is_buy, "buy").when(~is_buy, "sell").otherwise("unknown")


def kind_name(kind: Column) -> Column:
    """The name of an event's kind for logs; anything unknown is named so."""
    return F.when(kind.isin("trade", "snapshot"), kind).when(kind == "delta", "book_delta").otherwise("unknown")
