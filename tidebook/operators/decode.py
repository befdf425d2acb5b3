"""Raw frames to typed events, snapshots and instruments.

A frame is read strictly: which of two equal keys counts, what a value of the
wrong type is, and whether JSON ends where it should, no built-in function can
tell.  So frames are parsed in Arrow batches, each once, down to fixed-point
levels.  Errors are values of ``decode_error``, never exceptions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidebook.functions.fixed import LARGEST, OVERFLOW, SYNTAX, TOO_MANY_DECIMALS
from tidebook.functions.symbols import normalised_symbol, size_decimals
from tidebook.workers import reachable

TRADE, DELTA, SNAPSHOT = "trade", "delta", "snapshot"
KINDS = {"aggTrade": TRADE, "depthUpdate": DELTA}
MALFORMED, UNKNOWN_TYPE, UNKNOWN_SYMBOL, BAD_LAST_ID = "malformed", "unknown type", "unknown symbol", "bad last id"

#: Types of the fields of each kind. A key that equals none of them but for its case stands for that field.
FIELDS = {
    TRADE: {"e": "string", "s": "string", "E": "long", "p": "string", "q": "string", "m": "boolean", "M": "boolean"},
    DELTA: {"e": "string", "s": "string", "E": "long", "U": "long", "u": "long", "b": "levels", "a": "levels"},
    SNAPSHOT: {"lastUpdateId": "long", "bids": "levels", "asks": "levels"},
}
#: Instruments that a decoder holds at most: what a venue lists.
MOST_INSTRUMENTS = 100_000

LEVELS = "array<struct<price: bigint, qty: bigint>>"
_LEVELS = pa.list_(pa.struct([("price", pa.int64()), ("qty", pa.int64())]))
_SPACE = re.compile(r"[ \t\n\r]*")


class _Malformed(ValueError):
    """The payload is not JSON of the expected types."""


class _Bad(ValueError):
    """A number is refused; the argument is the class of error."""


class _Members(list):
    """The members of a JSON object in their order, equal keys included."""


def _refuse(text: str) -> None:
    raise _Malformed(text)


_JSON = json.JSONDecoder(object_pairs_hook=_Members, parse_constant=_refuse)


@lru_cache(maxsize=1 << 16)
def fixed(text: str, decimals: int) -> int:
    """The fixed-point value of text; see functions.fixed.parse_fixed for the rules."""
    rest = text[1:] if text.startswith("-") else text
    if not rest:
        raise _Bad(SYNTAX)
    whole, _, fraction = rest.partition(".")
    if fraction[decimals:].strip("0"):
        raise _Bad(TOO_MANY_DECIMALS)
    digits = (whole or "0") + fraction[:decimals].ljust(decimals, "0")
    if not (digits.isascii() and digits.isdigit()):
        raise _Bad(SYNTAX)
    digits = digits.lstrip("0")
    value = int(digits or "0") if len(digits) < 20 else LARGEST + 2
    value = -value if text.startswith("-") else value
    if not -LARGEST - 1 <= value <= LARGEST:
        raise _Bad(OVERFLOW)
    return value


def _members(text: str, at: int = 0, outer: bool = True) -> tuple[_Members, bool]:
    """The members of a payload, as far as they can be read and with keys as they are written, and whether it is whole.

    A frame's member ``data``, where there is one, is its payload, and what
    follows it is not looked at; else the frame is, and nothing may follow."""
    out, at = _Members(), _SPACE.match(text, at).end()
    if text[at : at + 1] != "{":
        return out, False
    at = _SPACE.match(text, at + 1).end()
    whole = text[at : at + 1] == "}"
    try:
        while not whole:
            if text[at : at + 1] != '"':
                return out, False
            _, end = scanstring(text, at + 1)
            key = text[at + 1 : end - 1]
            at = _SPACE.match(text, end).end()
            if text[at : at + 1] != ":":
                return out, False
            first = _SPACE.match(text, at + 1).end()
            if outer and key == "data":
                return _members(text, first, False)
            value, at = _JSON.raw_decode(text, first)
            out.append((key, None if key == "e" and "\\" in text[first:at] else value))
            at = _SPACE.match(text, at).end()
            whole = text[at : at + 1] == "}"
            if not whole:
                if text[at : at + 1] != ",":
                    return out, False
                at = _SPACE.match(text, at + 1).end()
    except (ValueError, RecursionError):
        return out, False
    return out, not outer or _SPACE.match(text, at + 1).end() == len(text)


def _payload(text: str) -> tuple[_Members, bool]:
    """As _members; most frames are sound and are read in one go."""
    if "\\" in text:
        return _members(text)
    try:
        found = _JSON.decode(text)
    except (ValueError, RecursionError):
        return _members(text)
    if isinstance(found, _Members):
        found = next((value for key, value in found if key == "data"), found)
    return (found, True) if isinstance(found, _Members) else (_Members(), False)


def _value(kind: str, value):
    """value as a field of that kind; null is None."""
    if value is None:
        return None
    if kind == "string" and isinstance(value, str) or kind == "boolean" and isinstance(value, bool):
        return value
    if kind == "long" and type(value) is int and -LARGEST - 1 <= value <= LARGEST:
        return value
    if kind == "levels" and type(value) is list:
        return [_pair(x) for x in value]
    raise _Malformed(kind)


def _pair(level) -> tuple[str, str]:
    """Price and quantity of a level; what is missing or null is empty."""
    if level is None:
        return "", ""
    if type(level) is not list:
        raise _Malformed("level")
    two = ["" if x is None else x for x in level[:2]] + [""] * (2 - len(level))
    if not (isinstance(two[0], str) and isinstance(two[1], str)):
        raise _Malformed("level")
    return two[0], two[1]


def _read(members: _Members, fields: dict[str, str], folded: dict[str, str]) -> dict:
    """The fields of a payload; of equal keys the last one that is not null holds, and each must be of the right type."""
    out: dict = {}
    for key, value in members:
        name = key if key in fields else folded.get(key.lower())
        if name is not None:
            value = _value(fields[name], value)
            if value is not None or fields[name] == "levels":
                out[name] = value
    return out


#: Fields by their lower-case names; of two the one that comes first.
_FOLDED = {kind: {name.lower(): name for name in reversed(fields)} for kind, fields in FIELDS.items()}


def _levels(pairs: list[tuple[str, str]] | None, price_decimals: int, qty_decimals: int) -> list[tuple[int, int]]:
    return [(fixed(p, price_decimals), fixed(q, qty_decimals)) for p, q in pairs or ()]


def _nanos(millis: int) -> int:
    """Milliseconds to nanoseconds, in 64 bits."""
    return (millis * 1_000_000 + (1 << 63)) % (1 << 64) - (1 << 63)


_EVENT = ("kind", "symbol", "exchange_time", "is_buy", "first_id", "last_id", "price", "qty", "bids", "asks", "decode_error")
_EVENT_DDL = f"kind string, symbol string, exchange_time bigint, is_buy boolean, first_id bigint, last_id bigint, price bigint, qty bigint, bids {LEVELS}, asks {LEVELS}, decode_error string"
_EVENT_ARROW = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), _LEVELS, _LEVELS, pa.string()]


def _refused(error: str) -> tuple:
    return (*[None] * (len(_EVENT) - 1), error)


def event_of(text: str | None, instruments: dict[str, tuple[str, int, int]]) -> tuple:
    """The values of _EVENT for one frame."""
    members, valid = _payload(text or "")
    first = next((value for key, value in members if key == "e"), None)
    kind = KINDS.get(first) if isinstance(first, str) else None
    if kind is None:
        return _refused(UNKNOWN_TYPE)
    if not valid:
        return _refused(MALFORMED)
    try:
        x = _read(members, FIELDS[kind], _FOLDED[kind])
    except _Malformed:
        return _refused(MALFORMED)
    known = instruments.get(x.get("s", ""))
    if known is None:
        return _refused(UNKNOWN_SYMBOL)
    symbol, price_decimals, qty_decimals = known
    time = _nanos(x.get("E", 0))
    try:
        if kind == TRADE:
            price, qty = fixed(x.get("p", ""), price_decimals), fixed(x.get("q", ""), qty_decimals)
            return kind, symbol, time, not x.get("m", False), None, None, price, qty, None, None, None
        return kind, symbol, time, None, x.get("U", 0), x.get("u", 0), None, None, _levels(x.get("b"), price_decimals, qty_decimals), _levels(x.get("a"), price_decimals, qty_decimals), None
    except _Bad as e:
        return _refused(str(e))


def _level_array(rows: list) -> pa.Array:
    """Lists of (price, qty), or None, as Arrow."""
    at, total = [], 0
    for r in rows:
        at.append(None if r is None else total)
        total += len(r or ())
    flat = [x for r in rows if r for x in r]
    values = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in (0, 1)], ["price", "qty"])
    return pa.ListArray.from_arrays(pa.array([*at, total], pa.int32()), values)


def _arrays(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return [_level_array(list(c)) if t == _LEVELS else pa.array(c, t) for c, t in zip(columns, types, strict=True)]


def decode(frames: DataFrame, instruments: DataFrame) -> DataFrame:
    """frames (data, received_at, and any other columns) with kind, symbol, exchange_time, the fields of the kind, and decode_error.

    One bad level refuses the whole frame.  A missing or null number is 0, a
    missing maker flag false.  What precedes a payload in its envelope must be
    JSON.  instruments (raw, symbol, price_decimals, qty_decimals) is a small
    dimension that every task holds; more than MOST_INSTRUMENTS are refused.
    Rows pass through one for one; other columns of an added name are replaced."""
    reachable(frames.sparkSession)
    rows = instruments.select("raw", "symbol", "price_decimals", "qty_decimals").where("raw IS NOT NULL AND price_decimals IS NOT NULL AND qty_decimals IS NOT NULL").limit(MOST_INSTRUMENTS + 1).collect()
    if len(rows) > MOST_INSTRUMENTS:
        raise ValueError(f"more than {MOST_INSTRUMENTS} instruments")
    known = frames.sparkSession.sparkContext.broadcast({r["raw"]: (r["symbol"], r["price_decimals"], r["qty_decimals"]) for r in rows})
    carried = frames.select(*[F.col(c).cast("string").alias(c) if c == "data" else F.col(c) for c in frames.columns if c not in _EVENT])
    data, names = carried.columns.index("data"), [*carried.columns, *_EVENT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        for batch in batches:
            found = [event_of(text, held) for text in batch.column(data).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_arrays(found, _EVENT_ARROW)], names)

    schema = StructType(list(carried.schema))
    for part in StructType.fromDDL(_EVENT_DDL):
        schema.add(part)
    return carried.mapInArrow(run, schema)


def depth_of(body: str | None, limit: int | None, price_decimals: int | None, qty_decimals: int | None) -> tuple:
    """last_id, bids, asks, truncated and error of one snapshot body."""
    if price_decimals is None or qty_decimals is None:
        return None, None, None, None, UNKNOWN_SYMBOL
    try:
        members = _JSON.decode(body or "")
        x = _read(members if isinstance(members, _Members) else _refuse("object"), FIELDS[SNAPSHOT], _FOLDED[SNAPSHOT])
    except (ValueError, RecursionError):
        return None, None, None, None, MALFORMED
    if x.get("lastUpdateId", 0) <= 0:
        return None, None, None, None, BAD_LAST_ID
    try:
        bids, asks = (_levels(x.get(side), price_decimals, qty_decimals) for side in ("bids", "asks"))
    except _Bad as e:
        return None, None, None, None, str(e)
    most = limit or 0
    return x["lastUpdateId"], bids, asks, most > 0 and (len(bids) >= most or len(asks) >= most), None


def parse_depth(bodies: DataFrame, instruments: DataFrame) -> DataFrame:
    """Snapshots from bodies (symbol, body, limit): symbol, last_id, bids, asks, truncated, parse_error.

    A position of 0 or less, or missing, is an error; so is any bad level, and
    any value of a wrong type.  Where there is an error the rest is null."""
    reachable(bodies.sparkSession)
    rows = bodies.join(instruments.select("symbol", "price_decimals", "qty_decimals"), "symbol", "left").select("symbol", "body", F.col("limit").cast("int"), "price_decimals", "qty_decimals")
    types = [pa.int64(), _LEVELS, _LEVELS, pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [depth_of(*values) for values in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_arrays(found, types)], ["symbol", "last_id", "bids", "asks", "truncated", "parse_error"])

    return rows.mapInArrow(run, f"symbol string, last_id bigint, bids {LEVELS}, asks {LEVELS}, truncated boolean, parse_error string")


def parse_instruments(bodies: DataFrame) -> DataFrame:
    """Instruments from metadata bodies (body): raw, symbol, price_decimals, qty_decimals, parse_error; only symbols that trade.

    Of several filters of a type the last holds; a missing one is an error."""
    info = F.from_json("body", "symbols array<struct<symbol: string, status: string, baseAsset: string, quoteAsset: string, filters: array<struct<filterType: string, tickSize: string, stepSize: string>>>>")
    rows = bodies.select(F.inline(info["symbols"])).where("status = 'TRADING'")
    last = lambda kind, field: F.try_element_at(F.filter("filters", lambda f: f["filterType"] == kind), F.lit(-1))[field]
    rows = rows.withColumns({"_tick": F.nullif(last("PRICE_FILTER", "tickSize"), F.lit("")), "_step": F.nullif(last("LOT_SIZE", "stepSize"), F.lit(""))})
    error = F.when(F.col("_tick").isNull(), "missing price filter").when(F.col("_step").isNull(), "missing lot size")
    return rows.select(F.col("symbol").alias("raw"), normalised_symbol(F.col("baseAsset"), F.col("quoteAsset")).alias("symbol"), size_decimals(F.col("_tick")).alias("price_decimals"), size_decimals(F.col("_step")).alias("qty_decimals"), error.alias("parse_error"))


def level_rows(deltas: DataFrame) -> DataFrame:
    """symbol, arrival, side, price, qty, pos: a row per level, in the order in which an update applies them."""
    sides = [deltas.select("symbol", "arrival", F.lit(side).alias("side"), F.posexplode(column).alias("pos", "x")) for side, column in (("B", "bids"), ("A", "asks"))]
    return sides[0].unionByName(sides[1]).select("symbol", "arrival", "side", F.col("x.price").alias("price"), F.col("x.qty").alias("qty"), "pos")
