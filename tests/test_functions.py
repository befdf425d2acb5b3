from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import symbols as S
from tidebook.functions.fixed import OVERFLOW, SYNTAX, TOO_MANY_DECIMALS, format_fixed, notional, parse_fixed
from tidebook.operators.decode import _Bad, fixed

LARGEST, SMALLEST = 2**63 - 1, -(2**63)

def _model(text: str | None, decimals: int):
    """What parse_fixed must give, from its stated rules: a value, a class of error, or None."""
    if text is None:
        return None
    negative, rest = text[:1] == "-", text[1:] if text[:1] == "-" else text
    whole, fraction = (rest.split(".", 1) + [""])[:2]
    if rest == "":
        return SYNTAX
    if any(c != "0" for c in fraction[decimals:]):
        return TOO_MANY_DECIMALS
    digits = (whole or "0") + (fraction + "0" * decimals)[:decimals]
    if not digits or any(c not in "0123456789" for c in digits):
        return SYNTAX
    value = sum(int(c) * 10**k for k, c in enumerate(reversed(digits))) * (-1 if negative else 1)
    return value if SMALLEST <= value <= LARGEST else OVERFLOW


def _texts(rng: random.Random) -> list[str | None]:
    """Numbers of all shapes, around the ends of 64 bits, and the same with a character spoilt."""
    out: list[str | None] = [None, "", "-", ".", "-.", "\u0663", "\u00b2"]
    for edge in (LARGEST, SMALLEST):
        for near in range(edge - 3, edge + 4):
            for point in (0, 1, 5, 18):
                s = str(abs(near)).zfill(point + 1)
                out.append("-" * (near < 0) + s[: len(s) - point] + "." * (point > 0) + s[len(s) - point :])
    for _ in range(300):
        sign, whole, fraction = rng.choice(["", "", "-"]), "".join(rng.choices("0123456789", k=rng.choice([0, 1, 3, 12, 25]))), "".join(rng.choices("0012", k=rng.choice([0, 1, 2, 8]))) + "0" * rng.randrange(4)
        s = sign + whole + rng.choice(["", "." + fraction])
        out.append(s)
        at = rng.randrange(len(s) + 1)
        out.append(s[:at] + rng.choice("+- eE.x\n_,") + s[at:])
    return out


def test_parse_fixed_equals_its_rules(spark):
    cases = [(s, d) for s in _texts(random.Random(7)) for d in (0, 1, 2, 5, 18)]
    rows = spark.createDataFrame([(k, s, d) for k, (s, d) in enumerate(cases)], "k int, s string, d int")
    got = {r["k"]: r["p"] for r in rows.select("k", parse_fixed("s", F.col("d")).alias("p")).collect()}
    seen = set()
    for k, (s, d) in enumerate(cases):
        want = _model(s, d)
        seen.add(want if isinstance(want, str) else type(want))
        assert (got[k]["value"] if got[k]["error"] is None else got[k]["error"]) == want, (s, d)
        if s is not None:  # the decoder's own parser
            try:
                assert fixed(s, d) == want, (s, d)
            except _Bad as e:
                assert str(e) == want, (s, d)
    assert seen == {SYNTAX, TOO_MANY_DECIMALS, OVERFLOW, int, type(None)}


def _format(v: int, d: int) -> str:
    digits = str(abs(v)).rjust(d + 1, "0")
    return str(v) if d <= 0 else ("-" if v < 0 else "") + digits[:-d] + "." + digits[-d:]


def test_format_fixed_and_round_trip(spark):
    rng = random.Random(4)
    cases = [(v, d) for v in (0, 5, -5, 123456, LARGEST, SMALLEST, *(rng.randint(SMALLEST, LARGEST) for _ in range(50))) for d in (-1, 0, 1, 2, 8, 18, 25)]
    rows = spark.createDataFrame(cases, "v bigint, d int").withColumn("s", format_fixed("v", F.col("d")))
    for r in rows.withColumn("p", parse_fixed("s", F.greatest(F.col("d"), F.lit(0)))).collect():
        assert r["s"] == _format(r["v"], r["d"])
        assert r["p"]["value"] == r["v"]


def test_notional(spark):
    cases = [(3, 4, 12), (0, 5, 0), (-1, 5, None), (5, -1, None), (2**32, 2**31, None), (2**31, 2**31, 2**62), (LARGEST, 1, LARGEST), (LARGEST, 2, None)]
    got = spark.createDataFrame(cases, "p bigint, q bigint, want bigint").withColumn("got", notional("p", "q")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_fnv_shard_equals_reference_arithmetic(spark):
    texts = ["", "OAK-ELM", "FIR-ELM", "ash", "é-ü", "X" * 50]

    def fnv(s: str) -> int:
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    for n in (1, 4, 7, 1000):
        assert {r["s"]: r["k"] for r in rows.select("s", S.fnv1a_shard(F.col("s"), n).alias("k")).collect()} == {t: fnv(t) % n for t in texts}


@pytest.mark.parametrize(("text", "want"), [("\u0020oak-elm ", "OAK-ELM"), ("oak", None), ("-elm", None), ("oak-", None), ("oak-elm-fir", None), ("", None)])
def test_valid_symbol(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(S.valid_symbol(F.col("s"))).first()[0] == want


def test_size_decimals_and_times(spark):
    cases = [("0.01000000", 2), ("1.00000000", 0), ("1", 0), ("0.00001", 5), ("10.", 0), (None, None)]
    got = spark.createDataFrame(cases, "s string, want int").withColumn("got", S.size_decimals(F.col("s"))).collect()
    assert all(r["got"] == r["want"] for r in got)
    row = spark.sql("SELECT 0L AS zero, 1700000000123L AS ms").select(S.nanos(F.col("ms")), S.nanos(F.col("zero")), S.known_time(S.nanos(F.col("zero")))).first()
    assert tuple(row) == (1700000000123000000, 0, None)


def test_names_and_the_symbol_of_an_event(spark):
    rows = spark.createDataFrame([("B", True, "delta", None, "X-Y"), ("A", False, "trade", "P-Q", None), ("?", None, "odd", None, None)], "side string, is_buy boolean, kind string, a string, b string")
    got = rows.select(S.side_name(F.col("side")), S.trade_side(F.col("is_buy")), S.kind_name(F.col("kind")), S.any_symbol(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("bid", "buy", "book_delta", "X-Y"), ("ask", "sell", "trade", "P-Q"), ("unknown", "unknown", "unknown", None)]
