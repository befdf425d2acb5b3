"""Exact fixed-point numbers: a BIGINT of units of 10**-decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 2**63 - 1
SYNTAX, TOO_MANY_DECIMALS, OVERFLOW = "syntax", "too_many_decimals", "overflow"


def _column(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def _inline(value: Column, body: Callable[[Column], Column]) -> Column:
    return body(value)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: lambdas are interpreted, and nothing else shares what they repeat."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_fixed(text: Column | str, decimals: Column | str | int, in_lambda: bool = False) -> Column:
    """STRUCT<value BIGINT, error STRING>: one of the two is null (both for a null text).

    Digits beyond ``decimals`` must be zeros, and that is tested before the
    digits' syntax; missing ones are filled with zeros; either part may be
    empty.  ``in_lambda`` gives a form that is quick inside array functions."""
    s, d = _column(text), _column(decimals)
    let = _bound if in_lambda else _inline

    def signed(rest: Column) -> Column:
        return let(F.instr(rest, F.lit(".")), lambda dot: parts(rest, dot))

    def parts(rest: Column, dot: Column) -> Column:
        whole = F.when(dot > 0, F.substr(rest, F.lit(1), dot - 1)).otherwise(rest)
        fraction = F.when(dot > 0, F.substr(rest, dot + 1)).otherwise(F.lit(""))
        return let(fraction, lambda f: assembled(F.when(whole == "", F.lit("0")).otherwise(whole), f))

    def assembled(whole: Column, fraction: Column) -> Column:
        beyond = (F.length(fraction) > d) & (F.rtrim(F.substr(fraction, d + 1), F.lit("0")) != "")
        return let(F.concat(whole, F.rpad(F.substr(fraction, F.lit(1), d), d, F.lit("0"))), lambda digits: checked(beyond, digits))

    def checked(beyond: Column, digits: Column) -> Column:
        value = F.concat(F.when(F.startswith(s, F.lit("-")), F.lit("-")).otherwise(F.lit("")), digits).try_cast("bigint")
        return let(value, lambda v: result(beyond, digits, v))

    def result(beyond: Column, digits: Column, value: Column) -> Column:
        # Only digits are left when all of them are taken away.
        wrong = (digits == "") | (F.translate(digits, "0123456789", "") != "")
        error = F.when((s == "") | (s == "-"), F.lit(SYNTAX)).when(beyond, F.lit(TOO_MANY_DECIMALS)).when(wrong, F.lit(SYNTAX)).when(s.isNotNull() & value.isNull(), F.lit(OVERFLOW))
        return let(error, lambda e: F.struct(F.when(e.isNull(), value).alias("value"), e.alias("error")))

    return let(F.when(F.startswith(s, F.lit("-")), F.substr(s, F.lit(2))).otherwise(s), signed)


def format_fixed(value: Column | str, decimals: Column | str | int) -> Column:
    """The decimal string of a fixed-point value; exact for the smallest BIGINT too."""
    v, d = _column(value), _column(decimals)
    plain = v.cast("string")
    digits = F.ltrim(plain, F.lit("-"))
    digits = F.when(F.length(digits) <= d, F.lpad(digits, d + 1, F.lit("0"))).otherwise(digits)
    cut = F.length(digits) - d
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(d <= 0, plain).otherwise(F.concat(sign, F.substr(digits, F.lit(1), cut), F.lit("."), F.substr(digits, cut + 1)))


def notional(price: Column | str, qty: Column | str) -> Column:
    """price * qty, or null where it overflows or an input is negative."""
    p, q = _column(price), _column(qty)
    fits = p <= F.call_function("div", F.lit(LARGEST), q)  # asked before multiplying: a failed multiplication costs an exception
    return F.when((p < 0) | (q < 0), F.lit(None).cast("bigint")).when(q == 0, F.lit(0).cast("bigint")).when(fits, p * q)
