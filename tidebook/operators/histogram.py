"""Histograms over fixed bounds, in nanoseconds, with interpolated quantiles and text exposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MS, _US = 1_000_000, 1_000
#: Bounds of the three latency families, in nanoseconds.
TICK_TO_BOOK = tuple(x * _MS for x in (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000))
DECODE = tuple(x * _US for x in (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 5000))
RESYNC = tuple(x * _MS for x in (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000))


def normalised_bounds(bounds: Sequence[int]) -> list[int]:
    out = sorted(set(bounds))
    if not out:
        raise ValueError("a histogram needs at least one bound")
    return out


def bucket_of(value: Column, bounds: Sequence[int]) -> Column:
    """The number of the first bound that is not below value; their count for the last, unbounded bucket."""
    b = normalised_bounds(bounds)
    out = F.lit(len(b))
    for i in reversed(range(len(b))):
        out = F.when(value <= b[i], F.lit(i)).otherwise(out)
    return out.cast("int")


def buckets(values: DataFrame, column: str, bounds: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, bucket, le (null for the last), n, cumulative: a row per bucket, empty ones too; negative values are left out."""
    b = normalised_bounds(bounds)
    spark = values.sparkSession
    seen = values.where(F.col(column) >= 0).groupBy(*keys, bucket_of(F.col(column), b).alias("bucket")).agg(F.count("*").alias("n"))
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(x).cast("bigint").alias("le")) for i, x in enumerate([*b, None])]))
    frame = (values.select(*keys).distinct() if keys else spark.range(1)).select(*keys, each)
    full = frame.join(seen, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("cumulative", F.sum("n").over(upto))


def totals(values: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, total, mean (whole nanoseconds, 0 for none) of the values that are not negative, and how many are."""
    good = F.when(F.col(column) >= 0, F.col(column))
    out = values.groupBy(*keys).agg(F.count(good).alias("n"), F.coalesce(F.sum(good), F.lit(0)).cast("bigint").alias("total"), F.count_if(F.col(column) < 0).alias("negative"))
    return out.withColumn("mean", F.when(F.col("n") > 0, F.expr("total div n")).otherwise(F.lit(0).cast("bigint")))


def _quantile(q: float) -> Column:
    """The value at a share of rows (seen: a sorted array of bucket, le, n, cumulative; all: their number; largest: the largest bound)."""
    q = min(max(q, 0.0), 1.0)
    at = F.get(F.filter("seen", lambda x: (x["cumulative"] >= F.lit(q) * F.col("all")) | x["le"].isNull()), 0)
    lower = F.coalesce(F.get("seen", at["bucket"] - 1)["le"], F.lit(0).cast("bigint"))
    share = (F.lit(q) * F.col("all") - (at["cumulative"] - at["n"])) / at["n"]
    inside = lower + F.floor((at["le"] - lower) * share).cast("bigint")
    return F.when(F.col("all") == 0, F.lit(0).cast("bigint")).when(at["le"].isNull(), F.col("largest")).when(at["n"] == 0, at["le"]).otherwise(inside)


def quantiles(hist: DataFrame, shares: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """keys and a column for each named share: linear interpolation inside the bucket that reaches it, cut to whole nanoseconds.

    A share is held between 0 and 1; nothing observed gives 0 and the last
    bucket the largest bound.  An empty bucket that is reached gives its bound.
    All shares come from one aggregate."""
    seen = hist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "le", "n", "cumulative"))).alias("seen"), F.sum("n").alias("all"), F.max("le").alias("largest"))
    return seen.select(*keys, *[_quantile(q).alias(name) for name, q in shares.items()])


def quantile(hist: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, value: one share of quantiles()."""
    return quantiles(hist, {"value": q}, keys)


def summary(values: DataFrame, column: str, bounds: Sequence[int], shares: dict[str, float]) -> DataFrame:
    """One row: n, mean, and a quantile for each named share, in one pass."""
    b = normalised_bounds(bounds)
    each = values.where(F.col(column) >= 0).groupBy(bucket_of(F.col(column), b).alias("bucket")).agg(F.count("*").alias("n"), F.sum(column).alias("total"))
    found = F.collect_list(F.struct("bucket", "n")).alias("found")
    rows = each.agg(found, F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"))
    le = F.array(*[F.lit(x).cast("bigint") for x in [*b, None]])
    upto = lambda i: F.aggregate(F.filter("found", lambda x: x["bucket"] <= i), F.lit(0).cast("bigint"), lambda t, x: t + x["n"])
    own = lambda i: F.aggregate(F.filter("found", lambda x: x["bucket"] == i), F.lit(0).cast("bigint"), lambda t, x: t + x["n"])
    seen = F.transform(F.sequence(F.lit(0), F.lit(len(b))), lambda i: F.struct(i.alias("bucket"), F.get(le, i).alias("le"), own(i).alias("n"), upto(i).alias("cumulative")))
    rows = rows.withColumns({"seen": seen, "largest": F.lit(b[-1] if b else None).cast("bigint")})
    mean = F.when(F.col("all") > 0, F.expr("total div `all`")).otherwise(F.lit(0).cast("bigint"))
    return rows.select(F.col("all").alias("n"), mean.alias("mean"), *[_quantile(q).alias(name) for name, q in shares.items()])


def seconds_label(ns: int) -> str:
    """A bound in seconds, as the shortest decimal that is that number."""
    seconds = ns / 1e9
    text = f"{int(seconds)}" if seconds.is_integer() and abs(seconds) < 1e21 else repr(seconds)
    return text


def rounded(value: float) -> str:
    """A number with one decimal, for reports."""
    return f"{value:.1f}"


def exposition(name: str, help_: str, hist: DataFrame, total: DataFrame, labels: str = "") -> str:
    """Text exposition of one histogram: cumulative buckets, sum in seconds, count, and negatives (left out when labelled and none)."""
    rows, t = hist.orderBy("bucket").collect(), total.first()
    comma, braces = ("," if labels else ""), (f"{{{labels}}}" if labels else "")
    lines = [f"# HELP {name} {help_}", f"# TYPE {name} histogram"]
    lines += [f'{name}_bucket{{{labels}{comma}le="{"+Inf" if r["le"] is None else seconds_label(r["le"])}"}} {r["cumulative"]}' for r in rows]
    lines += [f"{name}_sum{braces} {t['total'] / 1e9:.6g}", f"{name}_count{braces} {t['n']}"]
    if t["negative"] or not labels:
        lines += [f"# HELP {name}_negative_total Observations below zero.", f"# TYPE {name}_negative_total counter", f"{name}_negative_total{braces} {t['negative']}"]
    return "\n".join(lines) + "\n"
