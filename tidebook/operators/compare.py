"""Comparison of a maintained book with an independent snapshot, over the prices both know."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.book import duplicate_prices


class Refused(ValueError):
    """The two sides cannot be compared."""


def refuse_duplicates(snapshot: DataFrame) -> None:
    """A snapshot that holds a price of a side more than once, among levels with a quantity, is no book."""
    found = duplicate_prices(snapshot).first()
    if found is not None:
        raise Refused(f"{found['symbol']}: price {found['price']} stands {found['copies']} times in the snapshot")


def refuse_strangers(local: DataFrame, remote: DataFrame) -> None:
    """Snapshots of symbols of which there is no book are not compared with others."""
    found = remote.join(local.select("symbol").distinct(), "symbol", "left_anti").select("symbol").first()
    if found is not None:
        raise Refused(f"there is no book of {found['symbol']}")


def paired(local: DataFrame, remote: DataFrame) -> DataFrame:
    """symbol, side, price, local, remote: every price of either book (symbol, side, price, qty); an absent level has quantity 0."""
    return (
        local.select("symbol", "side", "price", F.col("qty").alias("local"))
        .join(remote.where("qty <> 0").select("symbol", "side", "price", F.col("qty").alias("remote")), ["symbol", "side", "price"], "full_outer")
        .withColumns({"local": F.coalesce("local", F.lit(0).cast("bigint")), "remote": F.coalesce("remote", F.lit(0).cast("bigint"))})
    )


def bounded(both: DataFrame, local_bounds: DataFrame | None = None, remote_bounds: DataFrame | None = None) -> DataFrame:
    """Those rows of paired books that lie within the bounds (symbol, bid_floor, ask_ceil) of both."""
    for k, b in enumerate((local_bounds, remote_bounds)):
        if b is not None:
            floor, ceil = f"_floor{k}", f"_ceil{k}"
            both = both.join(b.select("symbol", F.col("bid_floor").alias(floor), F.col("ask_ceil").alias(ceil)), "symbol", "left")
            low = (F.col("side") == "B") & F.col(floor).isNotNull() & (F.col("price") < F.col(floor))
            high = (F.col("side") == "A") & F.col(ceil).isNotNull() & (F.col("price") > F.col(ceil))
            both = both.where(~(low | high)).drop(floor, ceil)
    return both


def differences(local: DataFrame, remote: DataFrame, local_bounds: DataFrame | None = None, remote_bounds: DataFrame | None = None) -> DataFrame:
    """symbol, side, price, local, remote where the two disagree; an absent level has quantity 0."""
    return differing(bounded(paired(local, remote), local_bounds, remote_bounds))


def differing(both: DataFrame) -> DataFrame:
    return both.where("local <> remote")


def describe(diffs: DataFrame) -> DataFrame:
    """diffs with ``text``, a line for a report."""
    side = F.when(F.col("side") == "B", "bid").otherwise("ask")
    return diffs.withColumn("text", F.format_string("%s %d: local %d, snapshot %d", side, "price", "local", "remote"))


def summary(local: DataFrame, remote: DataFrame, positions: DataFrame, local_bounds: DataFrame | None = None, remote_bounds: DataFrame | None = None) -> DataFrame:
    """A row per symbol of positions (symbol, live, local_id, snapshot_id): prices compared, differences, id skew and verdict.

    skipped: the book is not live. ok: no difference. skewed: differences at
    different update ids, as expected. diverged: differences at the same id."""
    return verdicts(bounded(paired(local, remote), local_bounds, remote_bounds), positions)


def report(diffs: DataFrame, most: int = 10) -> DataFrame:
    """symbol, text: the differences of each symbol as one text, the ``most`` first in order of side and price, and how many more there are."""
    line = describe(diffs).groupBy("symbol", "side", "price").agg(F.first("text").alias("text"))
    first = Window.partitionBy("symbol").orderBy(F.when(F.col("side") == "B", 0).otherwise(1), F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")))
    rows = line.withColumn("n", F.row_number().over(first))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "text")))), lambda x: x["text"]), "\n")
    more = F.greatest(F.count("*") - most, F.lit(0))
    return rows.groupBy("symbol").agg(F.concat(shown, F.when(more > 0, F.format_string("\n%d more", more)).otherwise("")).alias("text"))


def verdicts(both: DataFrame, positions: DataFrame) -> DataFrame:
    """summary() of paired books."""
    seen = both.groupBy("symbol").agg(F.count("*").alias("compared"), F.count_if(F.col("local") != F.col("remote")).alias("diffs"))
    out = positions.join(seen, "symbol", "left").withColumns({"compared": F.coalesce("compared", F.lit(0)), "diffs": F.coalesce("diffs", F.lit(0))})
    out = out.withColumn("id_skew", F.col("snapshot_id") - F.col("local_id"))
    verdict = F.when(~F.col("live"), "skipped").when(F.col("diffs") == 0, "ok").when(F.col("id_skew") != 0, "skewed").otherwise("diverged")
    return out.withColumn("verdict", verdict)
