"""As-of join in arrival order: for each row of one table the latest earlier row of another, per symbol.

Both tables are laid on one line.  Inside blocks of arrivals the latest row is
carried forward by a window; between blocks, the last row of each block is.  A
symbol with most of the rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, columns: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """left (symbol, arrival, ..) with ``columns`` and ``matched_arrival`` of the last row of right before it; null where there is none.

    Of right rows with equal arrival one is taken; a right row at a left row's own arrival does not count."""
    carried = F.struct(F.col("arrival").alias("matched_arrival"), *columns).alias("_r")
    own = [c for c in left.columns if c not in ("symbol", "arrival")]
    a = left.select("symbol", "arrival", F.struct(F.lit(1).alias("_"), *own).alias("_l"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("_r"))
    b = right.select("symbol", "arrival", F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), carried)
    line = a.unionByName(b).withColumn("_block", F.floor(F.col("arrival") / block))
    lasts = line.where("_r IS NOT NULL").groupBy("symbol", "_block").agg(F.max_by("_r", "arrival").alias("_last"))
    blocks = line.select("symbol", "_block").distinct().join(lasts, ["symbol", "_block"], "left")
    earlier = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("symbol", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("symbol", "_block").orderBy("arrival").rangeBetween(Window.unboundedPreceding, -1)
    found = line.withColumn("_near", F.last("_r", ignorenulls=True).over(inside)).where("_l IS NOT NULL").join(before, ["symbol", "_block"], "left")
    match = F.coalesce("_near", "_before")
    return found.select("symbol", "arrival", *[F.col("_l").getField(c).alias(c) for c in own], *[match.getField(c).alias(c) for c in ("matched_arrival", *columns)])
