"""Shards of near equal size by sampled splitters. DataFrame functions only.

Keys are hashes of the text, so that equal texts lie together.  Rows are drawn
with a chance in proportion to their size; quantiles of the sampled keys cut
the key space into ranges, and ranges that turn out overfull are cut again by
samples of their own.  Offsets of ranges and positions inside them place every
row on one line of bytes, which is cut into equal shards.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import _store


#: Bits of a key by which its splitters are found: at most_ranges, 32 of them share these.
TOP_BITS = 11


@dataclass(frozen=True)
class Params:
    """shards: count. rows_per_range, least_ranges, most_ranges: how finely keys are cut.

    samples: expected draws per range. overfull: times the mean size, in bytes or
    rows, from which a range is cut again, at most ``rounds`` times. whole: a group of equal
    texts up to this share of a shard, in bytes and (beyond many_rows) in rows, stays in one shard."""

    shards: int = 24
    rows_per_range: int = 50_000
    least_ranges: int = 512
    most_ranges: int = 65_536
    samples: int = 16
    overfull: float = 4.0
    rounds: int = 4
    whole: float = 0.02
    many_rows: int = 1000


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a JSON literal: no Python data source in the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _splitters(sample: list, ranges: int) -> list[tuple[int, int]]:
    """Keys at equal weights: at most ranges - 1 of them."""
    sample = sorted(sample, key=lambda r: (r["h"], r["t"]))
    total, done, out = sum(r["w"] for r in sample), 0.0, []
    for r in sample:
        done += r["w"]
        if done >= total * (len(out) + 1) / ranges and len(out) < ranges - 1 and (not out or out[-1] < (r["h"], r["t"])):
            out.append((r["h"], r["t"]))
    return out


def _drawn(rows: DataFrame, rate: Column, seed: int) -> list:
    """Keys, each drawn with a chance of its size times the rate; a row beyond one draw counts for several."""
    chance = F.col("size") * rate
    picked = rows.where(F.pmod(F.xxhash64("h", "u", F.lit(seed)), F.lit(1 << 30)) < chance * (1 << 30))
    return picked.select("range", "h", "t", F.greatest(chance, F.lit(1.0)).alias("w")).collect()


def _ranged(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows with the number of splitters below their key, found among those that share the key's first bits."""
    tops = 1 << TOP_BITS
    by_top: dict[int, list] = {k: [] for k in range(tops)}
    for h, t in cuts:
        by_top[(h >> (64 - TOP_BITS)) + tops // 2].append({"h": h, "t": t})
    table, base = [], 0
    for top in range(tops):
        table.append({"top": top, "base": base, "cuts": by_top[top]})
        base += len(by_top[top])
    small = _literal(rows.sparkSession, table, "top: int, base: int, cuts: array<struct<h: bigint, t: bigint>>")
    below = F.expr("base + size(filter(cuts, c -> c.h < h OR (c.h = h AND c.t < t)))")
    return rows.join(F.broadcast(small), F.expr(f"CAST(shiftright(h, {64 - TOP_BITS}) AS INT) + {tops // 2}") == F.col("top")).withColumn("range", below).drop("top", "base", "cuts")


def shard_by_bytes(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs.

    A size is the text's bytes and 8; null counts as empty.  Shards follow the
    order of (text hash, id hash) and differ from equal size by no more than
    the row or small group of equal texts at their ends.  Rows of equal keys go
    by doc_id, then by their place.  A very long text is a row of its size, and
    only its size and hashes are moved.  Repeated rows are placed as often as
    they occur, a null doc_id like any other.  Only doc_id
    and text are read; an empty table gives no rows."""
    p = p or Params()
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("u"))
    slim = _store.save(slim, "sizes")
    total, n = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()

    # Groups beyond this share of bytes or of rows are large; there are at most 2 * shards / whole of them.
    share = p.whole / p.shards
    large = slim.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("m")).where((F.col("b") > share * total) | (F.col("m") > max(p.many_rows, share * n))).select("h", F.lit(True).alias("large"))
    large = _literal(spark, [r.asDict() for r in large.collect()], "h: bigint, large: boolean")
    rows = slim.join(F.broadcast(large), "h", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    rows = rows.withColumn("t", F.when(F.col("large"), F.xxhash64("doc_id", "u", F.lit(17))).otherwise(F.lit(0).cast("long")))

    ranges = min(p.most_ranges, max(p.least_ranges, -(-n // p.rows_per_range)))
    cuts = _splitters(_drawn(rows.withColumn("range", F.lit(0)), F.lit(ranges * p.samples / max(total, 1)), 1), ranges)
    for again in range(p.rounds + 1):
        placed = _ranged(rows, cuts)
        sums = {r["range"]: (r["bytes"], r["n"]) for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        # Ranges are overfull in bytes or in rows; each is cut into as many pieces as it holds shares of a range.
        pieces = {k: int(ranges * max(b / total, m / n)) for k, (b, m) in sums.items() if m > 1}
        full = {k: c for k, c in pieces.items() if c >= p.overfull}
        if not full or again == p.rounds:
            break
        own = _literal(spark, [{"range": k, "rate": 2 * p.samples * c / sums[k][0]} for k, c in full.items()], "range: int, rate: double")
        drawn = _drawn(placed.join(F.broadcast(own), "range"), F.col("rate"), 2 + again)
        for k, c in full.items():
            cuts += _splitters([r for r in drawn if r["range"] == k], c + 1)
        cuts = sorted(set(cuts))

    offsets, done_bytes, done_rows = [], 0, 0
    for k in sorted(sums):
        offsets.append({"range": k, "bytes_before": done_bytes, "rows_before": done_rows})
        done_bytes, done_rows = done_bytes + sums[k][0], done_rows + sums[k][1]
    placed = placed.join(F.broadcast(_literal(spark, offsets, "range: int, bytes_before: bigint, rows_before: bigint")), "range")
    order = "PARTITION BY range ORDER BY h, t, doc_id, u"
    placed = placed.withColumns({"seen": F.expr(f"sum(size) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size"), "place": F.expr(f"row_number() OVER ({order})")})
    unit = "PARTITION BY range, h, IF(large, place, 0)"
    placed = placed.withColumn("middle", F.expr(f"2 * (bytes_before + min(seen) OVER ({unit})) + sum(size) OVER ({unit})"))
    shard = F.least(F.lit(p.shards - 1), F.expr(f"CAST((middle * {p.shards}) div {max(2 * total, 1)} AS INT)"))
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("place") - 1).alias("at"))
    placed = _store.save(placed, "placed")
    firsts = _literal(spark, [r.asDict() for r in placed.groupBy("shard").agg(F.min("at").alias("first")).collect()], "shard: int, first: bigint")
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"))


def sharding_digest(docs: DataFrame, p: Params | None = None) -> DataFrame:
    out = shard_by_bytes(docs, p)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
