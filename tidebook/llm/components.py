"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import _store

#: Nodes with as many edges are joined with their minimum apart from the others.
HEAVY = 256
SALTS = 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(edges: DataFrame, rows: int, key: str, least: DataFrame, most: int) -> DataFrame:
    """edges with m: the smaller of ``key`` and its value in least (a, m).

    Minima are no more than the edges, so few of them are broadcast.  Else the
    minima of nodes with many edges are, of which there are rows / HEAVY at
    most; beyond the bound these edges are dealt by node and a salt.  So no
    node's edges meet in one task."""
    named = least.withColumnRenamed("a", key)
    smaller = F.coalesce("m", F.col(key)).alias("m")
    if rows <= most:
        return edges.join(F.broadcast(named), key, "left").select("a", "b", smaller)
    heavy = edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY).select(key)
    heavy = _store.save(heavy.join(named, key, "left").select(key, smaller), "heavy")
    n = heavy.count()
    if not n:
        return edges.join(named, key, "left").select("a", "b", smaller)
    if n <= most:
        marked = edges.join(F.broadcast(heavy), key, "left")
    else:
        salted = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = edges.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], "left")
    rest = marked.where("m IS NULL").select("a", "b").join(named, key, "left")
    return marked.where("m IS NOT NULL").select("a", "b", "m").unionByName(rest.select("a", "b", smaller))


def connected_components(edges: DataFrame, label: str = "components", most: int = 200_000) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b); component is the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once; an empty table
    gives an empty one.  Each step aggregates minima per node, combined before
    the shuffle; a node with very many edges is split (see _with_least).  At
    most ``most`` pairs of ids are broadcast."""
    now = _store.save(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        label,
    )
    state = _state(now)
    while state[0]:
        # Large star: an edge's larger end moves to the least neighbour of the smaller end.
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        large = _store.save(_with_least(now, state[0], "b", least, most).select("a", F.col("m").alias("b")).distinct(), label)
        # Small star: all smaller neighbours of a node, and the node, move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = _with_least(large, state[0], "a", least, most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = _store.save(least.select("a", F.col("m").alias("b")).unionByName(moved).distinct(), label)
        _store.drop(now, large)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def repeated_ids(rows: DataFrame, classes: list[str], label: str) -> DataFrame:
    """doc_id, several: the ids on more than one row, and whether in more than one class (equal values of the integer columns ``classes``)."""
    kind = F.xxhash64(*classes)
    found = rows.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(kind) < F.max(kind)).alias("several"))
    return _store.save(found.where("n > 1").select("doc_id", "several"), label)


def id_components(links: DataFrame, reps: DataFrame, several: DataFrame | None, label: str) -> DataFrame:
    """Rows (node, component) over ids, where links (a, b) join nodes and reps (node, rep) says which id a node goes by.

    several (doc_id, rep): the classes of ids that stand in more than one; such
    an id joins them.  Where there is none, nodes are ids already."""
    if several is None:
        return connected_components(links, label)
    side = lambda c: reps.select(F.col("node").alias(c), F.col("rep").alias(f"rep_{c}"))
    named = links.join(side("a"), "a").join(side("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    return connected_components(named.unionByName(several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), label)
