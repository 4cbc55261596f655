"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Tasks that the edges of one node are dealt to, at most.
SALTS = 64


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with m, the least v of their u. A hub's edges are dealt by
    (u, salt of v): minima go up by salt and come down by salt. Merged, not
    broadcast: a hashed table of several keys takes a page of 64 MB on every
    executor, which would add up over the rounds."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    by_salt = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = by_salt.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
    return salted.join(least.select("u", "m", F.explode("salts").alias("salt")).hint("merge"), ["u", "salt"])


def components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """node, root (least node of its component) of every node of ``edges`` (u, v).

    Loops and repeated edges are harmless; nodes without an edge to another are
    not returned. Every round is written to the shared folder and the one before
    is removed. The number of rounds grows with the logarithm of a component's
    size; the edges of a hub are dealt to up to ``SALTS`` tasks.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges, name)
    was = _mark(edges)
    for _ in range(most):
        if not was[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _with_least(both).withColumn("m", F.least("u", "m"))
        large = cut(least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name, instead_of=edges)
        # of a node's lesser neighbours the least takes its place among the others
        low = _with_least(large)
        moved = low.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name, instead_of=large)
        now = _mark(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
