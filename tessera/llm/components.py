"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations (minimum neighbour, combined map-side) and two
joins; the edges of a round are written to the shared folder, so that neither
lineage nor a lost executor grows the work.  Nothing is collected but one row of
counts a round.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``: hang neighbours below the minimum."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge; ``root`` is the smallest node reachable.

    Self links and repeated edges are ignored; an empty edge table gives no rows.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    e = materialize(e, "edges")
    before = None
    for _ in range(max_rounds):
        e = materialize(_star(_star(e, True), False), "edges")
        # the edge set is a set: count plus two sums of its hashes tell whether it changed
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                          F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            break
        before = now
    else:  # pragma: no cover - a path longer than 2^60 nodes
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
