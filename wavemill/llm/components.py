"""Connected components of an undirected graph given as a table of edges.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step moves
edges towards the smallest node of a neighbourhood, so the number of rounds grows with
the logarithm of the longest path.  Each round is written to the shared folder; nothing
but the number of edges and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import Scratch


SPLIT = 1_000_000  # edges from which on a node may have too many for one task


def _star(edges: DataFrame, large: bool, written) -> DataFrame:
    """Large star: every larger neighbour of u goes to u's smallest neighbour (or u).
    Small star: every smaller neighbour of u, and u, go to the smallest one.

    The smallest neighbours go through ``written``, which for many edges makes a table of them:
    Spark can split a join of plain tables where a node has very many neighbours."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node.

    ``edges`` has long columns u and v; self-loops and repeated edges do no harm."""
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or mark["n"] == 0:
            break
        before, within = mark, Scratch(scratch.spark)
        written = within.save if mark["n"] > SPLIT else (lambda table: table)
        nxt = scratch.save(_star(written(_star(now, True, written)), False, written).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        within.clear()
        scratch.free(now)
        now = nxt
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
