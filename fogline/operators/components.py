"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m): the edges of each u, with the least of u and its neighbours.

    The least is aggregated (with partial sums in the map tasks) and joined back, so a node with very many
    neighbours is split by the skew handling of the join instead of meeting in one window.
    """
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges with the least node it reaches.

    Alternates large-star and small-star steps; the edge table shrinks to stars in O(log^2 n) rounds. Every round
    is written to the shared folder. Null ends are ignored; self-loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    nodes = edges.where(a.isNotNull() & b.isNotNull()).select(a.alias("u"), b.alias("v"))
    now = stored(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops = nodes.where("u = v").select(F.col("u").alias("node")).distinct()
    mark = None
    for _ in range(rounds):
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (new["n"], new["h"]) == mark or not new["n"]:
            break
        mark = (new["n"], new["h"])
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = _star(large)
        small = own.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "edges")
    roots = now.select(F.col("v").alias("node")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone) if loops.take(1) else found
