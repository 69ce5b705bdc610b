"""Graph operators over edge tables (src, dst), without self-loops and in both directions unless said otherwise."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import connected_components


def symmetric(edges: DataFrame) -> DataFrame:
    """Distinct edges in both directions, without self-loops."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def offset_neighbours(cells: DataFrame, x: str, y: str, z: str, cell: str, rise: float) -> DataFrame:
    """Edges between cells in the 8 neighbouring columns whose heights differ by at most rise: an equi-join on columns."""
    ring = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ring))).alias("o")
    near = cells.select(F.col(cell).alias("src"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(z).alias("__z"), steps)
    near = near.select("src", (F.col("__x") + F.col("o.i")).alias(x), (F.col("__y") + F.col("o.j")).alias(y), "__z")
    met = near.join(cells.select(F.col(cell).alias("dst"), x, y, z), [x, y])
    return met.where(F.abs(F.col("__z") - F.col(z)) <= rise).select("src", "dst")


def largest_component(edges: DataFrame) -> DataFrame:
    """(node): the nodes of the component with most nodes, the one with the least node among equals."""
    parts = connected_components(edges)
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.col("n").desc(), "component").limit(1).select("component")
    return parts.join(best, "component", "left_semi").select("node")


def reindexed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with a dense 0-based index in node order, and the edges between them renamed to it.

    Ranks come from counts of range partitions, so no task sorts all nodes; a count for each partition is collected.
    """
    from pyspark.sql import Window

    parts = stored(nodes.repartitionByRange("node").withColumn("__part", F.spark_partition_id()), "ranges")
    local = parts.withColumn("index", F.row_number().over(Window.partitionBy("__part").orderBy("node")) - 1)
    before, total = [], 0
    for r in sorted(parts.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        before += [F.lit(r["__part"]), F.lit(total)]
        total += r["n"]
    offset = F.element_at(F.create_map(*before), F.col("__part")) if before else F.lit(0)
    numbered = local.withColumn("index", (F.col("index") + offset).cast("int")).drop("__part")
    a = numbered.select(F.col("node").alias("src"), F.col("index").alias("src_index"))
    b = numbered.select(F.col("node").alias("dst"), F.col("index").alias("dst_index"))
    return numbered, edges.join(a, "src").join(b, "dst").select(F.col("src_index").alias("src"), F.col("dst_index").alias("dst"))


def hops(edges: DataFrame, most: int) -> DataFrame:
    """(src, dst, hop) for all pairs within `most` hops, hop 0 being the node itself."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    reached = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("hop"))
    front = reached
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to")).distinct()
    for k in range(1, most + 1):
        new = front.join(step, "dst").select("src", F.col("to").alias("dst")).distinct().join(reached, ["src", "dst"], "left_anti")
        front = new.withColumn("hop", F.lit(k))
        reached = reached.unionByName(front)
    return reached


def smooth_two_rings(belief: DataFrame, edges: DataFrame, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> DataFrame:
    """(node, b) -> w0 b + w1 b S + w2 b S S, with S the row-normalised adjacency."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    s = edges.join(degree, "src").select("src", "dst", (1 / F.col("degree")).alias("p"))

    def ring(b: DataFrame) -> DataFrame:
        return b.join(s, b["node"] == s["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("b") * F.col("p")).alias("b"))

    one = ring(belief.select("node", "b"))
    two = ring(one)
    parts = [d.select("node", (F.col("b") * w).alias("b")) for d, w in zip((belief, one, two), weights, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("node").agg(F.sum("b").alias("b"))


def region_edges(edges: DataFrame, regions: DataFrame, least: int = 3, unknown: str = "Unknown") -> DataFrame:
    """(a, b, n): pairs of different known regions joined by `least` directed edges or more. regions: (node, region)."""
    a = regions.select(F.col("node").alias("src"), F.col("region").alias("a"))
    b = regions.select(F.col("node").alias("dst"), F.col("region").alias("b"))
    pairs = edges.join(a, "src").join(b, "dst").where((F.col("a") != F.col("b")) & (F.col("a") != unknown) & (F.col("b") != unknown))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def shortest_paths(edges: DataFrame, most_edges: int = 2_000_000, unreachable: float = 1e5) -> DataFrame:
    """(src, dst, distance) for all pairs of nodes of a map graph with edge lengths (src, dst, length).

    A map has a few thousand cells. Its edges (checked: at most most_edges) go to every task as arrays; each task runs
    Dijkstra's search from its sources.
    """
    few = edges.select("src", "dst", F.col("length").cast("double").alias("length")).limit(most_edges + 1).toArrow()
    if len(few) > most_edges:
        raise ValueError("too many edges for all pairs; restrict the graph first")
    graph: dict[int, list[tuple[int, float]]] = {}
    for s, d, n in zip(few["src"].to_pylist(), few["dst"].to_pylist(), few["length"].to_pylist(), strict=True):
        graph.setdefault(s, []).append((d, n))
        graph.setdefault(d, [])
    nodes = sorted(graph)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                best, queue = {source: 0.0}, [(0.0, source)]
                while queue:
                    d, n = heapq.heappop(queue)
                    if d > best[n]:
                        continue
                    for to, length in graph[n]:
                        if d + length < best.get(to, float("inf")):
                            best[to] = d + length
                            heapq.heappush(queue, (d + length, to))
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array([best.get(n, unreachable) for n in nodes], pa.float64())], names=["src", "dst", "distance"])

    spark = edges.sparkSession
    sources = edges.select(F.col("src").cast("long").alias("src")).union(edges.select(F.col("dst").cast("long"))).distinct()
    return sources.repartition("src").mapInArrow(search, "src long, dst long, distance double") if nodes else spark.createDataFrame([], "src long, dst long, distance double")


def travel_times(distances: DataFrame, traffic: DataFrame, speed: float = 250.0) -> DataFrame:
    """(a, b, seconds): from region a's busiest node to the nearest node of b. traffic: (node, region, n)."""
    busiest = traffic.groupBy("region").agg(F.max_by("node", F.struct("n", -F.col("node"))).alias("src")).select(F.col("region").alias("a"), "src")
    ends = traffic.select(F.col("node").alias("dst"), F.col("region").alias("b")).distinct()
    return distances.join(busiest, "src").join(ends, "dst").groupBy("a", "b").agg((F.min("distance") / speed).alias("seconds"))
