"""Exact top-k search by inner product with a pivot-distance index.

Index. Pivots are chosen from a bounded sample of the vectors (farthest-first), more of them for more vectors. Every
vector is keyed by its nearest pivot and the distance to it; in that order vectors are cut into annuli of one pivot. An
annulus is known by its pivot, its least and greatest distance and its greatest norm; annuli are so large that there
are at most some ANNULI + pivots of them, and their summary (four numbers each) goes to all tasks.

Search. For a query q and a vector v at distance r from pivot p, the triangle inequality gives |q - v| >= |d(q, p) - r|,
and q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2, so every annulus has an upper bound of its inner products with q. A first
pass expands, for each query, the annulus of the nearest pivot around the query's own distance; its k-th score is a
floor. A second pass expands exactly the annuli whose bound reaches the floor, so no result is lost, whatever the
sample. The last k of all scores are taken with ties to the smaller id.

Queries are a stated set against all rows. Vectors are shuffled once for the index; a query is sent to the annuli it
expands and to no others. Annuli are streamed: rows of a partition are sorted by annulus, its vectors before its queries, and a task
holds one annulus and a batch of queries; an annulus with more than ASKED queries is sent to several tasks, each with a
part of the queries. Equal vectors, however many, are cut into annuli like others.

Defined cases: vectors that are null or empty or hold null or non-finite components take no part; vectors have inner
products with those of the same length only, so each length is searched on its own; a query is compared with every row
but those of its own id; repeated ids are separate candidates, and queries that repeat an id and vector are one query;
with fewer than k candidates all are returned; other columns are not used. Components are scaled and floored to 64-bit
integers first, and scores are exact: doubles below 2**52, 64-bit integers below 2**62, Python's integers beyond.
A component or a score that 64 bits cannot hold is an error, as in the SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Pivots at least and at most; between them, one for every PER_PIVOT vectors.
PIVOTS, MOST_PIVOTS, PER_PIVOT = 24, 512, 20_000
SAMPLE = 4096
#: Rows of an annulus at least; more, where there would be more than so many annuli.
ANNULUS, ANNULI = 2048, 50_000
#: Queries of an annulus that go to one task.
ASKED = 4096
#: Queries multiplied with an annulus at a time.
BATCH = 512
#: Less than every score.
NONE = -(1 << 63)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots of a sample."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from plain differences, which lose nothing for long vectors that lie close together."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def _scores(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The exact inner products of integer rows, as 64-bit integers."""
    longest = np.sqrt((q.astype(np.float64) ** 2).sum(1).max() * (block.astype(np.float64) ** 2).sum(1).max())
    if longest < 2.0**52:
        return (q.astype(np.float64) @ block.T.astype(np.float64)).astype(np.int64)
    if longest < 2.0**62:
        return q @ block.T
    exact = q.astype(object) @ block.T.astype(object)
    if max(map(abs, exact.ravel())) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


def integer_vectors(vectors: DataFrame, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * component) as packed 64-bit integers, of the rows that take part."""
    usable = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            if len(values) and np.abs(values).max() >= 2.0**63:
                raise OverflowError("a scaled component does not fit 64 bits")
            values = values.astype("<i8")
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            rows = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "v"])

    return vectors.where(usable).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>")).mapInArrow(packed, "id long, v binary")


def _indexed(pivots: np.ndarray):
    width = pivots.shape[1] * 8

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array([len(v) == width for v in batch.column(1).to_pylist()], pa.bool_()))
            if not len(batch):
                continue
            x = _matrix(batch.column(1)).astype(np.float64)
            d = _distances(x, pivots)
            near = d.argmin(1)
            norm = (x**2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array(norm)], names=["id", "v", "pivot", "r", "norm"])

    return keyed


def _cut(most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers annuli along rows sorted by pivot and distance."""
        from pyspark import TaskContext

        number, pivot, held = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            out = np.empty(len(batch), np.int64)
            for i, p in enumerate(batch.column("pivot").to_numpy()):
                if p != pivot or held == most:
                    number, pivot, held = number + 1, p, 0
                held += 1
                out[i] = number
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns], names=["annulus", *batch.schema.names])

    return cut


def _wanted(pivots: np.ndarray, rings: dict[str, np.ndarray], first: bool):
    """For queries (id, v, pivot, r, norm, floor) the annuli to expand: the one around the query itself, or all that
    may reach the floor."""
    reach = float((pivots**2).sum(1).max())
    block = max(1, (1 << 22) // max(len(rings["annulus"]), 1))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), block):
                batch = whole.slice(at, block)
                d = _distances(_matrix(batch.column(1)).astype(np.float64), pivots)[:, rings["pivot"]]
                off = np.maximum(np.maximum(rings["lo"] - d, d - rings["hi"]), 0)
                if first:
                    own = rings["pivot"][None, :] == batch.column(2).to_numpy()[:, None]
                    place = np.where(own, off, np.inf).argmin(1)
                    q, a = np.flatnonzero(own.any(1)), place[own.any(1)]
                else:
                    norms = batch.column(4).to_numpy()[:, None] + rings["most"]
                    # rounding errors are far below 1, or below this share of the squares that the distances come from
                    bound = (norms - off * off) / 2 + 1 + 1e-11 * (norms + reach)
                    floor = batch.column(5).to_numpy().astype(np.float64)
                    q, a = np.nonzero(bound >= (floor - 1e-15 * np.abs(floor))[:, None])
                take = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(rings["annulus"][a]), batch.column(0).take(take), batch.column(1).take(take), batch.column(5).take(take)], names=["annulus", "id", "v", "floor"])

    return wanted


def _scored(k: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by annulus and part, vectors (kind 0) before queries (kind 1)."""
        annulus, ids, parts = None, [], []
        block: np.ndarray | None = None

        def answers(qid: np.ndarray, q: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            if block is None:
                block = np.concatenate(parts)
            own = np.concatenate(ids)
            scores = _scores(q, block)
            scores[qid[:, None] == own[None, :]] = NONE
            # the k best with ties to the smaller id: all above the k-th value, then the smallest ids among the equal
            take = min(k, len(own))
            kth = np.partition(scores, len(own) - take, axis=1)[:, len(own) - take] if take else np.full(len(q), NONE)
            hit_q, hit_v = np.nonzero((scores >= np.maximum(kth, floor)[:, None]) & (scores > NONE))
            order = np.lexsort((own[hit_v], -scores[hit_q, hit_v], hit_q))
            hit_q, hit_v = hit_q[order], hit_v[order]
            place = np.arange(len(hit_q)) - np.searchsorted(hit_q, hit_q)
            hit_q, hit_v = hit_q[place < k], hit_v[place < k]
            return pa.RecordBatch.from_arrays([pa.array(qid[hit_q]), pa.array(own[hit_v]), pa.array(scores[hit_q, hit_v])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            at, part, kind, rid = (batch.column(i).to_numpy() for i in range(4))
            floor = batch.column(5).to_numpy()
            matrix = _matrix(batch.column(4)) if len(batch) else np.zeros((0, 0))
            edges = np.flatnonzero((at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip(np.concatenate(([0], edges)), np.append(edges, len(batch)), strict=True):
                if a == b:
                    continue
                if (at[a], part[a]) != annulus:
                    annulus, ids, parts, block = (at[a], part[a]), [], [], None
                if kind[a] == 0:
                    ids.append(rid[a:b])
                    parts.append(matrix[a:b])
                elif parts:
                    for c in range(a, b, BATCH):
                        e = min(b, c + BATCH)
                        yield answers(rid[c:e], matrix[c:e], floor[c:e])

    return scored


def _expand(index: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the wanted (annulus, id, v, floor) queries, at most k of each annulus."""
    # there are not many more annuli than ANNULI
    parts = wanted.groupBy(F.col("annulus").alias("of")).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    parts = F.broadcast(stored(parts, "parts"))
    vectors = index.join(parts, F.col("annulus") == F.col("of")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    vectors = vectors.select("annulus", "part", F.lit(0).alias("kind"), "id", "v", F.lit(0).cast("long").alias("floor"))
    asking = wanted.join(parts, F.col("annulus") == F.col("of")).withColumn("part", F.expr("cast(pmod(xxhash64(id, v), parts) as int)"))
    merged = vectors.unionAll(asking.select("annulus", "part", F.lit(1).alias("kind"), "id", "v", "floor")).repartition("annulus", "part").sortWithinPartitions("annulus", "part", "kind")
    return merged.mapInArrow(_scored(k), "query_id long, vec_id long, score long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivot_count: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other vectors of each query.

    vectors and queries: (id, v) as integer_vectors makes them; sample bounds the rows that the pivots are chosen from.
    """
    widths = vectors.groupBy(F.length("v").alias("width")).count().orderBy("width").collect()
    found = [_search(vectors.where(F.length("v") == r["width"]), queries.where(F.length("v") == r["width"]), r["count"], k, pivot_count, sample) for r in widths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # an id may stand for vectors of several lengths
    scores = reduce(DataFrame.unionAll, found)
    return _best(scores, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(vectors: DataFrame, queries: DataFrame, n: int, k: int, pivot_count: int | None, sample: int) -> DataFrame:
    """At least the k best scores of each query, among vectors of one length."""
    some = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()
    count = min(max(PIVOTS, n // PER_PIVOT), MOST_PIVOTS) if pivot_count is None else pivot_count
    pivots = _pivots(np.array([np.frombuffer(r["v"], "<i8") for r in some], np.float64), count)
    schema = "id long, v binary, pivot int, r double, norm double"
    ordered = vectors.mapInArrow(_indexed(pivots), schema).repartitionByRange("pivot", "r", "id").sortWithinPartitions("pivot", "r", "id")
    index = stored(ordered.mapInArrow(_cut(max(ANNULUS, n // ANNULI)), "annulus long, " + schema), "annuli")
    summary = index.groupBy("annulus", "pivot").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("norm").alias("most")).orderBy("annulus").toArrow()
    rings = {c: summary[c].to_numpy() for c in summary.column_names}
    asked = stored(queries.dropDuplicates(["id", "v"]).mapInArrow(_indexed(pivots), schema), "asked")
    target = "annulus long, id long, v binary, floor long"
    none = F.lit(NONE).cast("long")
    near = stored(asked.withColumn("floor", none).mapInArrow(_wanted(pivots, rings, True), target), "near")
    floors = _best(_expand(index, near, k), k).where(F.col("rank") == k).groupBy("query_id").agg(F.min("score").alias("floor"))
    again = asked.join(stored(floors, "floors"), F.col("id") == F.col("query_id"), "left").select(*asked.columns, F.coalesce("floor", none).alias("floor"))
    return _expand(index, stored(again.mapInArrow(_wanted(pivots, rings, False), target), "wanted"), k)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(CASE WHEN len(q.v) = len(c.v) THEN list_dot_product(q.v, c.v) END AS BIGINT) AS score
  FROM q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
