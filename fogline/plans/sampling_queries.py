"""Weighted draws over the events, and the recorded states near a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins
from ..operators import particles, sampling
from .common import E, sightings
from .registry import query

#: SQL of prefix sums of value in cents by user.
SUMS = f"""{E}, c AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM e),
  s AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS upto, sum(cents) OVER (PARTITION BY user_id) AS total FROM c WHERE cents > 0)"""


def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query(f"""WITH {SUMS}, u AS (SELECT user_id, i, ('0x' || md5('draw|' || user_id || '|' || i)[1:13])::BIGINT / 4503599627370496.0 AS u FROM (SELECT DISTINCT user_id FROM e), range(20) t(i))
  SELECT u.user_id, i::INTEGER AS i, event_id FROM u JOIN s ON s.user_id = u.user_id AND u.u * s.total >= s.upto - s.cents AND u.u * s.total < s.upto""")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events of each user, drawn with replacement by their value."""
    rows = _cents(spark, sf_dir)
    draws = rows.select("user_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    draws = draws.withColumn("u", bins.hash_uniform(F.col("user_id"), F.col("i"), seed="draw"))
    return sampling.with_replacement(draws, rows, ["user_id"], ["event_id"], "cents", "u", ["event_id"]).drop("u")


@query(f"""WITH {SUMS}, p AS (SELECT *, ('0x' || md5('resample|' || user_id)[1:13])::BIGINT / 4503599627370496.0 AS u FROM s)
  SELECT user_id, event_id, cents, (ceil(64 * upto / total - u) - ceil(64 * (upto - cents) / total - u))::INTEGER AS copies FROM p WHERE ceil(64 * upto / total - u) > ceil(64 * (upto - cents) / total - u)""")
def systematic_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 particles of each user over its events by value, by systematic resampling."""
    return sampling.systematic(_cents(spark, sf_dir), ["user_id"], ["event_id"], "cents", 64, bins.hash_uniform(F.col("user_id"), seed="resample"))


@query(f"""WITH {E}, s AS (SELECT event_id, cell FROM e WHERE event_type = 'purchase'), c AS (SELECT DISTINCT cell AS node FROM e),
  r AS (SELECT a.node, b.node AS near, abs(a.node - b.node) AS ring FROM c a JOIN c b ON abs(a.node - b.node) <= 3),
  n AS (SELECT node, ring, count(event_id) AS n FROM r LEFT JOIN s ON s.cell = r.near GROUP BY ALL),
  k AS (SELECT node, ring, sum(n) OVER (PARTITION BY node ORDER BY ring) AS upto FROM n),
  z AS (SELECT node, coalesce(min(CASE WHEN upto >= 40 THEN ring END), max(ring)) AS ring FROM k GROUP BY node)
  SELECT z.node, event_id, r.ring::INTEGER AS ring FROM z JOIN r ON r.node = z.node AND r.ring <= z.ring JOIN s ON s.cell = r.near""")
def candidate_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cell the purchases at it, widened ring by ring (three at most) until there are forty."""
    e = sightings(spark, sf_dir)
    cells = e.select(F.col("cell").alias("node")).distinct()
    states = e.where("event_type = 'purchase'").select("event_id", F.lit(0).alias("side"), F.col("cell").alias("node"))
    edges = cells.select(F.col("node").alias("src"), F.explode(F.array(F.col("node") - 1, F.col("node") + 1)).alias("dst")).join(cells.select(F.col("node").alias("dst")), "dst")
    rings = particles.node_rings(cells, edges)
    wanted = cells.withColumn("side", F.lit(0))
    return particles.candidates(wanted, states, rings, particles.reach(rings, states, 40)).select("node", "event_id", "ring")
