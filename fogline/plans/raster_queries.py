"""Floors by fine pixels, points of columns and free rays, over positions that the order lines make up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maps
from ..session import stored, table
from .registry import query

#: Positions: a floor of 640 by 400 units with heights up to 300. Only some parts are walked on.
P = """p AS (SELECT l_partkey * 37 % 6400 / 10.0 AS x, l_suppkey * 13 % 40 * 10 + l_quantity / 5 AS y, l_discount * 3000 AS z FROM lineitem WHERE l_partkey % 7 <> 0),
  h AS (SELECT floor(x / 16)::INTEGER AS px, floor(y / 16)::INTEGER AS py, z, count(*) AS n FROM p GROUP BY ALL), l AS (SELECT px, py, min(z) AS lo FROM h GROUP BY ALL),
  b AS (SELECT px, py, sum(n)::BIGINT AS n, min(lo) AS lo, coalesce(min(CASE WHEN z > lo + 110 THEN z END), min(lo)) AS hi FROM h JOIN l USING (px, py) GROUP BY ALL)"""
#: Columns with their mean positions, and the nearest walked pixel of each.
C = """m AS (SELECT floor(x / 64)::INTEGER AS cx, floor(y / 64)::INTEGER AS cy, avg(x) AS mx, avg(y) AS my, min(z) AS z FROM p GROUP BY ALL),
  c AS (SELECT (cx * 100 + cy)::BIGINT AS node, z, arg_min(ROW((px + 0.5) * 16, (py + 0.5) * 16), ROW(((px + 0.5) * 16 - mx) ** 2 + ((py + 0.5) * 16 - my) ** 2, py, px)) AS spot
    FROM m JOIN b ON floor(px * 16 / 64) = cx AND floor(py * 16 / 64) = cy GROUP BY ALL)"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_partkey % 7 <> 0")  # noqa: E741
    return l.select((F.col("l_partkey") * 37 % 6400 / 10).alias("X"), (F.col("l_suppkey") * 13 % 40 * 10 + F.col("l_quantity") / 5).alias("Y"), (F.col("l_discount") * 3000).alias("Z"))


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _positions(spark, sf_dir)
    bands = stored(maps.pixel_bands(p), "bands")
    cx, cy = maps.columns(F.col("X"), F.col("Y"), 0.0, 0.0)
    means = p.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.avg("X").alias("x"), F.avg("Y").alias("y"), F.min("Z").alias("z"))
    cells = means.select((F.col("cx") * 100 + F.col("cy")).cast("long").alias("node"), "cx", "cy", "x", "y", "z")
    return maps.representative_points(cells, bands, 0.0, 0.0), bands


@query(f"WITH {P} SELECT px, py, n, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b")
def raster_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two floors of every fine pixel."""
    b = maps.pixel_bands(_positions(spark, sf_dir))
    return b.select("px", "py", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {P}, {C} SELECT node, spot[1]::DOUBLE AS x, spot[2]::DOUBLE AS y FROM c")
def representative_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point that stands for a column: the walked pixel nearest to the mean position."""
    return _points(spark, sf_dir)[0].select("node", "x", "y")


@query(f"""WITH {P}, {C}, e AS (SELECT node, spot[1]::DOUBLE AS x, spot[2]::DOUBLE AS y, z + 64 AS z FROM c),
  r AS (SELECT a.node AS a, b.node AS b, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS far FROM e a JOIN e b ON a.node < b.node WHERE sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) <= 250),
  s AS (SELECT *, i / n AS t FROM (SELECT *, greatest(ceil(far / 8), 1)::INTEGER AS n FROM r), LATERAL (SELECT unnest(range(1, n)) AS i)),
  q AS (SELECT a, b, floor((ax + t * (bx - ax)) / 16)::INTEGER AS px, floor((ay + t * ("by" - ay)) / 16)::INTEGER AS py, az + t * (bz - az) AS z FROM s WHERE t * far > 20 AND far - t * far > 20),
  k AS (SELECT q.a, q.b, bool_or(lo IS NULL OR lo > z - 8 OR (hi - lo > 110 AND z > hi - 40 AND z < hi + 4)) AS solid FROM q LEFT JOIN b ON b.px = q.px AND b.py = q.py GROUP BY ALL)
  SELECT r.a, r.b FROM r LEFT JOIN k ON k.a = r.a AND k.b = r.b WHERE NOT coalesce(solid, false)""")
def free_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of columns within 250 units whose eyes see each other."""
    cells, bands = _points(spark, sf_dir)
    return maps.sight_lines(cells, bands, reach=250.0).where("a < b").select("a", "b")
