"""Spotting: pairs of observers and targets, a fitted chance to be seen, and what is known from not seeing anyone."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins, maths
from . import counting, fitting

# Distance edges, and widths and numbers of the angle bins.
DISTANCES = (250, 500, 750, 1000, 1500, 2000, 3000)
BANDS = (0, *DISTANCES)
ANGLE, OFF_BINS, UP_BINS = 5.0, 36, 10
EYE, CHEST, SMOKE, MOST = 64.0, 48.0, 130.0, 0.9


def _bins(dx: Column, dy: Column, dz: Column, yaw: Column, pitch: Column) -> list[Column]:
    far = F.hypot(dx, dy)
    up = F.abs(F.degrees(F.atan2(dz, F.greatest(far, F.lit(1.0)))) + pitch)
    return [bins.bin_left(far, DISTANCES).alias("dbin"), bins.fixed_bin(maths.off_axis(yaw, dx, dy), ANGLE, OFF_BINS).alias("obin"), bins.fixed_bin(up, ANGLE, UP_BINS).alias("vbin")]


def pair_views(states: DataFrame, cells: DataFrame, observers: DataFrame | None = None, clouds: DataFrame | None = None) -> DataFrame:
    """Observers and living enemies at the same tick: a, b (cells), dbin, obin, vbin and whether b was seen by a.

    A tick has ten players, so a row meets at most five others. Geometry is that of the target's cell, as at inference.
    observers: the states that can see at all (by default all); clouds: demo_id, tick and an array of the smokes' sx and
    sy; pairs that a smoke hides are no trials.
    """
    keys = ["demo_id", "tick"]
    o = (states if observers is None else observers).select(*keys, F.col("side").alias("os"), F.col("steamid").alias("oid"), F.col("node").alias("a"), F.col("X").alias("ox"), F.col("Y").alias("oy"), F.col("Z").alias("oz"), "yaw", "pitch")
    t = states.select(*keys, F.col("side").alias("ts"), F.col("node").alias("b"), F.col("X").alias("px"), F.col("Y").alias("py"), F.col("Z").alias("pz"), "spotted_by")
    at = cells.select(F.col("node").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    met = o.join(t, keys).where("os <> ts").join(at, "b")
    if clouds is not None:
        met = met.join(clouds, keys, "left").where(~_hidden(F.col("px"), F.col("py")))
    geometry = _bins(F.col("tx") - F.col("ox"), F.col("ty") - F.col("oy"), F.col("tz") + CHEST - (F.col("oz") + EYE), F.col("yaw"), F.col("pitch"))
    return met.select(*keys, "a", "b", *geometry, F.coalesce(F.array_contains("spotted_by", F.col("oid")), F.lit(False)).alias("hit"), "ox", "oy", "oz", "px", "py", "pz")


def _hidden(tx: Column, ty: Column) -> Column:
    """Whether one of the clouds lies on the line from (ox, oy)."""
    return F.coalesce(F.exists("clouds", lambda c: maths.segment_distance(c["sx"], c["sy"], F.col("ox"), F.col("oy"), tx, ty) < SMOKE), F.lit(False))


def opened_pixels(views: DataFrame) -> DataFrame:
    """(px, py, low, high): the heights at which the lines of real sightings crossed a pixel, from eye to chest."""
    from .maps import ray_samples

    ends = {"ax": F.col("ox"), "ay": F.col("oy"), "az": F.col("oz") + EYE, "bx": F.col("px"), "by": F.col("py"), "bz": F.col("pz") + CHEST}
    rays = views.where("hit").select(*(c.cast("double").alias(name) for name, c in ends.items()))
    return ray_samples(rays).where("px is not null").groupBy("px", "py").agg(F.min("z").alias("low"), F.max("z").alias("high"))


def _classed(views: DataFrame, lines: DataFrame) -> DataFrame:
    """views with class: by the two kinds of free line (walk, carve), and distance."""
    kinds = lines.select("a", "b", "walk", "carve")
    line = 2 * F.coalesce(F.col("walk"), F.lit(False)).cast("int") + F.coalesce(F.col("carve"), F.lit(False)).cast("int")
    return views.join(kinds, ["a", "b"], "left").withColumn("class", line * len(BANDS) + F.col("dbin"))


def fit_spotting(views: DataFrame, lines: DataFrame) -> list[np.ndarray]:
    """Additive logit tables (kinds of free line x distance, angle off, angle up) of binned trials."""
    cells = _classed(views, lines).groupBy("class", "obin", "vbin").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("k"))
    return fitting.fit_binned_logit(cells, [("class", 4 * len(BANDS)), ("obin", OFF_BINS), ("vbin", UP_BINS)])


def spot_factors(views: DataFrame, lines: DataFrame, tables: Sequence[np.ndarray]) -> DataFrame:
    """(a, b, factor): how much oftener than the tables say a pair of cells saw each other, drawn to 1."""
    expected = maths.additive_logit(tables, [F.col("class"), F.col("obin"), F.col("vbin")])
    counts = _classed(views, lines).groupBy("a", "b").agg(F.sum(F.col("hit").cast("long")).alias("k"), F.sum(expected).alias("e"))
    return counting.pair_factors(counts, "a", "b")


def with_factors(lines: DataFrame, factors: DataFrame | None) -> DataFrame:
    """lines with factor, 1 where none was fitted."""
    if factors is None:
        return lines.withColumn("factor", F.lit(1.0))
    return lines.join(factors, ["a", "b"], "left").fillna(1.0, ["factor"])


def looks(observers: DataFrame, cells: DataFrame, lines: DataFrame, tables: Sequence[np.ndarray], keys: Sequence[str], smokes: DataFrame | None = None) -> DataFrame:
    """(keys, looked, missed): at every step the cells in free sight of observers and the chance that none of them sees
    an enemy there: the product of 1 - p, p at most 0.9, and 0 through smoke.

    observers: keys and node, X, Y, Z, yaw, pitch of those who are alive and not blinded; lines: of with_factors();
    smokes: keys and sx, sy of those in bloom.
    """
    at = cells.select(F.col("node").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    o = observers.select(*keys, F.col("node").alias("a"), F.col("X").alias("ox"), F.col("Y").alias("oy"), F.col("Z").alias("oz"), "yaw", "pitch")
    if smokes is not None:
        o = o.join(smokes.groupBy(*keys).agg(F.collect_list(F.struct("sx", "sy")).alias("clouds")), list(keys), "left")  # a handful at a time
    met = o.join(lines.select("a", "b", "walk", "carve", "factor"), "a").join(at, "b")
    d, off, up = _bins(F.col("tx") - F.col("ox"), F.col("ty") - F.col("oy"), F.col("tz") + CHEST - (F.col("oz") + EYE), F.col("yaw"), F.col("pitch"))
    line = 2 * F.col("walk").cast("int") + F.col("carve").cast("int")
    p = F.least(F.lit(MOST), F.col("factor") * maths.additive_logit(tables, [d + line * len(BANDS), off, up]))
    if smokes is not None:
        p = F.when(_hidden(F.col("tx"), F.col("ty")), 0.0).otherwise(p)
    each = met.withColumn("p", p).groupBy(*keys, "b").agg(F.exp(F.sum(F.log1p(-F.col("p")))).alias("miss"))
    return each.groupBy(*keys).agg(F.collect_list("b").alias("looked"), F.collect_list("miss").alias("missed"))


def shooter_likelihood(kills: DataFrame, cells: DataFrame, lines: DataFrame, tables: Sequence[np.ndarray], keys: Sequence[str], most: int = 20_000) -> DataFrame:
    """(keys, like): for each kill (keys; node, X, Y of the victim; obstructed) how well every cell suits the shooter, in
    order of cells: 0.05 + 0.95 p / max p by distance, free line and factor; through walls or smoke 1 within 2,000
    units. The cells of a map are checked to be few and go to every task; a kill meets the lines of its own cell only.
    """
    at = cells.select("node", "x", "y").limit(most + 1).toPandas().sort_values("node")
    if len(at) > most:
        raise ValueError("a map has at most `most` cells")
    nodes, xy = at.node.to_numpy(), at[["x", "y"]].to_numpy(float)
    table, rest = np.asarray(tables[0], float).reshape(4, -1), float(tables[1][0] + tables[2][0])
    of = lines.groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct("b", (2 * F.col("walk").cast("int") + F.col("carve").cast("int")).alias("line"), "factor")).alias("free"))

    @F.arrow_udf("array<double>")
    def like(x: pa.Array, y: pa.Array, obstructed: pa.Array, free: pa.Array) -> pa.Array:
        out = []
        for px, py, hidden, seen in zip(x.to_pylist(), y.to_pylist(), obstructed.to_pylist(), free.to_pylist(), strict=True):
            far = np.hypot(xy[:, 0] - px, xy[:, 1] - py)
            if hidden:
                out.append(np.where(far <= 2000, 1.0, 0.05))
                continue
            line, factor = np.zeros(len(nodes), int), np.ones(len(nodes))
            if seen:
                place = np.searchsorted(nodes, [c["b"] for c in seen])
                line[place], factor[place] = [c["line"] for c in seen], [c["factor"] for c in seen]
            p = factor / (1 + np.exp(-(table[line, np.searchsorted(DISTANCES, far)] + rest)))
            out.append(0.05 + 0.95 * p / max(p.max(), 1e-9))
        return pa.array(out, pa.list_(pa.float64()))

    met = kills.join(of, "node", "left")
    return met.select(*keys, like("X", "Y", "obstructed", "free").alias("like"))
