"""Geometry, kernels and probability maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_degrees(d: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def off_axis(yaw: Column, dx: Column, dy: Column) -> Column:
    """Angle between a viewing direction (degrees) and the direction to a point."""
    return F.abs(wrap_degrees(F.degrees(F.atan2(dy, dx)) - yaw))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to the segment a-b; a segment of no length is its point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((px - ax) * dx + (py - ay) * dy) / length).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, floor: float = 0.01) -> Column:
    p = F.greatest(F.lit(floor), F.least(F.lit(1.0 - floor), p))
    return F.log(p / (1.0 - p))


def additive_logit(tables: Sequence[Sequence[float]], bins: Sequence[Column]) -> Column:
    """sigmoid of the sum of one coefficient of each table, picked by 0-based bins."""
    total = F.lit(0.0)
    for values, b in zip(tables, bins, strict=True):
        total = total + F.element_at(F.array(*(F.lit(float(v)) for v in values)), b + 1)
    return sigmoid(total)


def gaussian(d: Column, sigma: float) -> Column:
    return F.exp(-0.5 * d * d / (sigma * sigma))


def log_time_kernel(a: Column, b: Column, sigma: float = 0.5, one_never: float = 0.05) -> Column:
    """Similarity of two ages: Gaussian in log1p; null is never: both 1, one `one_never`."""
    both = F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), one_never)
    return both.otherwise(gaussian(F.log1p(a) - F.log1p(b), sigma))


def heading_kernel(ux: Column, uy: Column, vx: Column, vy: Column, kappa: float = 3.0, slow: float = 20.0) -> Column:
    """Similarity of two movements: von Mises for two moving, 0.3 if only the first moves, else decay with speed."""
    su, sv = F.hypot(ux, uy), F.hypot(vx, vy)
    cos = (ux * vx + uy * vy) / F.greatest(su * sv, F.lit(1e-9))
    return F.when(su > slow, F.when(sv > slow, F.exp(kappa * (cos - 1))).otherwise(0.3)).otherwise(F.exp(-sv / 15.0))


def class_kernel(own: Column, p: Column, m: float = 0.7) -> Column:
    """Expected m ** |own - j| with class j of probability p[j]."""
    return F.aggregate(F.transform(p, lambda x, j: x * F.pow(F.lit(m), F.abs(own - j).cast("double"))), F.lit(0.0), lambda a, x: a + x)


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double"))


def normalise(p: Column) -> Column:
    """p over its sum; p itself if the sum is not positive."""
    return F.transform(p, lambda x: x / F.when(total(p) > 0, total(p)).otherwise(1.0))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    return normalise(F.transform(x, lambda v: F.exp(v.cast("double") - top)))


def power_map(p: Column, a: float) -> Column:
    return normalise(F.transform(p, lambda x: F.pow(F.greatest(x.cast("double"), F.lit(1e-6)), F.lit(float(a)))))


def platt_map(p: Column, a: float, b: float) -> Column:
    def one(x: Column) -> Column:
        x = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x.cast("double")))
        return sigmoid(a * F.log(x / (1 - x)) + b)

    return normalise(F.transform(p, one))


#: Places at which the piecewise map changes slope.
KNOTS = (0.02, 0.2, 0.6)


def piecewise_map(p: Column, slopes: Sequence[float]) -> Column:
    """Piecewise linear with non-negative slopes between 0, KNOTS and 1."""
    edges = (0.0, *KNOTS, 1.0)

    def one(x: Column) -> Column:
        out = F.lit(1e-6)
        for lo, hi, s in zip(edges, edges[1:], slopes, strict=False):
            out = out + float(s) * F.greatest(F.lit(0.0), F.least(x.cast("double"), F.lit(hi)) - lo)
        return out

    return normalise(F.transform(p, one))


def log_loss(p: Column, floor: float = 1e-9) -> Column:
    return -F.log(F.greatest(F.lit(floor), F.least(F.lit(1.0), p)))


def rank_against(p: Column, truth: Column) -> Column:
    """Rank from 0 of the true entry, ties counted against it."""
    own = F.element_at(p, truth + 1)
    return F.size(F.filter(p, lambda x: x >= own)) - 1


def split_credit(p: Column, truth: Column, k: int) -> Column:
    """Share of the ways to break ties that put the true entry among the first k."""
    own = F.element_at(p, truth + 1)
    above, tied = F.size(F.filter(p, lambda x: x > own)), F.size(F.filter(p, lambda x: x == own))
    return F.greatest(F.lit(0), F.least(F.lit(k) - above, tied)) / tied


def first_argmax(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def blend(p: Column, q: Column, w: Column | float) -> Column:
    w = w if isinstance(w, Column) else F.lit(float(w))
    return F.zip_with(p, q, lambda a, b: w * a + (1.0 - w) * b)


def effective_size(weights: Column) -> Column:
    s, q = total(weights), F.aggregate(weights, F.lit(0.0), lambda a, x: a + x * x)
    return s * s / F.when(q > 0, q)
