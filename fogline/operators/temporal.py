"""Operators over time-ordered rows: as-of joins, forward fills, islands, interval joins.

Keys always come first in the window's partition, so rows of different matches never meet; ties in time are broken
by an explicit column. Null means never.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, when: Column, name: str, strict: bool = False) -> DataFrame:
    """name: value at the latest row where `when` holds; with strict only among earlier rows."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    return df.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(w))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], tie: str) -> DataFrame:
    """Each left row with `values` of the latest right row at or before it (null if none).

    Both sides are merged into one ordered stream, so it is one shuffle by keys and no range comparison of pairs; right
    rows come before left rows of the same time. right's own time is returned as right_<time>.
    """
    extra = [c for c in left.columns if c not in (*keys, time)]
    payload = F.struct(F.col(time).alias(f"right_{time}"), *values)
    blank = {c: left.schema[c].dataType for c in extra}
    a = left.select(*keys, time, *extra, F.lit(1).alias("__side"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__p"), F.col(tie).cast("long").alias("__tie"))
    b = right.select(*keys, time, *(F.lit(None).cast(t).alias(c) for c, t in blank.items()), F.lit(0).alias("__side"), payload.alias("__p"), F.lit(None).cast("long").alias("__tie"))
    w = _over(keys, [time, "__side", "__tie"]).rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b).withColumn("__p", F.last("__p", ignorenulls=True).over(w))
    return merged.where("__side = 1").select(*keys, time, *extra, "__p.*")


def asof_forward_strict(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], tie: str) -> DataFrame:
    """Each left row with the first right row of its keys that is strictly later."""
    extra = [c for c in left.columns if c not in (*keys, time)]
    payload = F.struct(F.col(time).alias(f"right_{time}"), *values)
    a = left.select(*keys, time, *extra, F.lit(1).alias("__side"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__p"), F.col(tie).cast("long").alias("__tie"))
    b = right.select(*keys, time, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra), F.lit(0).alias("__side"), payload.alias("__p"), F.lit(None).cast("long").alias("__tie"))
    # at equal times right rows come first, so they do not follow the left rows
    w = _over(keys, [time, "__side", "__tie"]).rowsBetween(1, Window.unboundedFollowing)
    merged = a.unionByName(b).withColumn("__p", F.first("__p", ignorenulls=True).over(w))
    return merged.where("__side = 1").select(*keys, time, *extra, "__p.*")


def lifetimes(starts: DataFrame, ends: DataFrame, keys: Sequence[str], time: str, tie: str, most: float, fallback: float) -> DataFrame:
    """starts with end_<time>: the next end of the same keys if it comes within `most`, else start + fallback."""
    found = asof_forward_strict(starts, ends, keys, time, [], tie)
    end = F.when(F.col(f"right_{time}") - F.col(time) < most, F.col(f"right_{time}")).otherwise(F.col(time) + fallback)
    return found.withColumn(f"end_{time}", end.cast(starts.schema[time].dataType)).drop(f"right_{time}")


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The rows where value is positive and differs from the row before (0 before the first)."""
    w = _over(keys, order)
    return df.withColumn("before", F.coalesce(F.lag(value).over(w), F.lit(0))).where((F.col(value) > 0) & (F.col(value) != F.col("before"))).drop("before")


def moves(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, place: str, most: float | None = None, exact: float | None = None) -> DataFrame:
    """Rows with next_<place> and gap to the next row of the keys; only steps of a gap <= most (or == exact)."""
    w = _over(keys, order)
    out = df.withColumn(f"next_{place}", F.lead(place).over(w)).withColumn("gap", F.lead(time).over(w) - F.col(time)).where(F.col("gap").isNotNull())
    if exact is not None:
        out = out.where(F.col("gap") == exact)
    return out.where(F.col("gap") <= most) if most is not None else out


def islands(df: DataFrame, keys: Sequence[str], step: str, newest: int | None = None) -> DataFrame:
    """Unbroken runs of integer steps: keys, first, last, n and, newest first, place; the newest ones if asked."""
    run = F.col(step) - F.row_number().over(_over(keys, [step]))
    out = df.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count("*").alias("n")).drop("__run")
    out = out.withColumn("place", F.row_number().over(_over(keys, [F.col("last").desc()])))
    return out.where(F.col("place") <= newest) if newest is not None else out


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str, width: int, closed: bool = False, how: str = "inner") -> DataFrame:
    """points within spans [start, end) (or [start, end] if closed) of the same keys.

    Spans are exploded to the buckets of `width` they touch and joined by keys and bucket, so that the join is an
    equi-join at every size; width should be near a typical span. how: inner or left_semi / left_anti on points.
    """
    bucket = lambda c: F.floor(c / width)
    s = spans.withColumn("__b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    p = points.withColumn("__b", bucket(F.col(time)))
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed else (F.col(time) < F.col(end)))
    on = [*(p[k] == s[k] for k in keys), p["__b"] == s["__b"], inside]
    joined = p.join(s, on, how)
    if how != "inner":
        return joined.drop("__b")
    return joined.select(*[p[c] for c in points.columns], *[s[c] for c in spans.columns if c not in keys])


def snap_up(time: Column, step: int) -> Column:
    """The first multiple of step at or after time."""
    return (F.ceil(time / step) * step).cast("long")


def running_best(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.max(value).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def seen_in_step(df: DataFrame, keys: Sequence[str], time: str, step: int, seen: str, value: str) -> DataFrame:
    """One row per keys and step: whether any sample of the step was seen and the value at the latest seen sample."""
    return df.groupBy(*keys, (F.floor(F.col(time) / step)).alias("step")).agg(F.max(F.col(seen).cast("int")).alias("seen"), F.max_by(F.when(F.col(seen), F.col(value)), F.when(F.col(seen), F.col(time))).alias(value))


def displacement(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, coords: Sequence[str], step: float) -> DataFrame:
    """d<coord> to the row before if it is one step earlier, else 0."""
    w = _over(keys, order)
    near = (F.col(time) - F.lag(time).over(w)) == step
    return df.withColumns({f"d{c}": F.when(near, F.col(c) - F.lag(c).over(w)).otherwise(0.0) for c in coords})
