"""Drawing rows by weight: prefix sums over partitions, draws with replacement, systematic resampling.

No group is ever one task's: rows are range-partitioned by key and order, a key's partitions add up through a table of
one row for each key and partition, and a look-up by cumulated weight carries only a partition's last row to the next.
Uniform numbers are columns, so a draw is the same whatever the partitions are. Weights should be integers or decimals
where sums must not depend on the order of additions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

UNBOUNDED = Window.unboundedPreceding
#: Shifts and constants of MD5's 64 steps.
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = tuple(int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64))


def hashed(prefix: bytes, first: int, many: int, part: int = 32_768) -> np.ndarray:
    """The first 15 hexadecimal digits of the MD5s of prefix and each of the numbers first, first + 1, ... in decimals, as
    integers. prefix: 35 bytes at most, so that all of it is one block of MD5."""
    out, at, last = np.empty(many, np.uint64), first, first + many
    while at < last:
        digits = len(str(at))
        stop = min(last, 10**digits, at + part)
        out[at - first : stop - first] = _one_block(prefix, np.arange(at, stop), digits)
        at = stop
    return out.astype(np.int64)


def _one_block(prefix: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    size = len(prefix) + digits
    fixed = prefix + b"\0" * digits + b"\x80" + b"\0" * (55 - size) + (8 * size).to_bytes(8, "little")
    words: list = list(np.frombuffer(fixed, "<u4"))
    for place in range(len(prefix), size):
        digit = (numbers // 10 ** (size - 1 - place) % 10 + 48).astype(np.uint32)
        words[place // 4] = words[place // 4] + (digit << np.uint32(8 * (place % 4)))
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(len(numbers), x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + np.uint32(SINES[i]) + words[g]
        turn = SHIFTS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    high, low = ((x + np.uint32(y)).byteswap().astype(np.uint64) for x, y in zip((a, b), start, strict=False))
    return (high << np.uint64(32) | low) >> np.uint64(4)


def prefix_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str) -> DataFrame:
    """rows of positive weight with before, upto and total: sums of weights of the rows of the same keys before the row,
    up to it, and of all. order must tell the rows of a key apart; rows with a null key are left out."""
    kept = rows.where(F.col(weight) > 0)
    kept = kept.dropna(subset=list(keys)) if keys else kept
    parts = stored(kept.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "prefix")
    each = parts.groupBy(*keys, "__part").agg(F.sum(weight).alias("__sum"))
    over = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("__sum").over(over.orderBy("__part").rowsBetween(UNBOUNDED, -1)), F.lit(0))
    offsets = each.select(*keys, "__part", earlier.alias("__earlier"), F.sum("__sum").over(over).alias("total"))
    local = parts.withColumn("__upto", F.sum(weight).over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(UNBOUNDED, 0)))
    upto = F.col("__earlier") + F.col("__upto")
    return local.join(offsets, [*keys, "__part"]).select(*rows.columns, (upto - F.col(weight)).alias("before"), upto.alias("upto"), "total")


def dense_ranks(rows: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """(column, rank, total): the different values of a column with their place in order from 0, and how many there are."""
    each = rows.select(column).distinct().withColumn("__one", F.lit(1))
    return prefix_sums(each, [], [column], "__one").select(column, F.col("before").cast("long").alias(name), F.col("total").cast("long").alias("total"))


def at_or_before(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str, values: Sequence[str]) -> DataFrame:
    """left with `values` of the right row of the same keys that has the greatest position at or before its own (null:
    none). An as-of join whose keys may be as hot as they like: both sides are range-partitioned by key and position
    together, and a partition hands its last right row on."""
    payload = F.struct(*keys, *(F.col(v).alias(f"v_{v}") for v in values))
    extra = [c for c in left.columns if c not in (*keys, position)]
    a = left.select(*keys, F.col(position).cast("double").alias("__at"), F.lit(1).alias("__side"), F.struct(position, *extra).alias("__left"))
    b = right.select(*keys, F.col(position).cast("double").alias("__at"), F.lit(0).alias("__side"), payload.alias("__right"))
    merged = a.unionByName(b, allowMissingColumns=True).repartitionByRange(*keys, "__at").withColumn("__part", F.spark_partition_id())
    merged = stored(merged, "merged")
    # the last right row of every partition: one row each
    ends = merged.where("__side = 0").groupBy("__part").agg(F.max_by("__right", F.struct(*keys, "__at")).alias("__end"))
    every = merged.select("__part").distinct().join(ends, "__part", "left")
    carried = every.select("__part", F.last("__end", True).over(Window.orderBy("__part").rowsBetween(UNBOUNDED, -1)).alias("__carried"))
    last = F.last("__right", True).over(Window.partitionBy("__part").orderBy(*keys, "__at", "__side").rowsBetween(UNBOUNDED, 0))
    met = merged.withColumn("__last", last).where("__side = 1").join(F.broadcast(carried), "__part")
    found = F.coalesce("__last", "__carried")
    same = F.lit(True)
    for k in keys:
        same = same & (found[k] == F.col(k))
    return met.select(*keys, "__left.*", *(F.when(same, found[f"v_{v}"]).alias(v) for v in values))


def with_replacement(draws: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, u: str, values: Sequence[str]) -> DataFrame:
    """draws (keys, u in [0, 1), anything else) with `values` of a row of the same keys, chosen with odds by weight: the
    one whose interval of cumulated weights holds u times the total. Draws whose keys have no row of positive weight get
    null."""
    sums = prefix_sums(rows.select(*dict.fromkeys([*keys, *order, weight, *values])), keys, order, weight)
    totals = rows.where(F.col(weight) > 0).groupBy(*keys).agg(F.sum(weight).alias("__total"))
    placed = draws.join(totals, list(keys), "left").withColumn("__position", F.coalesce(F.col(u) * F.col("__total"), F.lit(0.0)))
    found = at_or_before(placed, sums.withColumn("__position", F.col("before")), keys, "__position", values)
    return found.select(*draws.columns, *values)


def systematic(rows: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, m: int, u: Column) -> DataFrame:
    """rows with copies: how many of the m positions (i + u) / m, i from 0, fall into the row's share of the cumulated
    weights of its keys. u is one number in [0, 1) for all rows of a key; rows of no copy are left out."""
    s = prefix_sums(rows, keys, order, weight)
    first = lambda upto: F.ceil(F.lit(m) * F.col(upto) / F.col("total") - u)
    return s.withColumn("copies", (first("upto") - first("before")).cast("int")).where("copies > 0").drop("before", "upto", "total")
