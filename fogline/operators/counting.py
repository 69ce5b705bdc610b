"""Counting operators: transition chains, shrinkage, priors, histograms, labels.

Every count is a hash aggregate with partial sums in the map tasks; a row total is a second aggregate joined back on
the row key, whose size is that of the counted table, never that of the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(moves: DataFrame, keys: Sequence[str], place: str, next_place: str, least: int = 1) -> DataFrame:
    return moves.groupBy(*keys, place, next_place).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def row_share(df: DataFrame, keys: Sequence[str], value: str, name: str = "p") -> DataFrame:
    """value over its sum by keys; null where the sum is 0."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(w)))


def random_walk(edges: DataFrame, stays: DataFrame, place: str, next_place: str) -> DataFrame:
    """(place, next, p): stay with the place's own rate, else go to a neighbour at equal odds. stays: (place, stay)."""
    degree = edges.groupBy(place).agg(F.count("*").alias("degree"))
    out = edges.join(degree, place).join(stays, place, "left").withColumn("stay", F.when(F.col("degree") > 0, F.coalesce("stay", F.lit(0.0))))
    go = out.select(place, next_place, ((1 - F.col("stay")) / F.col("degree")).alias("p"))
    return go.unionByName(stays.select(place, F.col(place).alias(next_place), F.col("stay").alias("p")))


def shrunk(counts: DataFrame, parent: DataFrame, keys: Sequence[str], place: str, next_place: str, strength: float) -> DataFrame:
    """(n + strength * parent p) over its row sum, for every group of keys with counts in the row.

    parent: (place, next, p), the chain the counts are drawn to; it may hold transitions that were never counted.
    """
    rows = counts.select(*keys, place).distinct()
    prior = rows.join(parent.select(place, next_place, F.col("p").alias("prior")), place)
    both = prior.join(counts, [*keys, place, next_place], "full").fillna(0, ["n", "prior"])
    return row_share(both.withColumn("mass", F.col("n") + strength * F.col("prior")), [*keys, place], "mass").select(*keys, place, next_place, "p")


def smoothed_share(counts: DataFrame, cells: DataFrame, keys: Sequence[str], cell: str, add: float) -> DataFrame:
    """(n + add) over its sum, for all keys and all cells."""
    dense = cells.select(cell).distinct()
    if keys:
        dense = counts.select(*keys).distinct().crossJoin(dense)  # as many rows as the result
    both = dense.join(counts, [*keys, cell], "left").fillna(0, ["n"]).withColumn("mass", F.col("n") + add)
    return row_share(both, keys, "mass").select(*keys, cell, "n", "p")


def majority(df: DataFrame, key: str, label: str, default: str = "Unknown") -> DataFrame:
    """The most frequent non-empty label of each key, the first in order among equals; default if it has none."""
    named = df.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(key, label).agg(F.count("*").alias("n"))
    best = named.groupBy(key).agg(F.max_by(label, F.struct("n", F.expr(f"transform(split({label}, ''), c -> -ascii(c))"))).alias(label))
    return df.select(key).distinct().join(best, key, "left").fillna(default, [label])


def floors(df: DataFrame, keys: Sequence[str], z: str, gap: float, least: int, most: int = 3) -> DataFrame:
    """Heights of a key's floors: sorted values are cut at gaps over `gap`; a part of `least` values or more is a floor at
    its 10th percentile; the lowest `most` floors count."""
    w = Window.partitionBy(*keys).orderBy(z)
    cut = df.withColumn("__new", (F.coalesce(F.col(z) - F.lag(z).over(w), F.lit(0.0)) > gap).cast("int"))
    cut = cut.withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy(*keys, "__part").agg(F.count("*").alias("n"), F.percentile(z, F.lit(0.1)).alias("height")).where(F.col("n") >= least)
    return parts.withColumn("floor", F.row_number().over(Window.partitionBy(*keys).orderBy("height")) - 1).where(F.col("floor") < most).drop("__part")


def binomial_cells(df: DataFrame, bins: Sequence[str], hit: Column) -> DataFrame:
    """Trials and hits by bins: what a binned fit needs, whatever the number of rows."""
    return df.groupBy(*bins).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("k"))


def pair_factors(counts: DataFrame, a: str, b: str, add: float = 3.0, lo: float = 0.02, hi: float = 50.0) -> DataFrame:
    """Symmetric ratio of hits k to expected hits e by unordered pair, shrunk to 1 and clipped; pairs are mirrored, and
    a pair of equal ends counts twice like any other that is met from both sides."""
    both = counts.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), "k", "e").groupBy(a, b).agg(F.sum("k").alias("k"), F.sum("e").alias("e"))
    double = F.when(F.col(a) == F.col(b), 2).otherwise(1)
    ratio = F.greatest(F.lit(lo), F.least(F.lit(hi), (F.col("k") * double + add) / (F.col("e") * double + add)))
    both = both.select(a, b, ratio.alias("factor"))
    return both.unionByName(both.where(F.col(a) != F.col(b)).select(F.col(b).alias(a), F.col(a).alias(b), "factor"))


def bands(df: DataFrame, keys: Sequence[str], z: str, above: float) -> DataFrame:
    """lo and hi of z by keys, and hi_floor: the least z more than `above` over lo."""
    ends = df.groupBy(*keys).agg(F.min(z).alias("lo"), F.max(z).alias("hi"))
    upper = df.join(ends.select(*keys, "lo"), list(keys)).where(F.col(z) > F.col("lo") + above).groupBy(*keys).agg(F.min(z).alias("hi_floor"))
    return ends.join(upper, list(keys), "left")
