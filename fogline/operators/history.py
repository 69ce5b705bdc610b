"""Round histories: economy recurrences, halves, streaks, modes and last results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_numbers(number: Column, regular: int = 12, overtime: int = 3) -> tuple[Column, Column]:
    """(half, round within the half), both from 1: two regular halves, then overtime halves."""
    n = number - 1
    extra = n - 2 * regular
    half = F.when(n < 2 * regular, F.floor(n / regular) + 1).otherwise(F.floor(extra / overtime) + 3)
    place = F.when(n < 2 * regular, F.pmod(n, F.lit(regular)) + 1).otherwise(F.pmod(extra, F.lit(overtime)) + 1)
    return half.cast("int"), place.cast("int")


def round_numbers(rounds: DataFrame, kills: DataFrame, match: str = "demo_id") -> DataFrame:
    """(match, round_num, number): rounds numbered from 1 without a knife round.

    The first round of a match is a knife round if it has kills and all are by knife, bayonet or the world.
    """
    first = rounds.groupBy(match).agg(F.min("round_num").alias("round_num"))
    knife = kills.join(first, [match, "round_num"]).groupBy(match, "round_num").agg(F.min(F.col("weapon").rlike("knife|bayonet|^world$").cast("int")).alias("knife")).where("knife = 1")
    played = rounds.select(match, "round_num").distinct().join(knife, [match, "round_num"], "left_anti")
    return played.withColumn("number", F.row_number().over(Window.partitionBy(match).orderBy("round_num")))


def loss_bonus(df: DataFrame, keys: Sequence[str], order: Sequence[str], won: Column, most: int = 4) -> DataFrame:
    """losses: the bonus level before each row; a win lowers it by one, a loss raises it, within [0, most].

    keys hold one half of one side (a dozen rows), so the fold over the earlier results stays tiny.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(won.cast("int")).over(w)
    level = F.aggregate(earlier, F.lit(0), lambda a, x: F.when(x == 1, F.greatest(a - 1, F.lit(0))).otherwise(F.least(a + 1, F.lit(most))))
    return df.withColumn("losses", level)


def earlier_results(df: DataFrame, keys: Sequence[str], order: Sequence[str], won: str) -> DataFrame:
    """won_last and won_first among the earlier rows of the keys (null at the first row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("won_last", F.lag(won).over(w)).withColumn("won_first", F.first(won).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def last_results(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """(keys, results): the last n values, newest first."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    top = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", value))), lambda x: x[value]).alias("results"))


def opening(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first row of the keys."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__first")).select(*keys, "__first.*")


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, n: int = 1) -> DataFrame:
    """(keys, value, n, place): the n most frequent values, ties in order of the value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), value)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def nearest_in_time(left: DataFrame, library: DataFrame, keys: Sequence[str], clock: str, width: float, most: int, tie: str) -> DataFrame:
    """For each left row the library rows of the same keys within `width` of its clock, the `most` nearest.

    Joined by buckets of the clock, so that only neighbouring buckets meet; left needs an id column.
    """
    bucket = lambda c: F.floor(c / width)
    near = left.withColumn("__b", F.explode(F.array(*(bucket(F.col(clock)) + i for i in (-1, 0, 1)))))
    lib = library.select(*keys, F.col(clock).alias("lib_clock"), tie, bucket(F.col(clock)).alias("__b"))
    met = near.join(lib, [*keys, "__b"]).withColumn("__d", F.abs(F.col("lib_clock") - F.col(clock))).where(F.col("__d") <= width)
    w = Window.partitionBy("id").orderBy("__d", tie)
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("__b", "__d")
