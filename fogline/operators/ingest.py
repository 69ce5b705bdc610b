"""What is derived when recordings are parsed: round of an event, bombsites, grenade ends, flashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import temporal

TICKS = 64


def with_round(events: DataFrame, rounds: DataFrame, time: str = "tick") -> DataFrame:
    """events with the round they fall in: the latest one frozen out at or before them, if it has not ended."""
    r = rounds.where("freeze_end is not null").select("demo_id", F.col("freeze_end").alias(time), "round_num", "end")
    found = temporal.asof_backward(events.drop("round_num").withColumn("__row", F.monotonically_increasing_id()), r, ["demo_id"], time, ["round_num", "end"], "__row")
    return found.where(F.col(time) <= F.col("end")).drop("__row", "end", f"right_{time}")


def plant_sites(plants: DataFrame, ticks: DataFrame) -> DataFrame:
    """plants (demo_id, round_num, X, Y) with the nearer bombsite by the mean position of players named to be there.

    Null where a match knows fewer than two sites."""
    named = F.when(F.col("place") == "BombsiteA", "bombsite_a").when(F.col("place") == "BombsiteB", "bombsite_b")
    centres = ticks.withColumn("site", named).where("site is not null").groupBy("demo_id", "site").agg(F.avg("X").alias("cx"), F.avg("Y").alias("cy"))
    both = centres.groupBy("demo_id").agg(F.sort_array(F.collect_list(F.struct("site", "cx", "cy"))).alias("c"))  # two at most
    d = lambda i: F.hypot(F.col("X") - F.col("c")[i]["cx"], F.col("Y") - F.col("c")[i]["cy"])
    site = F.when(F.size("c") == 2, F.when(d(0) <= d(1), F.col("c")[0]["site"]).otherwise(F.col("c")[1]["site"]))
    return plants.join(both, "demo_id", "left").withColumn("bomb_site", site).drop("c")


def grenade_ends(starts: DataFrame, ends: DataFrame, seconds: float) -> DataFrame:
    """starts (demo_id, entity_id, tick) with end_tick: the entity's next expiry strictly later, if within twice the
    usual life, else the usual life. seconds: 18 for smokes, 7 for fires."""
    rows = starts.withColumn("__row", F.monotonically_increasing_id())
    life = int(seconds * TICKS)
    return temporal.lifetimes(rows, ends.select("demo_id", "entity_id", "tick"), ["demo_id", "entity_id"], "tick", "__row", 2 * life, life).drop("__row").withColumnRenamed("tick", "start_tick")


def flashes(durations: DataFrame, detonations: DataFrame) -> DataFrame:
    """Ticks at which a player's flash duration rises anew (positive and other than before), with the tick's first
    detonation (demo_id, tick, entityid, attacker_steamid) if there is one."""
    w = Window.partitionBy("demo_id", "tick").orderBy("entityid")
    first = detonations.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("demo_id", "tick", "entityid", "attacker_steamid")
    return temporal.changes(durations, ["demo_id", "steamid"], ["tick"], "blind_duration").join(first, ["demo_id", "tick"], "left")
