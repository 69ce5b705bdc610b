"""Columns of parsed tables that can be made anew from events alone, without reading whole recordings again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest
from .store import MatchStore

#: Usual life of a grenade's effect in seconds, by table.
LIVES = {"smokes": 18.0, "infernos": 7.0}


def refresh_grenade_ends(store: MatchStore, expiries: DataFrame, demos: DataFrame | None = None) -> None:
    """End ticks of smokes and fires, from expiry events (table, demo_id, entity_id, tick)."""
    for table, seconds in LIVES.items():
        own = expiries.where(F.col("table") == table).select("demo_id", "entity_id", "tick")
        store.refresh(table, lambda rows, own=own, s=seconds: ingest.grenade_ends(rows.drop("end_tick").withColumnRenamed("start_tick", "tick"), own, s), demos)


def refresh_blinds(store: MatchStore, durations: DataFrame, detonations: DataFrame, demos: DataFrame | None = None) -> None:
    """Who was blinded when and by whom, from flash durations (source, demo_id, steamid, name, tick, blind_duration) and
    detonations (demo_id, tick, entityid, attacker_steamid): the matches' blinds are replaced."""
    found = ingest.flashes(durations, detonations)
    rounds = store.read("rounds", demos=demos).select("demo_id", "round_num", "freeze_end", "end")
    rows = ingest.with_round(found, rounds).withColumn("user_steamid", F.col("steamid").cast("string")).withColumnRenamed("name", "user_name")
    store.write("blinds", rows if demos is None else rows.join(demos.select("demo_id"), "demo_id", "left_semi"))
