"""Schemas of the parsed match tables and of run outputs. Ids are longs; null means unknown or never."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "ticks": "round_num int, tick int, steamid long, name string, side string, X float, Y float, Z float, yaw float, pitch float, is_alive boolean, health smallint, armor smallint, has_helmet boolean, has_defuser boolean, spotted boolean, spotted_by array<bigint>, place string, weapon string, equip int, round_start_equip int, balance int",
    "rounds": "round_num int, freeze_end int, end int, winner string, bomb_plant int, bomb_site string",
    "kills": "tick int, round_num int, attacker_steamid long, attacker_side string, attacker_X float, attacker_Y float, attacker_Z float, attacker_spotted boolean, victim_steamid long, victim_side string, victim_X float, victim_Y float, victim_Z float, weapon string, headshot boolean, thrusmoke boolean, penetrated int, attackerblind boolean",
    "bomb": "tick int, round_num int, event string, X float, Y float",
    "smokes": "entity_id int, start_tick int, end_tick int, X float, Y float, Z float, round_num int, thrower_side string",
    "infernos": "entity_id int, start_tick int, end_tick int, X float, Y float, Z float, round_num int, thrower_side string",
    "shots": "tick int, round_num int, player_steamid long, player_side string, player_X float, player_Y float, player_Z float, weapon string, silenced boolean",
    "footsteps": "tick int, steamid long, X float, Y float, Z float, team_num int, round_num int",
    "blinds": "tick int, user_name string, user_steamid string, blind_duration float, entityid int, attacker_name string, attacker_steamid long, round_num int",
}
#: Keys that writing by match adds to every table.
KEYS = "source string, demo_id string"
META = "demo_id string, source string, file string, map_name string, server_name string, patch_version string, n_rounds int, tickrate int, sample_every int, parse_seconds double"
SPLITS = "demo_id string, split string"


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table of events that never fired."""
    return spark.createDataFrame([], f"{TABLES[table]}, {KEYS}")


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns: missing ones are null, others are dropped, types are cast (an unsigned id
    that arrives as decimal becomes a long)."""
    out = []
    for part in f"{TABLES[table]}, {KEYS}".split(", "):
        name, kind = part.split(" ", 1)
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)
