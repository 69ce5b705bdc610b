"""Moments as nested documents: what one team knew at a step of a round, put together from tables by equi-joins.

A moment is (demo_id, round_num, friendly, tick), friendly being the side whose view it is and tick a step. Everything about
a moment is bounded by the game: ten players, a few grenades, the kills of a round. Entries leave out what does not apply
(null fields, which to_json drops); places are readable names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import callout_name, first_and_more
from .maps import STEP, TICKS
from .temporal import snap_up

# Seconds, units a second, shares of a region, and the words of a document.
BOMB_S, ROUND_S, FEED_S, AHEAD, MOVING = 40, 115, 30, 400.0, 60.0
WATCHED, LOOKED = 0.25, 0.15
BUYS = ("eco (little or no equipment)", "force buy (partial equipment)", "full buy")
GAME = "Counter-Strike 2 on Mirage. One team's view of a round; only what that team knew."
ROUND = ["demo_id", "round_num"]
MOMENT = [*ROUND, "friendly", "tick"]


def rounded(x: Column) -> Column:
    return F.bround(x).cast("long")


def roster(states: DataFrame) -> DataFrame:
    """(demo_id, round_num, side, steamid, place, id): the players of a round, numbered within their side by steamid."""
    who = states.select(*ROUND, "side", "steamid").distinct()
    numbered = who.withColumn("place", F.row_number().over(Window.partitionBy(*ROUND, "side").orderBy("steamid")))
    return numbered.withColumn("id", F.concat(F.upper("side"), F.col("place").cast("string")))


def remembered(states: DataFrame) -> DataFrame:
    """states with last: where and when a player was last on the radar, the step included (null: never in the round), and
    how they moved a step if the step before was a sighting too."""
    w = Window.partitionBy(*ROUND, "steamid").orderBy("tick")
    before = F.lag(F.when(F.col("spotted"), F.struct("tick", "X", "Y"))).over(w)
    beside = before["tick"] == F.col("tick") - STEP
    here = F.struct("tick", "region", "X", "Y", "Z", F.when(beside, F.col("X") - before["X"]).alias("vx"), F.when(beside, F.col("Y") - before["Y"]).alias("vy"))
    return states.withColumn("__here", F.when(F.col("spotted"), here)).withColumn("last", F.last("__here", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__here")


def enemy_entries(moments: DataFrame, states: DataFrame, locate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(MOMENT, enemies): an entry for each enemy of a round, in order of their numbers. locate: rows with X, Y, Z to the same
    with region."""
    enemy = F.when(F.col("friendly") == "t", "ct").otherwise("t")
    asked = moments.select(*MOMENT, enemy.alias("side")).join(roster(states), [*ROUND, "side"])
    known = remembered(states).select(*ROUND, "steamid", "tick", "spotted", "region", "last")
    rows = asked.join(known, [*ROUND, "steamid", "tick"], "left")
    speed = F.hypot("last.vx", "last.vy")
    rows = rows.withColumn("speed", speed * TICKS / STEP)
    moving = (F.col("speed") >= MOVING) & ~F.col("spotted")
    ahead = [(F.col(f"last.{c}") + F.col(f"last.v{c.lower()}") / speed * AHEAD).alias(c) for c in ("X", "Y")]
    points = rows.where(moving).select(*MOMENT, "steamid", *ahead, F.col("last.Z").alias("Z"))
    toward = locate(points).select(*MOMENT, "steamid", F.col("region").alias("toward"))
    rows = rows.join(toward, [*MOMENT, "steamid"], "left")
    at, then = callout_name(F.col("region")), callout_name(F.col("last.region"))
    status = F.when(F.col("spotted").isNull(), "dead").when(F.col("spotted"), "on your radar now").when(F.col("last").isNull(), "not seen yet this round").otherwise("off your radar")
    off = status == "off your radar"
    when = F.when(F.col("speed") < MOVING, "holding still").when(F.col("toward") != F.col("last.region"), F.concat(F.lit("moving toward "), callout_name(F.col("toward")))).when(F.col("toward").isNotNull(), F.concat(F.lit("moving within "), then))
    entry = F.struct(
        "id", status.alias("status"), F.when(F.col("spotted"), at).alias("at"), F.when(off, then).alias("last_seen_at"),
        F.when(off, rounded((F.col("tick") - F.col("last.tick")) / TICKS)).alias("seconds_since_seen"), F.when(off, when).alias("when_last_seen"),
    )
    return _listed(rows, entry.alias("e"), "enemies")


def _listed(rows: DataFrame, entry: Column, name: str, order: str = "place") -> DataFrame:
    each = rows.select(*MOMENT, F.struct(F.col(order).alias("o"), entry).alias("x"))
    return each.groupBy(*MOMENT).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias(name))  # a handful


def teammate_entries(moments: DataFrame, states: DataFrame, able: DataFrame | None = None, looks: DataFrame | None = None) -> DataFrame:
    """(MOMENT, teammates): the living friends: place, and flashed or where they look: the region that they would see someone
    in best, other than their own. able: the states (steamid, tick) of those who can see; looks: (demo_id, round_num, tick,
    steamid, region, chance)."""
    rows = moments.select(*MOMENT, F.col("friendly").alias("side")).join(roster(states), [*ROUND, "side"]).join(states.select(*ROUND, "steamid", "tick", "region"), [*ROUND, "steamid", "tick"])
    blind, looking = F.lit(False), F.lit(None).cast("string")
    if able is not None:
        rows = rows.join(able.select(*ROUND, "steamid", "tick", F.lit(True).alias("__able")), [*ROUND, "steamid", "tick"], "left")
        blind = F.col("__able").isNull()
    if looks is not None:
        own = states.select(*ROUND, "steamid", "tick", F.col("region").alias("__own"))
        best = looks.where("region <> 'Unknown'").join(own, [*ROUND, "steamid", "tick"]).where("region <> __own").groupBy(*ROUND, "steamid", "tick").agg(F.max(F.struct("chance", "region")).alias("b"))
        rows = rows.join(best, [*ROUND, "steamid", "tick"], "left")
        looking = F.when(F.col("b.chance") >= LOOKED, callout_name(F.col("b.region"))).otherwise("a nearby wall or corner")
    entry = F.struct("id", callout_name(F.col("region")).alias("at"), F.when(blind, "flashed (blind)").alias("status"), F.when(~blind, looking).alias("looking_toward"))
    return _listed(rows, entry.alias("e"), "teammates")


def feed_entries(moments: DataFrame, kills: DataFrame, states: DataFrame) -> DataFrame:
    """(MOMENT, feed): kills by enemies in the last half minute, oldest first. kills: demo_id, round_num, tick,
    attacker_steamid, attacker_side, victim_side, obstructed, region (of the victim)."""
    enemy = F.when(F.col("friendly") == "t", "ct").otherwise("t")
    k = kills.where("attacker_side <> victim_side").select(*ROUND, snap_up(F.col("tick"), STEP).alias("__at"), F.col("attacker_steamid").alias("steamid"), F.col("attacker_side").alias("side"), "obstructed", "region")
    met = moments.select(*MOMENT, enemy.alias("side")).join(k, [*ROUND, "side"]).where((F.col("__at") <= F.col("tick")) & (F.col("tick") - F.col("__at") <= FEED_S * TICKS))
    named = met.join(roster(states).select(*ROUND, "steamid", "id"), [*ROUND, "steamid"])
    entry = F.struct(rounded((F.col("tick") - F.col("__at")) / TICKS).alias("seconds_ago"), F.col("id").alias("killer"), callout_name(F.col("region")).alias("victim_was_at"), F.when(F.col("obstructed"), "through smoke or a wall").alias("note"))
    return _listed(named, entry.alias("e"), "feed", "__at")


def bomb_text(tick: Column, freeze_end: Column, plant: Column, site: Column) -> Column:
    """The bomb in words; a plant counts from the first step at or after it."""
    planted = plant.isNotNull() & (tick >= plant)
    ago = (tick - snap_up(plant, STEP)) / TICKS
    letter = F.when(site == "bombsite_b", "B").otherwise("A")
    left = F.greatest(ROUND_S - (tick - freeze_end) / TICKS, F.lit(0.0))
    return F.when(planted, F.concat(F.lit("planted on "), letter, F.lit(" site "), rounded(ago).cast("string"), F.lit(" s ago (explodes in "), rounded(BOMB_S - ago).cast("string"), F.lit(" s)"))).otherwise(
        F.concat(F.lit("not planted ("), rounded(left).cast("string"), F.lit(" s of round time left)"))
    )


def places(moments: DataFrame, grenades: DataFrame, name: str) -> DataFrame:
    """(MOMENT, name): the sorted places of grenades (demo_id, round_num, tick, region) that work at the step."""
    met = moments.select(*MOMENT).join(grenades.select(*ROUND, "tick", "region"), [*ROUND, "tick"])
    return met.groupBy(*MOMENT).agg(F.array_sort(F.collect_set(callout_name(F.col("region")))).alias(name))


def moment_documents(
    moments: DataFrame, states: DataFrame, rounds: DataFrame, kills: DataFrame, locate: Callable[[DataFrame], DataFrame],
    smokes: DataFrame | None = None, fires: DataFrame | None = None, watched: DataFrame | None = None, able: DataFrame | None = None, looks: DataFrame | None = None,
) -> DataFrame:
    """(MOMENT, state): one struct a moment. watched: (MOMENT, region, chance) that an enemy there would be seen now."""
    none = F.array(F.lit("none"))
    moments = moments.select(*MOMENT).distinct()
    alive = states.groupBy(*ROUND, "tick").agg(*(F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("t", "ct")), *(F.max(F.when(F.col("side") == s, F.col("buy"))).alias(f"buy_{s}") for s in ("t", "ct")))
    out = moments.join(alive, [*ROUND, "tick"]).join(rounds.select(*ROUND, "freeze_end", "bomb_plant", "bomb_site"), ROUND)
    for part in (enemy_entries(moments, states, locate), teammate_entries(moments, states, able, looks), feed_entries(moments, kills, states)):
        out = out.join(part, MOMENT, "left")
    for name, table in (("smokes", smokes), ("fires", fires)):
        out = out.join(places(moments, table, name), MOMENT, "left") if table is not None else out.withColumn(name, F.lit(None).cast("array<string>"))
    if watched is not None:
        seen = watched.where((F.col("chance") >= WATCHED) & (F.col("region") != "Unknown"))
        out = out.join(seen.groupBy(*MOMENT).agg(F.array_sort(F.collect_set(callout_name(F.col("region")))).alias("watching")), MOMENT, "left")
    else:
        out = out.withColumn("watching", F.lit(None).cast("array<string>"))
    own = lambda a, b: F.when(F.col("friendly") == "t", F.col(a)).otherwise(F.col(b))
    kind = own("buy_ct", "buy_t")
    feed = F.to_json(F.col("feed"))
    state = F.struct(
        F.lit(GAME).alias("game"), F.upper("friendly").alias("your_team"), rounded((F.col("tick") - F.col("freeze_end")) / TICKS).alias("seconds_into_round"),
        bomb_text(F.col("tick"), F.col("freeze_end"), F.col("bomb_plant"), F.col("bomb_site")).alias("bomb"),
        F.struct(own("t", "ct").alias("your_team"), own("ct", "t").alias("enemies")).alias("players_alive"),
        F.get(F.array(*map(F.lit, BUYS)), kind).alias("enemy_team_buy"), F.col("teammates").alias("your_teammates"),
        F.coalesce("watching", none).alias("callouts_your_team_is_watching"), "enemies", F.col("feed").alias("recent_kill_feed"),
        F.when(feed.isNull(), "no recent kills by enemies").alias("no_recent_kills"),
        F.coalesce("smokes", none).alias("smokes_active_at"), F.coalesce("fires", none).alias("molotovs_burning_at"),
    )
    return out.select(*MOMENT, state.alias("state"))


def neighbours(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(region, text): the readable names of the regions that a region connects to, in words."""
    at = lambda node, name: cells.select(F.col("node").alias(node), F.col("place").alias(name))
    met = edges.select("src", "dst").join(at("src", "a"), "src").join(at("dst", "b"), "dst").where("a <> b and a <> 'Unknown' and b <> 'Unknown'")
    listed = met.groupBy(F.col("a").alias("region")).agg(F.array_sort(F.collect_set(callout_name(F.col("b")))).alias("n"))
    every = cells.where("place <> 'Unknown'").select(F.col("place").alias("region")).distinct().join(listed, "region", "left")
    return every.select(callout_name(F.col("region")).alias("region"), F.concat(F.lit("Connects to: "), F.coalesce(F.array_join("n", ", "), F.lit("nothing listed")), F.lit(".")).alias("text"))


def requests(documents: DataFrame, connected: DataFrame, instructions: str = "Where is {label} now?") -> DataFrame:
    """(key, MOMENT, state, questions): one request a moment, with a question for each enemy off the radar, whose criteria
    are all regions with what they connect to (neighbours(), a map's regions: one row is broadcast)."""
    criteria = connected.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "text")))).alias("criteria"))
    hidden = F.filter("state.enemies", lambda e: e["status"] == "off your radar")
    head, _, tail = instructions.partition("{label}")
    question = lambda e: F.struct(e["id"].alias("key"), F.struct(F.lit("choice").alias("type"), F.concat(F.lit(head), e["id"], F.lit(tail)).alias("instructions"), F.col("criteria").alias("criteria")).alias("value"))
    asked = documents.where(F.size(hidden) > 0).join(F.broadcast(criteria), F.lit(True))
    return asked.select(F.concat_ws("|", "demo_id", "friendly", "round_num", "tick").alias("key"), *MOMENT, "state", F.map_from_entries(F.transform(hidden, question)).alias("questions"))


def with_reach(documents: DataFrame, seconds: DataFrame, most: int = 12) -> DataFrame:
    """(MOMENT, id, could_have_reached): the regions an enemy off the radar could have run to since the last sighting, by
    name, and how many more. seconds: (region, to, seconds) of running between readable regions."""
    e = documents.select(*MOMENT, F.explode("state.enemies").alias("e")).where("e.status = 'off your radar'")
    met = e.join(seconds, F.col("e.last_seen_at") == F.col("region")).where(F.col("seconds") <= F.col("e.seconds_since_seen") + 1)
    return met.groupBy(*MOMENT, F.col("e.id").alias("id")).agg(first_and_more(F.collect_list("to"), most).alias("could_have_reached"))
