"""The whole engine in three calls: fit models from matches, score configurations on others, calibrate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import weapon_class
from ..operators import belief as b
from ..operators import documents, fitting, history, maps, reports, scoring, sight, temporal
from ..session import stored
from ..sources.store import MatchStore, write_csv

SIDES = {"t": 0, "ct": 1}
KEYS = ["demo_id", "round_num", "friendly"]


def states_of(store: MatchStore, grid: maps.Grid, demos: DataFrame | None = None) -> DataFrame:
    """Living players on the grid at every step, with region, age of the last sighting, buy and weapon class."""
    ticks, rounds = store.read("ticks", demos=demos), store.read("rounds", demos=demos).drop("source")
    play = maps.in_play(ticks.where("is_alive"), rounds, maps.STEP)
    located = maps.on_grid(play, grid).join(grid.cells.select("node", F.col("place").alias("region")), "node")
    buys = maps.team_buys(ticks, rounds)
    return maps.since_seen(located.withColumn("weapon_class", weapon_class(F.col("weapon")))).join(buys, ["demo_id", "round_num", "side"], "left")


def able(store: MatchStore, states: DataFrame) -> DataFrame:
    """The states of players who can see: those not blinded for more than 0.3 s."""
    spans = store.read("blinds").where("blind_duration > 0.3 and user_steamid is not null")
    spans = spans.select("demo_id", "round_num", F.col("user_steamid").cast("long").alias("steamid"), F.col("tick").alias("s"), (F.col("tick") + F.col("blind_duration") * maps.TICKS).alias("e"))
    return temporal.interval_join(states, spans, ["demo_id", "round_num", "steamid"], "tick", "s", "e", 4 * maps.TICKS, closed=True, how="left_anti")


def clouds(store: MatchStore, states: DataFrame, whole: bool = False) -> DataFrame:
    """(demo_id, round_num, tick, sx, sy) of smokes, from a second after their start to 1.5 before their end; whole: from
    start to end, as fits of spotting leave out all pairs that a smoke may hide."""
    bloom, fade = (0.0, 0.0) if whole else (1.0, 1.5)
    spans = store.read("smokes").select("demo_id", "round_num", F.col("X").alias("sx"), F.col("Y").alias("sy"), (F.col("start_tick") + bloom * maps.TICKS).alias("s"), (F.col("end_tick") - fade * maps.TICKS).alias("e")).where("e > s")
    ticks = states.select("demo_id", "round_num", "tick").distinct()
    return temporal.interval_join(ticks, spans, ["demo_id", "round_num"], "tick", "s", "e", 18 * maps.TICKS).select("demo_id", "round_num", "tick", "sx", "sy")


def feed_weapons(store: MatchStore) -> DataFrame:
    """(demo_id, round_num, tick, steamid, feed): the class of the dearest weapon that the kill feed showed of a player, at
    the first step at or after the kill."""
    k = store.read("kills").where("attacker_steamid is not null and attacker_side <> victim_side")
    at = k.select("demo_id", "round_num", temporal.snap_up(F.col("tick"), maps.STEP).alias("tick"), F.col("attacker_steamid").alias("steamid"), weapon_class(F.col("weapon")).alias("feed"))
    return at.groupBy("demo_id", "round_num", "tick", "steamid").agg(F.min("feed").alias("feed"))  # classes run from snipers to pistols, then others


def shown_guns(states: DataFrame, feed: DataFrame) -> DataFrame:
    """(buy, gun, p): the dearest gun (1 pistol to 4 sniper) that players of a team with this buy have shown so far, on the
    radar or in the kill feed, with one added to every count."""
    keys = ["demo_id", "round_num", "steamid"]
    known = states.select(*keys, "tick", "buy", F.when(F.col("spotted"), F.col("weapon_class")).alias("shown"))
    # a kill may come after the player's last step alive: it counts with the buy of the round
    buys = states.groupBy(*keys).agg(F.max("buy").alias("buy"))
    every = known.unionByName(feed.join(buys, keys).select(*keys, "tick", "buy", F.col("feed").alias("shown")))
    best = temporal.running_best(every, keys, ["tick"], F.lit(4) - F.col("shown"), "gun").groupBy(*keys, "tick", "buy").agg(F.max("gun").alias("gun"))
    counts = best.where("gun > 0 and buy is not null").groupBy("buy", "gun").agg(F.count("*").alias("n"))
    every = states.sparkSession.createDataFrame([(i, g) for i in range(3) for g in range(1, 5)], "buy int, gun int")
    mass = every.join(counts, ["buy", "gun"], "left").select("buy", "gun", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    return mass.select("buy", "gun", (F.col("n") / F.sum("n").over(Window.partitionBy("buy"))).alias("p"))


def fit(store: MatchStore, name: str, demos: DataFrame | None = None, only: Sequence[str] | None = None) -> None:
    """Fits and saves the parts grid, motion, library, teams, spot, fires and buys (or only some of them)."""
    todo = set(only or ("grid", "motion", "library", "teams", "spot", "fires", "buys"))
    ticks, rounds = store.read("ticks", demos=demos), store.read("rounds", demos=demos).drop("source")
    if "grid" in todo:
        play = maps.in_play(ticks.where("is_alive"), rounds)
        grid = maps.build_grid(play)
        origin = store.spark.createDataFrame([(grid.x0, grid.y0)], "x0 double, y0 double")
        store.save_model(name, {"cells": grid.cells, "edges": grid.edges, "origin": origin, "bands": maps.pixel_bands(play)})
    grid = load_grid(store, name)
    states = stored(states_of(store, grid, demos), "states")
    if "motion" in todo:
        store.save_model(name, maps.motion_tables(states, grid.cells, grid.edges))
    if "library" in todo:
        store.save_model(name, {"library": maps.trajectory_library(states)})
    if "teams" in todo:
        store.save_model(name, {"teams": maps.line_ups(states)})
    if "spot" in todo:
        smokes = clouds(store, states, whole=True).groupBy("demo_id", "tick").agg(F.collect_list(F.struct("sx", "sy")).alias("clouds"))
        views = stored(sight.pair_views(states, grid.cells, able(store, states), smokes), "views")
        store.save_model(name, {"lines": maps.sight_lines(grid.cells, store.load_part(name, "bands"), stored(sight.opened_pixels(views), "opened"))})
        lines = store.load_part(name, "lines")
        tables = sight.fit_spotting(views, lines)
        rows = [(k, i, float(v)) for k, t in enumerate(tables) for i, v in enumerate(t)]
        store.save_model(name, {"spot": store.spark.createDataFrame(rows, "tab int, bin int, value double"), "factors": sight.spot_factors(views, lines, tables)})
    if "fires" in todo:
        infernos = store.read("infernos", demos=demos)
        profile = maps.fire_profile(maps.fire_rings(maps.in_play(ticks.where("is_alive"), rounds), infernos))
        choices = maps.fire_choices(states, infernos, grid.cells, store.load_part(name, "learned"))
        step = np.ones(len(profile["occupancy"]))
        if choices.take(1):
            step = np.exp(fitting.maximise(choices, fitting.stack_likelihood(), np.zeros(len(step)), pull=1e-3, bounds=(float(np.log(0.01)), 0.0)))
        rows = [(i, float(profile["edges"][i]), float(o), float(m)) for i, (o, m) in enumerate(zip(profile["occupancy"], step, strict=True))]
        store.save_model(name, {"fires": store.spark.createDataFrame(rows, "ring int, lo double, occupancy double, step double")})
    if "buys" in todo:
        store.save_model(name, {"buys": maps.buy_priors(_situations(store, demos)), "guns": shown_guns(states, feed_weapons(store)), "rates": maps.buy_rates(_situations(store, demos))})


def _situations(store: MatchStore, demos: DataFrame | None) -> DataFrame:
    rounds = store.read("rounds", demos=demos).drop("source")
    numbered = history.round_numbers(rounds, store.read("kills", demos=demos)).join(rounds.select("demo_id", "round_num", "winner"), ["demo_id", "round_num"])
    half, place = history.half_numbers(F.col("number"))
    sides = numbered.withColumn("half", half).withColumn("hr", place).withColumn("side", F.explode(F.array(F.lit("t"), F.lit("ct")))).withColumn("won", F.col("winner") == F.col("side"))
    keys = ["demo_id", "half", "side"]
    told = history.earlier_results(history.loss_bonus(sides, keys, ["hr"], F.col("won")), keys, ["hr"], "won")
    named = told.withColumn("situation", maps.situation(F.col("half"), F.col("hr"), F.col("won_last"), F.col("won_first"), F.col("losses")))
    buys = maps.team_buys(store.read("ticks", demos=demos), rounds)
    return named.join(buys, ["demo_id", "round_num", "side"]).select("demo_id", "round_num", "side", "situation", "buy")


def load_grid(store: MatchStore, name: str) -> maps.Grid:
    cells, edges, origin = (store.load_part(name, p) for p in ("cells", "edges", "origin"))
    if cells is None:
        raise ValueError(f"no grid was fitted for {name}")
    o = origin.first()
    return maps.Grid(cells, edges, o["x0"], o["y0"])


def load(store: MatchStore, name: str, most_states: int = 5_000_000) -> tuple[b.Models, list[str], np.ndarray]:
    """The models as arrays, the names of the regions and the cells' places; parts that were not fitted are None."""
    grid = load_grid(store, name)
    cells = sorted(grid.cells.collect(), key=lambda r: r["node"])
    n = len(cells)
    if n > b.MOST_CELLS:
        raise ValueError("a map has at most MOST_CELLS cells")
    names = sorted({r["place"] for r in cells})
    region = np.array([names.index(r["place"]) for r in cells])
    part = lambda p: t.toPandas() if (t := store.load_part(name, p)) is not None else None
    walk = part("walk")
    chain = lambda rows: b.Chain(rows.node.to_numpy(), rows.next_node.to_numpy(), rows.p.to_numpy(), n)
    import pandas as pd

    chains = {}
    for (side, phase, sbin), rows in part("learned").groupby(["side", "phase", "sbin"]):
        rest = walk[~walk.node.isin(set(rows.node))]
        chains[SIDES[side], int(phase), int(sbin), -1] = chain(pd.concat([rows, rest]))
    armed = part("armed")
    if armed is not None:
        learned = part("learned")
        for (side, phase, sbin, weapon), rows in armed.groupby(["side", "phase", "sbin", "seen_weapon"]):
            plain = learned[(learned.side == side) & (learned.phase == phase) & (learned.sbin == sbin) & ~learned.node.isin(set(rows.node))]
            rest = walk[~walk.node.isin(set(rows.node) | set(plain.node))]
            chains[SIDES[side], int(phase), int(sbin), int(weapon)] = chain(pd.concat([rows, plain, rest]))
    spawn = np.full((2, n), 1.0 / n)
    for r in part("spawn").itertuples():
        spawn[SIDES[r.side], r.node] = r.p
    occupancy = {(s, p): np.full((36, n), 1.0 / n) for s in (0, 1) for p in (0, 1, 2)}
    for (side, phase, tbin), rows in part("occupancy").groupby(["side", "phase", "tbin"]):
        occupancy[SIDES[side], int(phase)][int(tbin), rows.node] = rows.p
    edges = grid.edges.toPandas()
    degree = np.bincount(edges.src, minlength=n)
    smooth = b.Chain(edges.src.to_numpy(), edges.dst.to_numpy(), 1.0 / degree[edges.src], n)
    models = b.Models(chains, chain(walk), spawn, occupancy, region, smooth)
    models.rings = b.rings_of(edges.src.to_numpy(), edges.dst.to_numpy(), n)
    models.xyz = np.array([(r["x"], r["y"], r["z"]) for r in cells], float)
    burnt = store.load_part(name, "fires")
    if burnt is not None:
        rows = sorted(burnt.collect(), key=lambda r: r["ring"])
        width = rows[1]["lo"] - rows[0]["lo"]
        models.fires = {"edges": np.array([r["lo"] for r in rows] + [rows[-1]["lo"] + width]), "occupancy": np.array([r["occupancy"] for r in rows]), "step": np.array([r["step"] for r in rows])}
    guns = part("guns")
    if guns is not None:
        models.guns = guns.sort_values(["buy", "gun"]).p.to_numpy().reshape(3, 4)
    lib = store.load_part(name, "library")
    if lib is not None:
        rows = lib.limit(most_states + 1).toPandas()
        if len(rows) > most_states:
            raise ValueError("the library exceeds most_states; fit it from fewer matches")
        place = {s: i for i, s in enumerate(rows.state)}
        models.library = b.Library(rows.node.to_numpy(), rows.side.map(SIDES).to_numpy(), rows.t.to_numpy(float), rows.phase.to_numpy(), rows.since.to_numpy(float), rows.buy.fillna(2).to_numpy(int), rows.weapon_class.to_numpy(), rows[["dX", "dY"]].to_numpy(float), np.array([place.get(s, -1) for s in rows.next]), n)
    ups = store.load_part(name, "teams")
    if ups is not None:
        models.teams = {}
        for (side, phase), rows in ups.toPandas().sort_values("clock").groupby(["side", "phase"]):
            lined = [[*(names.index(p) for p in ps), *[-1] * (5 - len(ps))] for ps in rows.places]
            models.teams[SIDES[side], int(phase)] = {"clock": rows.clock.to_numpy(float), "alive": rows.alive.to_numpy(int), "buy": rows.buy.to_numpy(int), "places": np.array(lined)}
    fitted = store.load_part(name, "calibration")
    if fitted is not None:
        models.calibration = {r["grp"]: (r["kind"], tuple(r["theta"])) for r in fitted.collect()}
    return models, names, np.array([(r["x"], r["y"]) for r in cells], float)


def episode_steps(store: MatchStore, name: str, states: DataFrame) -> DataFrame:
    """Both sides' episodes: rows of KEYS, side (the enemies'), step, t, phase and the enemies' arrays, with looks."""
    grid = load_grid(store, name)
    side = ["demo_id", "round_num", "side"]
    row = F.struct("steamid", F.when(F.col("spotted"), F.col("node")).otherwise(-1).cast("long").alias("seen"), F.col("node").cast("long").alias("true"), F.when(F.col("spotted"), F.col("weapon_class")).otherwise(-1).cast("long").alias("weapon"))
    at = states.groupBy(*side, "tick").agg(F.map_from_entries(F.collect_list(F.struct("steamid", row.alias("r")))).alias("m"))
    who = states.groupBy(*side).agg(F.array_sort(F.collect_set("steamid")).alias("who"))
    clock = states.groupBy("demo_id", "round_num", "tick").agg(F.min("t").alias("t"), F.min("phase").alias("phase"))
    steps = clock.join(who, ["demo_id", "round_num"]).join(at, [*side, "tick"], "left")
    of = lambda f: F.transform("who", lambda w: F.coalesce(F.element_at("m", w)[f], F.lit(-1)))
    friendly = F.when(F.col("side") == "t", "ct").otherwise("t")
    step = F.row_number().over(Window.partitionBy(*side).orderBy("tick")) - 1
    out = steps.select("demo_id", "round_num", friendly.alias("friendly"), F.when(F.col("side") == "t", 0).otherwise(1).alias("side"), "tick", step.alias("step"), "t", "phase", of("seen").alias("seen"), F.transform("who", lambda w: F.coalesce(F.map_contains_key("m", w), F.lit(False))).alias("alive"), of("true").alias("true"), of("weapon").alias("weapon"), "who")
    friends = states.groupBy("demo_id", "round_num", F.col("side").alias("friendly"), "tick").agg(F.count("*").cast("int").alias("friends"))
    out = out.join(friends, [*KEYS, "tick"], "left").fillna(0, ["friends"])
    out = _with_feed(store, _with_buys(store, name, _with_fires(store, out), states))
    spot, lines = store.load_part(name, "spot"), store.load_part(name, "lines")
    if spot is None or lines is None:
        return out.drop("who")
    tables = [np.array([r["value"] for r in sorted(spot.where(F.col("tab") == k).collect(), key=lambda r: r["bin"])]) for k in range(3)]
    lines = sight.with_factors(lines, store.load_part(name, "factors"))
    smokes = clouds(store, states).withColumn("friendly", F.explode(F.array(*map(F.lit, SIDES))))
    watch = sight.looks(able(store, states).withColumn("friendly", F.col("side")), grid.cells, lines, tables, [*KEYS, "tick"], smokes)
    out = _with_kills(store, out, grid, lines, tables)
    return out.join(watch, [*KEYS, "tick"], "left").drop("who")


def _with_feed(store: MatchStore, steps: DataFrame) -> DataFrame:
    """steps with feed: the classes of the weapons that the kill feed shows of the enemies at a step, -1 for none."""
    shown = feed_weapons(store).groupBy("demo_id", "round_num", "tick").agg(F.map_from_entries(F.collect_list(F.struct("steamid", "feed"))).alias("m"))
    met = steps.join(shown, ["demo_id", "round_num", "tick"], "left")
    return met.withColumn("feed", F.transform("who", lambda w: F.coalesce(F.element_at("m", w), F.lit(-1)))).drop("m")


def _with_fires(store: MatchStore, steps: DataFrame) -> DataFrame:
    """steps with fires: those burning for half a second or more."""
    spans = store.read("infernos").select("demo_id", "round_num", F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("z"), (F.col("start_tick") + 32).alias("s"), F.col("end_tick").alias("e"))
    clock = steps.select("demo_id", "round_num", "tick").distinct()
    burning = temporal.interval_join(clock, spans, ["demo_id", "round_num"], "tick", "s", "e", 7 * 64).groupBy("demo_id", "round_num", "tick").agg(F.collect_list(F.struct("x", "y", "z")).alias("fires"))
    return steps.join(burning, ["demo_id", "round_num", "tick"], "left")


def _with_buys(store: MatchStore, name: str, steps: DataFrame, states: DataFrame) -> DataFrame:
    """steps with buy_history, the chances of the enemies' buy in their situation, and buy_true, as it was."""
    priors = store.load_part(name, "buys")
    if priors is None:
        return steps
    enemy = F.when(F.col("side") == "t", "ct").otherwise("t")
    keys = ["demo_id", "round_num", "friendly"]
    told = _situations(store, None).join(priors, "situation", "left").select("demo_id", "round_num", enemy.alias("friendly"), F.col("p").alias("buy_history"))
    rates = store.load_part(name, "rates")
    overall = rates.first()["p"] if rates is not None else None
    even = F.array(*(F.lit(float(x)) for x in overall or [1.0 / 3] * 3))  # for situations that were not met
    true = states.groupBy("demo_id", "round_num", enemy.alias("friendly")).agg(F.max("buy").alias("b"))
    own = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("b") == i).cast("double"))
    found = true.join(told.dropDuplicates(keys), keys, "left").select(*keys, F.coalesce("buy_history", even).alias("buy_history"), F.when(F.col("b").isNotNull(), own).otherwise(even).alias("buy_true"))
    return steps.join(found, keys, "left")


def _with_kills(store: MatchStore, steps: DataFrame, grid: maps.Grid, lines: DataFrame, tables: Sequence[np.ndarray]) -> DataFrame:
    """steps with kills: what the kill feed says of where an enemy shot from, at the first step at or after the kill."""
    k = store.read("kills").where("attacker_steamid is not null and attacker_side <> victim_side and victim_X is not null")
    k = k.select("demo_id", "round_num", F.col("victim_side").alias("friendly"), temporal.snap_up(F.col("tick"), maps.STEP).alias("tick"), "attacker_steamid", F.col("victim_X").alias("X"), F.col("victim_Y").alias("Y"), F.col("victim_Z").alias("Z"), (F.coalesce("thrusmoke", F.lit(False)) | (F.coalesce("penetrated", F.lit(0)) > 0)).alias("obstructed"))
    keys = [*KEYS, "tick", "attacker_steamid"]
    like = sight.shooter_likelihood(maps.on_grid(k, grid).dropDuplicates(keys), grid.cells, lines, tables, keys)
    shot = steps.select(*KEYS, "tick", "who").join(like, [*KEYS, "tick"]).withColumn("e", (F.array_position("who", F.col("attacker_steamid")) - 1).cast("int")).where("e >= 0")
    return steps.join(shot.groupBy(*KEYS, "tick").agg(F.collect_list(F.struct("e", "like")).alias("kills")), [*KEYS, "tick"], "left")


def evaluate(store: MatchStore, name: str, configs: Sequence[str], demos: DataFrame | None = None) -> DataFrame:
    """Samples of all hidden enemies for the named configurations."""
    models, _, xy = load(store, name)
    states = stored(states_of(store, load_grid(store, name), demos), "states")
    known = b.configurations()
    return b.score(episode_steps(store, name, states), KEYS, models, [known[c] for c in configs], xy)


def calibrate(store: MatchStore, name: str, samples: DataFrame, model: str, kinds: Sequence[str] = ("power", "platt", "piecewise")) -> dict[str, float]:
    """Chooses a calibration map by held-out rounds, fits it by age group and saves it; the kinds' mean losses.

    samples: of evaluate() on validation matches; only enemies seen before count."""
    own = samples.where((F.col("model") == model) & F.col("since").isNotNull())
    rows = own.select("demo_id", "round_num", F.col("probs").alias("p"), F.col("true_region").alias("truth"), F.when(F.col("since") < 5, 0).when(F.col("since") < 20, 1).otherwise(2).alias("grp"))
    rows = stored(scoring.folds(rows.withColumn("cluster", F.concat_ws("|", "demo_id", "round_num")), "cluster", 2), "calibration")
    losses = fitting.choose_calibration(rows, "fold", 2, kinds)
    best = min(losses, key=losses.get)
    fitted = [] if best == "none" else [(g, best, list(fitting.fit_calibration(rows.where(F.col("grp") == g), best))) for g in range(3) if rows.where(F.col("grp") == g).take(1)]
    store.save_model(name, {"calibration": store.spark.createDataFrame(fitted, "grp int, kind string, theta array<double>")})
    return losses


def report(samples: DataFrame) -> DataFrame:
    """Metrics by model, and by model and horizon, in one table."""
    return scoring.summary(reports.with_metrics(samples), [["model"], ["model", "horizon"]], "region_rank", "p_region")


def tables(samples: DataFrame, reference: str | None = None, draws: int = 2000) -> dict[str, DataFrame]:
    """All tables of a run. Intervals are over whole rounds, both views of a round being one cluster, and paired
    differences to the reference model are on the same draws.

    summary; intervals (enemies seen before), intervals_unseen (never seen, after contact), horizons and clutches (one
    friend left, by enemies); team (moments), team_intervals (by contact), counts; contact (before and after); reliability
    and ece (enemies seen before); picks (how much of the first choice is the last place seen).
    """
    rows = reports.with_metrics(samples).withColumn("cluster", F.concat_ws("|", "demo_id", "round_num"))
    seen = rows.where(F.col("since").isNotNull())
    of = lambda df, metrics=reports.METRICS, ref=reference: scoring.intervals(df, "model", "cluster", list(metrics), ref, draws)
    at = stored(reports.moments(samples, KEYS), "moments")
    team = reports.team_table(at, KEYS).withColumn("cluster", F.concat_ws("|", "demo_id", "round_num"))
    by_contact = [of(team.where(F.col("contact") == c), ["count_brier"]).withColumn("contact", F.lit(c)) for c in (True, False)]
    aged = seen.withColumn("model", F.concat_ws("|", "model", "horizon"))
    parts = lambda df, name: df.select(F.substring_index("model", "|", 1).alias("model"), F.substring_index("model", "|", -1).alias(name), *(c for c in df.columns if c != "model"))
    reliable = stored(scoring.reliability(seen, "probs", "true_region", reports.STATED, ["model"]), "reliability")
    return {
        "summary": report(samples),
        "intervals": of(seen),
        "intervals_unseen": of(rows.where("since is null and contact")),
        "horizons": parts(of(aged, ref=None), "horizon").drop("diff", "diff_lo", "diff_hi"),
        "clutches": scoring.summary(seen.where("friends = 1"), [["model", "hidden"]], "region_rank", "p_region"),
        "team": team.drop("cluster"),
        "team_intervals": by_contact[0].unionByName(by_contact[1]),
        "counts": reports.count_table(at),
        "contact": reports.around_contact(rows, "model", F.col("contact"), F.col("region_rank"), F.col("p_region")),
        "reliability": reliable,
        "ece": scoring.calibration_error(reliable, ["model"]),
        "picks": seen.groupBy("model").agg(F.count("*").alias("n"), F.avg("picks_last").alias("picks_last")),
    }


def write_tables(samples: DataFrame, folder: str, reference: str | None = None, draws: int = 2000) -> None:
    """tables() under folder: the moments of teams as Parquet, all others, which are small, as CSV."""
    for name, df in tables(samples, reference, draws).items():
        if name == "team":
            df.write.mode("overwrite").partitionBy("model").parquet(f"{folder}/{name}")
        else:
            write_csv(df, f"{folder}/{name}")


def region_chances(looks: DataFrame, cells: DataFrame, traffic: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, region, chance): how likely someone in a region would be seen, cells counting by their traffic (node, w).
    looks: of sight.looks(); cells that nobody looks at are never seen."""
    at = cells.select("node", F.col("place").alias("region")).join(traffic, "node")
    whole = at.groupBy("region").agg(F.sum("w").alias("all"))
    each = looks.select(*keys, F.explode(F.arrays_zip(F.col("looked").alias("node"), F.col("missed").alias("miss"))).alias("x")).select(*keys, "x.node", "x.miss")
    seen = each.join(at, "node").groupBy(*keys, "region").agg(F.sum(F.col("w") * (1 - F.col("miss"))).alias("s"))
    return seen.join(whole, "region").select(*keys, "region", (F.col("s") / F.col("all")).alias("chance"))


def moment_documents(store: MatchStore, name: str, moments: DataFrame, demos: DataFrame | None = None) -> DataFrame:
    """The documents of moments (demo_id, round_num, friendly, tick) of a store, as documents.moment_documents() has them;
    what teams watch and friends look at is there if a spotting model was fitted."""
    grid = load_grid(store, name)
    rounds = store.read("rounds", demos=demos)
    wanted = moments.select("demo_id", "round_num").distinct()
    states = stored(states_of(store, grid, demos).join(wanted, ["demo_id", "round_num"], "left_semi"), "states")
    regions = grid.cells.select("node", F.col("place").alias("region"))
    locate = lambda p: maps.on_grid(p, grid).join(regions, "node").drop("node")
    k = store.read("kills", demos=demos).where("attacker_steamid is not null and victim_X is not null")
    k = k.select("demo_id", "round_num", "tick", "attacker_steamid", "attacker_side", "victim_side", (F.coalesce("thrusmoke", F.lit(False)) | (F.coalesce("penetrated", F.lit(0)) > 0)).alias("obstructed"), F.col("victim_X").alias("X"), F.col("victim_Y").alias("Y"), F.col("victim_Z").alias("Z"))
    smoke = clouds(store, states).select("demo_id", "round_num", "tick", F.col("sx").alias("X"), F.col("sy").alias("Y"), F.lit(100.0).alias("Z"))
    ticks = states.select("demo_id", "round_num", "tick").distinct()
    fire = _with_fires(store, ticks).where("fires is not null").select("demo_id", "round_num", "tick", F.explode("fires").alias("f")).select("demo_id", "round_num", "tick", F.col("f.x").alias("X"), F.col("f.y").alias("Y"), F.col("f.z").alias("Z"))
    can, watched, looks = able(store, states), None, None
    spot, lines = store.load_part(name, "spot"), store.load_part(name, "lines")
    if spot is not None and lines is not None:
        tables = [np.array([r["value"] for r in sorted(spot.where(F.col("tab") == i).collect(), key=lambda r: r["bin"])]) for i in range(3)]
        lines, traffic = sight.with_factors(lines, store.load_part(name, "factors")), states.groupBy("node").agg(F.count("*").alias("w"))
        smokes = clouds(store, states).join(ticks, ["demo_id", "round_num", "tick"])
        at = can.withColumn("friendly", F.col("side")).join(moments.select(*KEYS, "tick").distinct(), [*KEYS, "tick"], "left_semi")
        both = smokes.withColumn("friendly", F.explode(F.array(*map(F.lit, SIDES))))
        watched = region_chances(sight.looks(at, grid.cells, lines, tables, [*KEYS, "tick"], both), grid.cells, traffic, [*KEYS, "tick"])
        own = ["demo_id", "round_num", "tick", "steamid"]
        each = smokes.join(at.select(*own), ["demo_id", "round_num", "tick"])
        looks = region_chances(sight.looks(at, grid.cells, lines, tables, own, each), grid.cells, traffic, own)
    return documents.moment_documents(moments, states, rounds, locate(k), locate, locate(smoke), locate(fire), watched, can, looks)
