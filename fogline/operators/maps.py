"""Maps and models from parsed positions: grid, regions, sight, motion, library, line-ups, economy, fires.

Everything up to the fitted tables is relational and scales with the events; the tables themselves are a map's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins
from ..session import stored
from . import counting, graph, temporal

# Fixed values of the game's clock and of the grid.
TICKS, STEP, COLUMN, RISE, FLOOR_GAP, LEAST_SAMPLES, STAND, PIXEL = 64, 16, 64.0, 48.0, 110.0, 8, 32.0, 16.0
BUYS = ("eco", "force", "full")


def in_play(ticks: DataFrame, rounds: DataFrame, every: int = 1) -> DataFrame:
    """Living players' ticks between freeze end and round end (both included), with seconds and phase."""
    r = rounds.select("demo_id", "round_num", "freeze_end", "end", "bomb_plant", "bomb_site")
    t = ticks.where(F.pmod("tick", F.lit(every)) == 0).join(r, ["demo_id", "round_num"]).where(F.col("tick").between(F.col("freeze_end"), F.col("end")))
    phase = F.when(F.col("bomb_plant").isNull() | (F.col("tick") < F.col("bomb_plant")), 0).when(F.col("bomb_site") == "bombsite_b", 2).otherwise(1)
    return t.withColumn("t", (F.col("tick") - F.col("freeze_end")) / TICKS).withColumn("phase", phase)


def columns(x: Column, y: Column, x0: float, y0: float) -> tuple[Column, Column]:
    return F.floor((x - x0) / COLUMN).cast("int"), F.floor((y - y0) / COLUMN).cast("int")


@dataclass
class Grid:
    """Cells (node, cx, cy, floor, z, place, x, y) and their edges (src, dst, length)."""

    cells: DataFrame
    edges: DataFrame
    x0: float
    y0: float


def build_grid(positions: DataFrame, least: int = LEAST_SAMPLES) -> Grid:
    """positions: demo_id, round_num, steamid, tick, X, Y, Z, place of living players.

    Columns of 64 units with up to three floors; cells are named by the most frequent place; edges are moves seen twice
    and neighbours of nearly the same height; the largest component is kept and numbered.
    """
    low = positions.agg(F.min("X").alias("x"), F.min("Y").alias("y")).first()
    x0, y0 = (float(np.floor((low[c] - 256) / COLUMN) * COLUMN) for c in ("x", "y"))
    cx, cy = columns(F.col("X"), F.col("Y"), x0, y0)
    p = positions.withColumn("cx", cx).withColumn("cy", cy)
    floors = counting.floors(p, ["cx", "cy"], "Z", FLOOR_GAP, least).select("cx", "cy", "floor", F.col("height").alias("z"))
    cells = floors.withColumn("node", (F.col("cx").cast("long") * 100_000 + F.col("cy")) * 4 + F.col("floor"))
    at = locate(p, cells)
    moved = temporal.moves(at.where("node is not null"), ["demo_id", "round_num", "steamid"], ["tick"], "tick", "node", most=STEP)
    ends = moved.where("node <> next_node").groupBy("node", "next_node").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("node").alias("src"), F.col("next_node").alias("dst"))
    short = ends.join(cells.select(F.col("node").alias("src"), F.col("cx").alias("ax"), F.col("cy").alias("ay")), "src").join(cells.select(F.col("node").alias("dst"), F.col("cx").alias("bx"), F.col("cy").alias("by")), "dst")
    short = short.where(F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by")) <= 3).select("src", "dst")
    edges = graph.symmetric(short.union(graph.offset_neighbours(cells, "cx", "cy", "z", "node", RISE)))
    numbered, edges = graph.reindexed(graph.largest_component(edges), edges)
    named = counting.majority(at.where("node is not null").select("node", "place"), "node", "place")
    middle = at.groupBy("node").agg(F.avg("X").alias("x"), F.avg("Y").alias("y"))
    cells = cells.join(numbered, "node").join(named, "node").join(middle, "node").select(F.col("index").alias("node"), "cx", "cy", "floor", "z", "place", "x", "y")
    cells = representative_points(cells, pixel_bands(positions), x0, y0)
    a = cells.select(F.col("node").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = cells.select(F.col("node").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    length = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by"), F.lit(2)) + F.pow(F.col("az") - F.col("bz"), F.lit(2)))
    return Grid(cells, edges.join(a, "src").join(b, "dst").select("src", "dst", length.alias("length")), x0, y0)


def locate(positions: DataFrame, cells: DataFrame) -> DataFrame:
    """positions (with cx, cy, Z) with the node of the highest floor at or below Z + 32, else the column's lowest; null
    where the column has no cell."""
    stacks = cells.groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.struct("z", "node"))).alias("__stack"))  # three floors at most
    joined = positions.join(stacks, ["cx", "cy"], "left")
    below = F.filter("__stack", lambda c: c["z"] <= F.col("Z") + STAND)
    node = F.when(F.size(below) > 0, F.element_at(below, -1)["node"]).otherwise(F.element_at("__stack", 1)["node"])
    return joined.withColumn("node", F.when(F.col("__stack").isNotNull(), node)).drop("__stack")


def nearest_cells(missed: DataFrame, grid: Grid, most_cells: int = 20_000) -> DataFrame:
    """missed (with X, Y, Z) with the nearest cell, heights counting double; a map's cells (checked) go to every task."""
    table = grid.cells.select("node", "x", "y", "z").limit(most_cells + 1).toArrow()
    if len(table) > most_cells:
        raise ValueError("a map has at most most_cells cells")
    nodes, xyz = table["node"].to_numpy(), np.stack([table[c].to_numpy().astype(float) for c in ("x", "y", "z")], 1) * (1, 1, 2)

    @F.arrow_udf("long")
    def nearest(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        q = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y, z)], 1) * (1, 1, 2)
        best = np.concatenate([((q[i : i + 256, None] - xyz[None]) ** 2).sum(2).argmin(1) for i in range(0, len(q), 256)]) if len(q) else np.zeros(0, int)
        return pa.array(nodes[best].astype(np.int64))

    return missed.withColumn("node", nearest("X", "Y", "Z"))


def on_grid(positions: DataFrame, grid: Grid) -> DataFrame:
    cx, cy = columns(F.col("X"), F.col("Y"), grid.x0, grid.y0)
    found = locate(positions.withColumn("cx", cx).withColumn("cy", cy), grid.cells.select("cx", "cy", "z", "node"))
    hit, miss = found.where("node is not null"), found.where("node is null").drop("node")
    return hit.unionByName(nearest_cells(miss, grid)).drop("cx", "cy")


# -- motion ---------------------------------------------------------------------------------------------------------


def since_seen(ticks: DataFrame) -> DataFrame:
    """ticks with since: seconds since the player was last on the radar (null: never in the round); and seen_weapon, the
    weapon class shown then, where ticks have a weapon_class."""
    keys = ["demo_id", "round_num", "steamid"]
    if "weapon_class" in ticks.columns:
        ticks = temporal.forward_fill(ticks, keys, ["tick"], F.col("weapon_class"), F.col("spotted"), "seen_weapon")
    seen = temporal.forward_fill(ticks, keys, ["tick"], F.col("tick"), F.col("spotted"), "seen_tick")
    return seen.withColumn("since", (F.col("tick") - F.col("seen_tick")) / TICKS).drop("seen_tick")


def motion_tables(states: DataFrame, cells: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Chains, spawn and occupancy. states: demo_id, round_num, steamid, side, tick, t, phase, since, node.

    walk: stay with the empirical rate, else a uniform neighbour; base: counts by side and phase plus half the walk;
    learned: counts by age bin as well, drawn to base with the weight of four moves; armed (if states have a
    seen_weapon): counts by the weapon class last shown as well, drawn to learned with the weight of four moves.
    """
    moves = temporal.moves(states, ["demo_id", "round_num", "steamid"], ["tick"], "tick", "node", exact=STEP)
    moves = moves.withColumn("sbin", bins.since_bin(F.col("since")))
    stays = moves.groupBy("node").agg(F.avg((F.col("node") == F.col("next_node")).cast("double")).alias("stay"))
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("next_node"))
    walk = counting.random_walk(links, cells.select("node").join(stays, "node", "left").fillna(0.0, ["stay"]), "node", "next_node")
    base_counts = counting.transitions(moves, ["side", "phase"], "node", "next_node")
    base = counting.shrunk(base_counts, walk, ["side", "phase"], "node", "next_node", 0.5)
    fine = counting.transitions(moves, ["side", "phase", "sbin"], "node", "next_node")
    rows = fine.select("side", "phase", "sbin", "node").distinct()
    prior = rows.join(base.withColumnRenamed("p", "prior"), ["side", "phase", "node"])
    both = prior.join(fine, ["side", "phase", "sbin", "node", "next_node"], "full").fillna(0, ["n", "prior"]).withColumn("mass", F.col("n") + 4 * F.col("prior"))
    learned = counting.row_share(both, ["side", "phase", "sbin", "node"], "mass").select("side", "phase", "sbin", "node", "next_node", "p")
    armed = {}
    if "seen_weapon" in states.columns:
        arms = ["side", "phase", "sbin", "seen_weapon"]
        shown = counting.transitions(moves.where("seen_weapon is not null"), arms, "node", "next_node")
        own = shown.select(*arms, "node").distinct().join(learned.withColumnRenamed("p", "prior"), ["side", "phase", "sbin", "node"])
        mass = own.join(shown, [*arms, "node", "next_node"], "full").fillna(0, ["n", "prior"]).withColumn("mass", F.col("n") + 4 * F.col("prior"))
        armed["armed"] = counting.row_share(mass, [*arms, "node"], "mass").select(*arms, "node", "next_node", "p")
    first = states.groupBy("demo_id", "round_num", "steamid").agg(F.min_by(F.struct("side", "node"), "tick").alias("s")).select("s.*")
    spawn = counting.smoothed_share(first.groupBy("side", "node").agg(F.count("*").alias("n")), cells, ["side"], "node", 1e-3)
    timed = states.withColumn("tbin", bins.fixed_bin(F.col("t"), 5.0, 36)).groupBy("side", "phase", "tbin", "node").agg(F.count("*").alias("n"))
    occupancy = counting.smoothed_share(timed, cells, ["side", "phase", "tbin"], "node", 0.01)
    return {"walk": walk, "base": base, "learned": learned, "spawn": spawn, "occupancy": occupancy, **armed}


def trajectory_library(states: DataFrame) -> DataFrame:
    """Recorded states with their next state and velocity. states also has X, Y, weapon_class and buy."""
    keys = ["demo_id", "round_num", "steamid"]
    w = Window.partitionBy(*keys).orderBy("tick")
    sid = F.concat_ws("|", *keys, "tick")
    moved = temporal.displacement(states, keys, ["tick"], "tick", ["X", "Y"], STEP)
    near = F.lead("tick").over(w) - F.col("tick") == STEP
    return moved.select(sid.alias("state"), F.when(near, F.concat_ws("|", *keys, F.lead("tick").over(w))).alias("next"), "side", "node", "t", "phase", "since", "buy", "weapon_class", "dX", "dY")


def line_ups(states: DataFrame, every_s: float = 2.0) -> DataFrame:
    """Team snapshots: sorted regions of the living players of a side every two seconds. states has region and buy."""
    snap = states.where(F.pmod("tick", F.lit(int(every_s * TICKS))) == 0)
    planted = F.min(F.when(F.col("phase") > 0, F.col("t"))).over(Window.partitionBy("demo_id", "round_num"))
    clock = F.when(F.col("phase") > 0, F.col("t") - planted).otherwise(F.col("t"))
    grouped = snap.withColumn("clock", clock).groupBy("demo_id", "round_num", "side", "tick", "phase", "clock").agg(F.slice(F.array_sort(F.collect_list("region")), 1, 5).alias("places"), F.count("*").alias("alive"), F.max(F.coalesce("buy", F.lit(2))).alias("buy"))
    return grouped.withColumn("alive", F.least("alive", F.lit(5)))


def team_buys(ticks: DataFrame, rounds: DataFrame) -> DataFrame:
    """(demo_id, round_num, side, buy) from all players' mean equipment at the round's first sample in play."""
    t = ticks.join(rounds.select("demo_id", "round_num", "freeze_end", "end"), ["demo_id", "round_num"]).where(F.col("tick").between(F.col("freeze_end"), F.col("end")))
    first = t.groupBy("demo_id", "round_num").agg(F.min("tick").alias("tick"))
    means = t.join(first, ["demo_id", "round_num", "tick"]).groupBy("demo_id", "round_num", "side").agg(F.avg("equip").alias("equip"))
    return means.select("demo_id", "round_num", "side", bins.buy_class(F.col("equip")).alias("buy"))


# -- economy --------------------------------------------------------------------------------------------------------


def situation(half: Column, half_round: Column, won_last: Column, won_first: Column, losses: Column) -> Column:
    """The economic situation that a round's history puts a team in. Its names are fixed values, by which priors are kept."""
    return (
        F.when(half > 2, "overtime")
        .when(half_round == 1, "pistol round")
        .when((half_round == 2) & won_last, "after winning the pistol round")
        .when(half_round == 2, "after losing the pistol round")
        .when(won_last, "after a win")
        .when((half_round == 3) & won_first, "lost round 2 after winning the pistol round")
        .when(half_round == 3, "lost the pistol round and round 2")
        .otherwise(F.format_string("after a loss, loss count %d", F.least(losses, F.lit(4))))
    )


def buy_priors(situations: DataFrame, add: float = 3.0) -> DataFrame:
    """(situation, p array over BUYS): counts plus three rounds at the overall rates."""
    each = [F.count(F.when(F.col("buy") == b, 1)) for b in range(len(BUYS))]
    overall = situations.agg(*(c.alias(f"b{i}") for i, c in enumerate(each)), F.count("*").alias("n")).first()
    n = max(overall["n"], 1)
    total = F.count("*") + add
    return situations.groupBy("situation").agg(F.array(*((c + add * overall[f"b{i}"] / n) / total for i, c in enumerate(each))).alias("p"))


def buy_rates(situations: DataFrame) -> DataFrame:
    """(p): the overall rates of BUYS, for situations that were never met; one row, null without rounds."""
    return situations.agg(F.array(*(F.avg((F.col("buy") == b).cast("double")) for b in range(len(BUYS)))).alias("p")).select(F.when(F.get("p", F.lit(0)).isNotNull(), F.col("p")).alias("p"))


# -- sight ----------------------------------------------------------------------------------------------------------


def pixel_bands(positions: DataFrame, size: float = PIXEL) -> DataFrame:
    """(px, py, n, lo, hi): how often anyone was in a fine pixel, its lowest floor, and the one above: the least height more
    than FLOOR_GAP above the lowest; lo where there is none."""
    at = positions.select(F.floor(F.col("X") / size).cast("int").alias("px"), F.floor(F.col("Y") / size).cast("int").alias("py"), F.col("Z").cast("double").alias("z"))
    heights = at.groupBy("px", "py", "z").agg(F.count("*").alias("n"))
    lowest = heights.groupBy("px", "py").agg(F.min("z").alias("lo"))
    upper = F.min(F.when(F.col("z") > F.col("lo") + FLOOR_GAP, F.col("z")))
    return heights.join(lowest, ["px", "py"]).groupBy("px", "py").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.coalesce(upper, F.min("lo")).alias("hi"))


def representative_points(cells: DataFrame, bands: DataFrame, x0: float, y0: float, size: float = PIXEL) -> DataFrame:
    """cells (node, cx, cy, x, y: the mean position) with x and y at the middle of the nearest pixel of their column that
    anyone walked on, as a mean may lie inside a wall; the first one by rows among equals. A column has 16 pixels."""
    middle = lambda p: (F.col(p) + 0.5) * size
    walked = bands.select(F.floor((F.col("px") * size - x0) / COLUMN).cast("int").alias("cx"), F.floor((F.col("py") * size - y0) / COLUMN).cast("int").alias("cy"), "px", "py", middle("px").alias("__x"), middle("py").alias("__y"))
    far = F.pow(F.col("__x") - F.col("x"), F.lit(2)) + F.pow(F.col("__y") - F.col("y"), F.lit(2))
    near = cells.select("node", "cx", "cy", "x", "y").join(walked, ["cx", "cy"]).groupBy("node").agg(F.min_by(F.struct("__x", "__y"), F.struct(far, "py", "px")).alias("__at"))
    found = cells.join(near, "node", "left")
    return found.select(*(F.coalesce(f"__at.__{c}", c).alias(c) if c in ("x", "y") else F.col(c) for c in cells.columns))


def ray_samples(rays: DataFrame, size: float = PIXEL, step: float = 8.0, skip: float = 20.0) -> DataFrame:
    """rays (ax, ay, az, bx, by, bz and other columns) by sample: px, py and z of points at equal steps of some 8 units,
    but for those within 20 of an end; a row of nulls for a ray without any."""
    far = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    n = F.greatest(F.ceil(F.col("__far") / step), F.lit(1)).cast("int")
    along = F.col("__far") * F.col("__t")
    kept = [c for c in rays.columns if c not in ("ax", "ay", "az", "bx", "by", "bz")]
    inside = lambda i: (i / F.col("__n") * F.col("__far") > skip) & (F.col("__far") - i / F.col("__n") * F.col("__far") > skip)
    places = F.when(F.col("__n") > 1, F.filter(F.sequence(F.lit(1), F.col("__n") - 1), inside)).otherwise(F.array().cast("array<int>"))
    s = rays.withColumn("__far", far).withColumn("__n", n).withColumn("__i", F.explode_outer(places)).withColumn("__t", F.col("__i") / F.col("__n"))
    on = lambda c: F.col(f"a{c}") + F.col("__t") * (F.col(f"b{c}") - F.col(f"a{c}"))
    return s.select(*kept, F.floor(on("x") / size).cast("int").alias("px"), F.floor(on("y") / size).cast("int").alias("py"), on("z").alias("z"))


def clear_rays(rays: DataFrame, keys: Sequence[str], bands: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """(keys, walk, carve): whether a ray is free. It is blocked where nobody ever walked, where the ground rises into it,
    or by the slab under an upper floor (walk); opened pixels (px, py, low, high), which real sightings crossed, do not
    block at such heights (carve)."""
    ground = bands.select("px", "py", "lo", "hi")
    if opened is None:
        pixels = ground.select("*", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    else:
        pixels = ground.join(opened.select("px", "py", "low", "high"), ["px", "py"], "full")
    z = F.col("z")
    slab = (F.col("hi") - F.col("lo") > FLOOR_GAP) & (z > F.col("hi") - 40) & (z < F.col("hi") + 4)
    solid = z.isNotNull() & (F.col("lo").isNull() | (F.col("lo") > z - 8) | slab)
    through = F.coalesce((F.col("low") <= z + 16) & (z <= F.col("high") + 96), F.lit(False))
    met = ray_samples(rays.select(*keys, "ax", "ay", "az", "bx", "by", "bz")).join(pixels, ["px", "py"], "left")
    return met.groupBy(*keys).agg((~F.bool_or(solid)).alias("walk"), (~F.bool_or(solid & ~through)).alias("carve"))


def sight_lines(cells: DataFrame, bands: DataFrame, opened: DataFrame | None = None, reach: float = 4500.0, eye: float = 64.0) -> DataFrame:
    """(a, b, walk, carve): pairs of cells with a free ray from eye to eye, both directions and each cell with itself.
    Cells meet through squares as large as the reach."""
    square = lambda c: F.floor(F.col(c) / reach)
    at = lambda n, p: cells.select(F.col("node").cast("long").alias(n), F.col("x").cast("double").alias(f"{p}x"), F.col("y").cast("double").alias(f"{p}y"), (F.col("z") + eye).cast("double").alias(f"{p}z"))
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    a = at("a", "a").withColumn("sx", square("ax")).withColumn("sy", square("ay"))
    b = at("b", "b").withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumn("sx", square("bx") + F.col("dx")).withColumn("sy", square("by") + F.col("dy")).drop("dx", "dy")
    rays = a.join(b, ["sx", "sy"]).where((F.col("a") < F.col("b")) & (F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) <= reach))
    half = stored(clear_rays(rays, ["a", "b"], bands, opened).where("carve"), "rays")
    own = cells.select(F.col("node").cast("long").alias("a"), F.col("node").cast("long").alias("b"), F.lit(True).alias("walk"), F.lit(True).alias("carve"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "walk", "carve")).unionByName(own)


# -- fires ----------------------------------------------------------------------------------------------------------


def fire_rings(positions: DataFrame, fires: DataFrame, width: float = 20.0, rings: int = 14, height: float = 100.0, spread: float = 0.5, gap: float = 1.0) -> DataFrame:
    """(ring, during, after, occupancy): players by distance to a fire while it burns and in a window of equal length
    from a second after its end. positions: demo_id, round_num, tick, X, Y, Z."""
    burning = fires.select("demo_id", "round_num", F.col("X").alias("fx"), F.col("Y").alias("fy"), F.col("Z").alias("fz"), (F.col("start_tick") + spread * TICKS).alias("s"), F.col("end_tick").alias("e"))
    spans = burning.withColumn("during", F.lit(True)).unionByName(burning.select("demo_id", "round_num", "fx", "fy", "fz", (F.col("e") + gap * TICKS).alias("s"), (2 * F.col("e") + gap * TICKS - F.col("s")).alias("e"), F.lit(False).alias("during")))
    met = temporal.interval_join(positions, spans, ["demo_id", "round_num"], "tick", "s", "e", 7 * TICKS)
    ring = F.floor(F.hypot(F.col("X") - F.col("fx"), F.col("Y") - F.col("fy")) / width).cast("int")
    near = met.withColumn("ring", ring).where((F.col("ring") < rings) & (F.abs(F.col("Z") - F.col("fz")) < height))
    return near.groupBy("ring").agg(F.count(F.when(F.col("during"), 1)).alias("during"), F.count(F.when(~F.col("during"), 1)).alias("after")).withColumn("occupancy", F.col("during") / F.greatest("after", F.lit(1)))


def fire_profile(rings: DataFrame, count: int = 14, width: float = 20.0, floor: float = 0.01) -> dict[str, np.ndarray]:
    """Edges and occupancy factors by ring: between floor and 1, and 1 from the first ring that is nearly as full as usual."""
    found = {r["ring"]: r["occupancy"] for r in rings.collect()}  # 14 rings at most
    occupancy = np.clip([found.get(i, 1.0) for i in range(count)], floor, 1.0)
    full = np.flatnonzero(occupancy >= 0.95)
    if len(full):
        occupancy[full[0] :] = 1.0
    return {"edges": width * np.arange(count + 1), "occupancy": occupancy}


def fire_choices(states: DataFrame, fires: DataFrame, cells: DataFrame, learned: DataFrame, count: int = 14, width: float = 20.0, height: float = 100.0, spread: float = 0.5) -> DataFrame:
    """One row for each move near fires that burn where it ends: truth, the ring of the cell moved to, and base, the
    chance under the learned chain to move into each ring (the last one is beyond the fires); x is that choice's ring
    as one-hot. A cell's ring is that of the nearest fire on its floor. All next cells count, however many."""
    keys = ["demo_id", "round_num", "steamid", "tick"]
    moves = temporal.moves(states, ["demo_id", "round_num", "steamid"], ["tick"], "tick", "node", exact=STEP)
    moves = moves.select(*keys, "side", "phase", bins.since_bin(F.col("since")).alias("sbin"), "node", "next_node", "X", "Y", "Z", (F.col("tick") + STEP).alias("ends"))
    burning = fires.select("demo_id", "round_num", F.col("X").alias("fx"), F.col("Y").alias("fy"), F.col("Z").alias("fz"), (F.col("start_tick") + spread * TICKS).alias("s"), F.col("end_tick").alias("e"))
    met = temporal.interval_join(moves, burning, ["demo_id", "round_num"], "ends", "s", "e", 7 * TICKS)
    near = met.where((F.hypot(F.col("X") - F.col("fx"), F.col("Y") - F.col("fy")) < count * width + 128) & (F.abs(F.col("Z") - F.col("fz")) < height))
    at = cells.select(F.col("node").alias("to"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    options = near.join(learned.select("side", "phase", "sbin", "node", F.col("next_node").alias("to"), "p"), ["side", "phase", "sbin", "node"]).join(at, "to")
    ring = F.least(F.floor(F.hypot(F.col("cx") - F.col("fx"), F.col("cy") - F.col("fy")) / width), F.lit(count)).cast("int")
    ring = F.when(F.abs(F.col("cz") - F.col("fz")) < height, ring).otherwise(count)
    each = options.groupBy(*keys, "to").agg(F.min(ring).alias("ring"), F.first("p").alias("p"), F.max(F.col("to") == F.col("next_node")).alias("true"))
    mass = F.array(*(F.sum(F.when(F.col("ring") == i, F.col("p")).otherwise(0.0)) for i in range(count + 1)))
    rows = each.groupBy(*keys).agg(mass.alias("base"), F.max(F.when(F.col("true"), F.col("ring"))).alias("truth"), F.min("ring").alias("least"))
    eye = F.array(*(F.lit(float(i == j)) for i in range(count + 1) for j in range(count)))
    return rows.where(f"truth is not null and least < {count}").select(F.col("truth").cast("int").alias("truth"), "base", eye.alias("x"))
