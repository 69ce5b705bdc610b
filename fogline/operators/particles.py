"""The trajectory filter without a library in one process: draws are joins, and stretches between sightings are groups.

A sighting makes all particles anew, whatever they were, so the steps from one sighting to the next are a filter of their
own (segments()). Within a segment particles follow recorded trajectories by themselves until they are resampled; so
their paths are made ahead of the weights:

- cells are put together to parts with a bounded number of candidates (_parts()), and the requests of a segment in a part are
  one row of arrays. They meet the part's candidates and the rests of their trajectories by a cogroup; requests are dealt to
  several groups only as far as there are many more of them than candidates, so both grow with the input alone. A draw
  proposes a state by a bound of its weight and takes it with its odds (_Lists), so it does not weigh all of a list;
- a cell with more candidates than a part holds has several blocks. Each block offers one of its states and a number of an
  exponential race by its total weight; the least number of all blocks wins, which draws from the whole list by weight
  without ever holding it;
- where a trajectory is shorter than the segment, the next request starts at its end: in the same group if its cell belongs
  to the same part, else in the next round. A few rounds complete all paths;
- many segments side by side weigh their paths step by step. Where too few particles carry the weight, they are resampled
  systematically, and copies ask for paths of their own from there on; segments with such requests are weighed again
  once these are made, all others are done.

What grows with the input meets by shuffles: only tables of a map's cells are broadcast, so the driver holds no more of a
larger input (long_side()).

Every uniform number is hashed from the seed, the segment, the particle and the step, so nothing depends on partitions
and a lost task is done again with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import belief as b
from . import graph

#: Particles asked for and candidates that a group holds, or so. A group with many candidates takes SHARE times as many particles.
MOST_REQUESTS, MOST_CANDIDATES = 200_000, 125_000
SHARE = 8
BINS = 16  # of a list's clocks, with a bound of the weights each
TRIES = 16  # proposals of a draw, before the whole list is weighed
CHUNK = 65_536  # particles that are drawn at once
STEPS = 2_048  # steps that are weighed at once
STARTS, EARLY = -1, -2  # in place of a cell: first states of trajectories, and those of a round's first seconds
STATE = "traj string, pos int, side int, node int, t double, phase int, since double, buy int, weapon int, vx double, vy double"


def long_side(df: DataFrame) -> DataFrame:
    """A table that grows with the input, as a side of a join. Arrays of few values take little room in files and much in
    memory, so by its files alone Spark would broadcast it through the driver."""
    return df.hint("merge")


# -- candidates -----------------------------------------------------------------------------------------------------


def node_rings(cells: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(node, near, ring): the cells within some steps of each cell, itself at 0."""
    own = cells.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct()
    far = graph.hops(edges.select("src", "dst").unionByName(own), most)
    return far.select(F.col("src").alias("node"), F.col("dst").alias("near"), F.col("hop").alias("ring"))


def reach(rings: DataFrame, states: DataFrame, least: int = 40) -> DataFrame:
    """(side, node, ring, n): the smallest ring within which a cell has `least` states of a side, else the last one with
    any; cells without any have no row."""
    counts = states.groupBy("side", F.col("node").alias("near")).agg(F.count("*").alias("n"))
    by_ring = rings.join(F.broadcast(counts), "near").groupBy("side", "node", "ring").agg(F.sum("n").alias("n"))
    upto = by_ring.withColumn("n", F.sum("n").over(Window.partitionBy("side", "node").orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)))
    enough = F.col("n") >= least
    return upto.groupBy("side", "node").agg(F.coalesce(F.min(F.when(enough, F.struct("ring", "n"))), F.max(F.struct("ring", "n"))).alias("r")).select("side", "node", "r.ring", "r.n")


def candidates(wanted: DataFrame, states: DataFrame, rings: DataFrame, reached: DataFrame) -> DataFrame:
    """The states near wanted cells (side, node): node, ring and the columns of states (their own cell as at)."""
    near = wanted.select("side", "node").distinct().join(reached.select("side", "node", F.col("ring").alias("__most")), ["side", "node"]).join(rings, "node").where(F.col("ring") <= F.col("__most"))
    # cells of a map and those within three rings of each
    return states.withColumnRenamed("node", "near").join(F.broadcast(near.select("side", "node", "near", "ring")), ["side", "near"]).withColumnRenamed("near", "at")


def _offered(wanted: DataFrame, states: DataFrame, rings: DataFrame, reached: DataFrame) -> DataFrame:
    """Candidates of cells, and of STARTS and EARLY."""
    first = states.where("pos = 0").withColumn("at", F.col("node"))
    early = first.where("t < 3")
    late = first.join(F.broadcast(early.select("side").distinct()), "side", "left_anti")  # a side without early states starts anywhere
    columns = ["side", "node", "traj", "pos", "at", "t", "phase", "since", "buy", "weapon", "vx", "vy"]
    parts = [candidates(wanted, states, rings, reached), first.withColumn("node", F.lit(STARTS)), early.unionByName(late).withColumn("node", F.lit(EARLY))]
    every = parts[0].select(*columns)
    for p in parts[1:]:
        every = every.unionByName(p.join(F.broadcast(wanted.select("side", "node").distinct()), ["side", "node"], "left_semi").select(*columns))
    return every


# -- draws ----------------------------------------------------------------------------------------------------------


def uniforms(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    u = np.uint64
    x = h.astype(np.int64).view(u) + u((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return ((x ^ (x >> u(31))) >> u(11)).astype(float) / 2**53 + 2.0**-54


class _Alike:
    """b.state_weights() of all states of a list for many requests. Where what a request asks for but the clock is the same
    for all of them, its factors are numbers; the weights are the same to the last bit."""

    def __init__(self, lib: SimpleNamespace):
        self.lib, self.every = lib, np.arange(len(lib.t))
        self.phases, self.never = np.unique(lib.phase), bool(np.isnan(lib.since).all())
        self.still = not lib.velocity.any()

    def weights(self, t: float, phase: int, since: float, buy: np.ndarray | None, heading: np.ndarray | None, weapon: int, cfg: b.Recursion) -> np.ndarray:
        slow = heading is None or (self.still and np.hypot(*heading) <= 20)
        armed = cfg.other_weapon < 1 and weapon >= 0
        if buy is not None or armed or not (slow and self.never and len(self.phases) == 1):
            return b.state_weights(self.lib, self.every, t, phase, since, buy, heading, weapon, cfg)
        w = np.exp(-0.5 * ((self.lib.t - t) / 15.0) ** 2)
        if self.phases[0] != phase:
            w *= 0.02
        if not np.isnan(since):
            w *= 0.05
        return w + 1e-12


class Sizes(NamedTuple):
    """n cells, m particles, steps of the longest segment; and the types that hold cells, and particles and steps."""

    n: int
    m: int
    longest: int

    @property
    def cells(self) -> type:
        return np.int16 if self.n < 2**15 else np.int32

    @property
    def number(self) -> type:
        return np.uint16 if max(self.m, self.longest) < 2**16 else np.int32


#: The columns of a segment's steps: clocks, phases, ages of the sighting, buys (three each; null: none), and the weapon.
CLOCK = ("ts", "phases", "ages", "buys", "weapon")


def _no_spot() -> list[Column]:
    """What requests that name their particles leave empty."""
    return [F.lit(None).cast(t).alias(c) for c, t in (("spot", "int"), ("hx", "double"), ("hy", "double"))]


class _Lists:
    """The candidates of a part's cells, each cell's by phase, sighting and clock, and draws from them by weight.

    A list is cut into bins of equal numbers. Its nearest clock, and whether it has the phase and any sighting asked for, bound a
    bin's weights, as all other kernels are at most 1 (that of the buy: the request's sum). A draw takes a bin by bound and
    number, one of its states evenly, and that with the odds of its weight to the bound, else it tries again. What is taken
    follows the weights exactly, as does a draw from the weighed list, which is what is left after TRIES proposals. Proposals
    come as a Poisson process of the bounds, so the time of the one taken is exponential by the total weight: a number for the
    race of blocks.
    """

    def __init__(self, held: pa.Table, n: int, cells: type, cfg: b.Recursion, block: int):
        array = lambda c: held[c].to_numpy(zero_copy_only=False)
        order = np.lexsort([array("id"), array("t"), np.isnan(array("since").astype(float)), array("phase"), array("node")])
        held = held.take(pa.array(order)).combine_chunks()
        self.lib = SimpleNamespace(t=array("t"), phase=array("phase"), since=array("since").astype(float), buy=array("buy"), weapon=array("weapon"), velocity=np.stack([array("vx"), array("vy")], 1))
        self.cfg, self.block = cfg, block
        nodes, first = np.unique(array("node"), return_index=True)
        self.local = np.full(n + 2, -1)  # by node + 2: which list
        self.local[nodes + 2] = np.arange(len(nodes))
        self.nodes, self.lo, self.hi = nodes, first, np.append(first[1:], len(held))
        self.edges = self.lo[:, None] + (self.hi - self.lo)[:, None] * np.arange(BINS + 1) // BINS
        self.count = np.diff(self.edges, axis=1)
        bins = lambda f, x: f.reduceat(x, self.edges[:, :-1].ravel()).reshape(self.count.shape)
        self.least, self.most = bins(np.minimum, self.lib.t), bins(np.maximum, self.lib.t)
        # the best kernels of a bin: of the sighting for never and ever, of the phase for each, and for one that the lists lack
        never = np.isnan(self.lib.since)
        self.sighted = np.stack([np.where(bins(np.logical_or, x), 1.0, 0.05) for x in (~never, never)])
        self.phases = np.unique(self.lib.phase)
        self.phased = np.stack([*(np.where(bins(np.logical_or, self.lib.phase == x), 1.0, 0.02) for x in self.phases), np.full(self.count.shape, 0.02)])
        self.rest, self.long = _unpacked(held["rest"], cells)
        self.start = np.cumsum(self.long) - self.long
        self.moves = [_unpacked(held[c], float)[0] for c in ("restx", "resty")] if held["restx"].null_count == 0 else None
        self._alike: dict[int, _Alike] = {}

    def draw(self, of: np.ndarray, spot: np.ndarray, own: np.ndarray, t: np.ndarray, phase: np.ndarray, since: np.ndarray, buy: np.ndarray | None, heading: np.ndarray | None, weapon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, race) for particles: their spot, and hashes; of, t, phase, since (nan: never), buy, heading (nan: none)
        and weapon are the spots' list and situation."""
        plain = self.nodes[of] == EARLY  # these are drawn evenly
        scale = np.ones(len(of)) if buy is None else np.maximum(np.nan_to_num(buy).sum(1), 1.0)
        apart = np.clip(t[:, None], self.least[of], self.most[of]) - t[:, None]
        known = np.searchsorted(self.phases, phase).clip(0, len(self.phases) - 1)
        known = np.where(self.phases[known] == phase, known, len(self.phases))
        bound = np.exp(-0.5 * (apart / 15.0) ** 2) * self.phased[known, of] * self.sighted[np.isnan(since).astype(int), of] * scale[:, None] + 1e-12
        bound[plain] = 1.0
        ends = np.cumsum(bound * self.count[of], 1)
        place, race, left = np.empty(len(spot), np.int64), np.zeros(len(spot)), np.arange(len(spot))
        salts = np.arange(TRIES + 1) * np.int64(0x2545F4914F6CDD1D)
        for salt in salts[:-1]:
            at = spot[left]
            total = ends[at, -1]
            salted = own[left] ^ salt
            race[left] -= np.log(uniforms(salted, 1)) / total
            x = uniforms(salted, 0) * total
            bin_ = (ends[at] <= x[:, None]).sum(1).clip(0, BINS - 1)
            many, cap = self.count[of[at], bin_], bound[at, bin_]
            x = np.maximum(x - np.where(bin_ > 0, ends[at, np.maximum(bin_ - 1, 0)], 0.0), 0.0) / cap
            nth = np.minimum(x.astype(np.int64), np.maximum(many - 1, 0))
            found = self.edges[of[at], bin_] + nth
            w = b.state_weights(self.lib, found, t[at], phase[at], since[at], None if buy is None else buy[at], None if heading is None else heading[at], weapon[at], self.cfg)
            taken = (plain[at] | ((x - nth) * cap < w)) & (many > 0)
            place[left[taken]] = found[taken]
            left = left[~taken]
            if not len(left):
                return place, race
        # what no proposal has met: by all weights of the list
        order = left[np.argsort(spot[left], kind="stable")]
        for mine in np.split(order, np.flatnonzero(np.diff(spot[order])) + 1):
            i = spot[mine[0]]
            lo, hi = self.lo[of[i]], self.hi[of[i]]
            if of[i] not in self._alike:
                self._alike[of[i]] = _Alike(SimpleNamespace(**{k: v[lo:hi] for k, v in vars(self.lib).items()}))
            h = None if heading is None or np.isnan(heading[i, 0]) else heading[i]
            sums = np.cumsum(self._alike[of[i]].weights(t[i], phase[i], since[i], None if buy is None or np.isnan(buy[i, 0]) else buy[i], h, int(weapon[i]), self.cfg))
            salted = own[mine] ^ salts[-1]
            place[mine] = lo + np.searchsorted(sums, uniforms(salted, 0) * sums[-1], "right").clip(0, hi - lo - 1)
            race[mine] -= np.log(uniforms(salted, 1)) / sums[-1]
        return place, race


def _runs(long: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each length."""
    return np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Numbers in one binary a row: Spark moves and stores these whole, but lists value by value."""
    ends = np.append(0, np.cumsum(counts)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array | pa.ChunkedArray, t: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of _packed() binaries, and how many each row has (null: none)."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.cast(pa.binary()).fill_null(b"") if x.null_count else x.cast(pa.binary())
    if not len(x):
        return np.zeros(0, t), np.zeros(0, int)
    ends = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset)
    size = np.dtype(t).itemsize
    data = x.buffers()[2]
    many = int(ends[-1] - ends[0]) // size
    return np.frombuffer(data, t, many, int(ends[0])) if many else np.zeros(0, t), np.diff(ends) // size


def packed(df: DataFrame, types: dict[str, type]) -> DataFrame:
    """df with some of its array columns as of _packed()."""
    schema = ", ".join(f"{f.name} {'binary' if f.name in types else f.dataType.simpleString()}" for f in df.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            for c, t in types.items():
                long = out[c].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                out[c] = pa.nulls(len(batch), pa.binary()) if out[c].null_count == len(batch) else _packed(out[c].flatten().to_numpy(zero_copy_only=False).astype(t), long)
            yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(pack, schema)


def _parts(states: DataFrame, reached: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By side: for every cell from EARLY on, where its requests are drawn from (itself or STARTS), the part that holds these
    candidates, their number and that of blocks. Sides without states are left out. A table of a map's cells."""
    first = states.where("pos = 0").groupBy("side").agg(F.count("*").alias("first"), F.sum((F.col("t") < 3).cast("int")).alias("early"))
    starts = {r["side"]: (r["early"] or r["first"], r["first"]) for r in first.collect()}
    known = reached.select("side", "node", "n").collect()
    out = {}
    for side, (early, every) in starts.items():
        size = np.zeros(n + 2, np.int64)
        size[:2] = early, every
        for r in known:
            if r["side"] == side:
                size[r["node"] + 2] = r["n"]
        goal = np.where(size > 0, np.arange(-2, n), STARTS)
        big = size > MOST_CANDIDATES
        small = np.where(big, 0, size)
        part = np.where(big, -1 - np.arange(n + 2), (np.cumsum(small) - small) // MOST_CANDIDATES)
        blocks = np.maximum(-(-size // MOST_CANDIDATES), 1)
        out[side] = goal, part[goal + 2], size[goal + 2], blocks[goal + 2]
    return out


def draw(requests: DataFrame, keys: Sequence[str], states: DataFrame, tracks: DataFrame, rings: DataFrame, reached: DataFrame, parts: dict, cfg: b.Recursion, size: Sizes) -> DataFrame:
    """(keys, round, ks, offs, lens, nodes, vxs, vys, side, part) with pieces of paths, one row a request, or (part not null) with
    the requests that follow in other parts: particles ks at steps offs; lens and nodes, the pieces' cells end to end, or the
    cells that are asked for. Numbers are as of _packed().

    requests: keys, round, side, part, ks, offs, nodes, vxs, vys, or (ks null: all particles at step 0) spot, hx, hy; and CLOCK
    of a segment's steps. Particles at the same cell and step share the heading of
    the first."""
    spark, types = requests.sparkSession, {f.name: f.dataType.simpleString() for f in requests.schema}
    requests = stored(requests.withColumn("h", F.xxhash64(F.lit(cfg.seed), *keys, "round")), "requests")
    asked = {(r["side"], r["part"]): r["n"] for r in requests.groupBy("side", "part").agg(F.sum(F.when(F.col("ks").isNull(), size.m).otherwise((F.octet_length("ks") / np.dtype(size.number).itemsize).cast("int"))).alias("n")).collect()}  # parts of a map's cells
    deal, total = [], 0
    for side, (goal, part, long, blocks) in parts.items():
        held: dict[int, int] = {}
        for i in np.flatnonzero(goal == np.arange(-2, size.n)):
            held[int(part[i])] = held.get(int(part[i]), 0) + int(long[i] // blocks[i])
        for i in np.flatnonzero(goal == np.arange(-2, size.n)):
            many = asked.get((side, int(part[i])))
            if many:
                salts = -(-many // max(MOST_REQUESTS, SHARE * held[int(part[i])]))
                deal.append((side, int(i) - 2, int(part[i]), int(salts), int(blocks[i])))
        total += sum(many for (s, _), many in asked.items() if s == side)
    dealt = spark.createDataFrame(deal, "side int, node int, part int, salts int, blocks int")
    by_part = dealt.groupBy("side", "part").agg(F.first("salts").alias("salts"), F.first("blocks").alias("blocks"))
    by_part = by_part.withColumnRenamed("part", "node")  # a part in place of a cell
    left = requests.withColumn("node", F.col("part")).join(F.broadcast(by_part), ["side", "node"]).withColumn("salt", F.pmod(F.xxhash64(*keys), F.col("salts")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("salts", "node")
    right = _offered(dealt, states, rings, reached).join(F.broadcast(dealt), ["side", "node"]).withColumn("id", F.xxhash64("traj", "pos")).withColumn("block", F.pmod("id", F.col("blocks")).cast("int"))
    byte = np.dtype(size.cells).itemsize
    rest = lambda c, wide: F.substring(c, F.col("pos") * wide + 1, F.lit(size.longest * wide))
    right = right.join(long_side(tracks), "traj").select("side", "part", "block", "salts", "node", "id", "t", "phase", "since", "buy", "weapon", "vx", "vy", rest("nodes", byte).alias("rest"), rest("vxs", 8).alias("restx"), rest("vys", 8).alias("resty"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    plain = {"ks": "binary", "offs": "binary", "lens": "binary", "nodes": "binary", "vxs": "binary", "vys": "binary", "race": "double", "k": "int", "off": "int", "next": "int", "node": "int", "vx": "double", "vy": "double", "side": "int", "part": "int", "blocks": "int"}
    arrow = {"binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
    schema = ", ".join([f"{c} {types[c]}" for c in keys] + ["round int"] + [f"{c} {t}" for c, t in plain.items()])

    def pick(asked: pa.Table, held: pa.Table) -> pa.Table:
        own = {c: asked.schema.field(c).type for c in [*keys, "round"]} | {c: arrow[t] for c, t in plain.items()}
        out = [] if not len(held) or not len(asked) else list(_drawn(asked, _Lists(held, size.n, size.cells, cfg, asked["block"][0].as_py()), keys, parts, size))
        blank = lambda t, c: [c[n] if n in c.column_names else pa.nulls(len(c), k) for n, k in t.items()]
        return pa.concat_tables(pa.table(blank(own, x), names=list(own)) for x in out) if out else pa.table({c: pa.array([], t) for c, t in own.items()})

    group, many = ["side", "part", "salt", "block"], max(spark.sparkContext.defaultParallelism, min(4 * len({d[2:3] + d[:1] for d in deal}) + total // MOST_REQUESTS, 4_000))
    right = right.select(*(F.col(c).alias(f"of_{c}") for c in group), *(c for c in right.columns if c not in group)).repartition(many, *(f"of_{c}" for c in group))
    offers = left.repartition(many, *group).groupBy(*group).cogroup(right.groupBy(*(f"of_{c}" for c in group))).applyInArrow(pick, schema)
    columns = [*keys, "round", "ks", "offs", "lens", "nodes", "vxs", "vys", "side", "part"]
    if all(d[4] == 1 for d in deal):
        return offers.select(*columns)
    offers = stored(offers, "offers")
    # of a cell in blocks, each block has offered one piece a particle
    inner = [c for c in plain if c not in ("k", "off", "race")]
    won = offers.where("blocks > 1").groupBy(*keys, "round", "k", "off").agg(F.min_by(F.struct(*inner), "race").alias("s")).select(*keys, "round", "k", "s.*")
    one = lambda c, name: F.array(c).alias(name)
    ended = won.where("next is not null").drop("part", "ks", "offs", "lens", "nodes", "vxs", "vys").join(F.broadcast(_part_of(spark, parts)), ["side", "node"])
    ended = ended.select(*keys, "round", one("k", "ks"), one("next", "offs"), F.lit(None).cast("binary").alias("lens"), one("node", "nodes"), one("vx", "vxs"), one("vy", "vys"), "side", F.col("goes").alias("part"))
    ended = packed(ended, {"ks": size.number, "offs": size.number, "nodes": size.cells, "vxs": float, "vys": float})
    return offers.where("blocks = 1").select(*columns).unionByName(won.select(*columns)).unionByName(ended.select(*columns))


def _part_of(spark, parts: dict) -> DataFrame:
    """(side, node, goes): the part that requests of a cell go to."""
    return spark.createDataFrame([(s, int(i) - 2, int(p)) for s, (_, part, _, _) in parts.items() for i, p in enumerate(part)], "side int, node int, goes int")


def _drawn(asked: pa.Table, lists: _Lists, keys: Sequence[str], parts: dict, size: Sizes) -> Iterator[pa.Table]:
    """draw() for the requests of a group, some at a time."""
    asked = asked.combine_chunks()
    whole = asked["ks"].is_null().to_numpy()
    many = np.where(whole, size.m, _unpacked(asked["ks"], size.number)[1])
    upto, at = np.cumsum(many), 0
    while at < len(asked):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        yield from _drawn_at_once(asked.slice(at, end - at).combine_chunks(), whole[at:end], many[at:end], lists, keys, parts, size)
        at = end


def _drawn_at_once(asked: pa.Table, whole: np.ndarray, many: np.ndarray, lists: _Lists, keys: Sequence[str], parts: dict, size: Sizes) -> Iterator[pa.Table]:
    array = lambda c: asked[c].to_numpy(zero_copy_only=False)
    side, mine, blocks = asked["side"][0].as_py(), asked["part"][0].as_py(), asked["blocks"][0].as_py()
    goal, part = parts[side][:2]
    # the clocks of all segments end to end
    (t, steps), (phase, _), (since, _), (buy, _) = (_unpacked(asked[c], kind) for c, kind in zip(CLOCK, (float, np.int32, float, float), strict=False))
    begin, buy, weapon = np.cumsum(steps) - steps, buy.reshape(-1, 3) if len(buy) else None, np.repeat(array("weapon"), steps)
    # all particles: of whole rows, and of those that name theirs
    row = np.repeat(np.arange(len(asked)), many)
    named = ~whole[row]

    def given(c: str, t: type, otherwise: np.ndarray, kind: type) -> np.ndarray:
        values = otherwise.astype(kind)
        if named.any():
            values[named] = _unpacked(asked[c], t)[0]
        return values

    whole_row = lambda c, t, none: array(c).astype(float)[row] if t is float else asked[c].fill_null(none).to_numpy()[row]
    k, off, node = given("ks", size.number, _runs(many), int), given("offs", size.number, np.zeros(len(row)), int), given("nodes", size.cells, whole_row("spot", int, 0), int)
    vx, vy = given("vxs", float, whole_row("hx", float, None), float), given("vys", float, whole_row("hy", float, None), float)
    h, found, gone = array("h"), [], []
    while len(row):
        # particles at the same step and cell of a segment have the same situation
        of = lists.local[goal[node + 2] + 2]
        _, first, spot = np.unique((row * (steps.max() + 1) + off) * (len(goal) + 1) + node + 2, return_index=True, return_inverse=True)
        now = begin[row[first]] + off[first]
        heading = None if np.isnan(vx).all() else np.stack([vx[first], vy[first]], 1)
        own = h[row] ^ (k * np.int64(0x632BE59BD9B4E019) + off * np.int64(0x3C6EF372FE94F82B) + np.full(1, lists.block) * np.int64(0x1D8AF066A5B1E9))
        place, race = lists.draw(of[first], spot, own, t[now], phase[now], since[now], None if buy is None else buy[now], heading, weapon[now])
        long = np.minimum(lists.long[place], steps[row] - off)
        found.append((row, k, off, place, long, race))
        if blocks > 1:
            break
        more = off + long < steps[row]
        row, k, off, last = row[more], k[more], (off + long)[more], (lists.start[place] + long - 1)[more]
        node = lists.rest[last].astype(int)
        vx, vy = (np.zeros(len(row)) if lists.moves is None else v[last] for v in lists.moves or (None, None))
        away = part[node + 2] != mine
        gone.append([x[away] for x in (row, k, off, node, vx, vy)])
        row, k, off, node, vx, vy = (x[~away] for x in (row, k, off, node, vx, vy))
    row, k, off, place, long, race = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    row, k, off, place, long, race = (x[order] for x in (row, k, off, place, long, race))
    which = np.repeat(lists.start[place], long) + _runs(long)

    def table(row: np.ndarray, first: np.ndarray, more: dict) -> pa.Table:
        """Rows from first on, of particles' arrays and of others that are a row's already."""
        one, counts = asked.select([*keys, "round", "side", "blocks"]).take(pa.array(row[first])), np.diff(np.append(first, len(row)))
        made = {c: _packed(x, counts) if isinstance(x, np.ndarray) else x for c, x in more.items() if x is not None}
        return pa.table([*one.columns, *made.values()], names=[*one.column_names, *made])

    small = lambda x: x.astype(size.number)
    own = np.arange(len(row)) if blocks > 1 else np.flatnonzero(np.diff(row, prepend=-1))
    cells = np.add.reduceat(long, own)
    out = {"ks": small(k), "offs": small(off), "lens": small(long), "nodes": _packed(lists.rest[which], cells)}
    if lists.moves is not None:
        out |= {c: _packed(v[which], cells) for c, v in zip(("vxs", "vys"), lists.moves, strict=True)}
    if blocks > 1:
        ends, stop = lists.start[place] + long - 1, off + long
        i32 = lambda x, none=None: pa.array(x.astype(np.int32), mask=none)
        vx, vy = (np.zeros(len(row)) if lists.moves is None else v[ends] for v in lists.moves or (None, None))
        out |= {"race": pa.array(race), "k": i32(k), "off": i32(off), "next": i32(stop, stop >= steps[row]), "node": i32(lists.rest[ends]), "vx": pa.array(vx), "vy": pa.array(vy)}
    yield table(row, own, out)
    if gone:
        row, k, off, node, vx, vy = (np.concatenate(x) for x in zip(*gone, strict=True))
        if len(row):
            goes = part[node + 2]
            order = np.lexsort([k, goes, row])
            row, k, off, node, vx, vy, goes = (x[order] for x in (row, k, off, node, vx, vy, goes))
            own = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(goes, prepend=goes[0] - 1) != 0))
            yield table(row, own, {"ks": small(k), "offs": small(off), "nodes": node.astype(size.cells), "vxs": vx, "vys": vy, "part": pa.array(goes[own].astype(np.int32))})


def trajectories(states: DataFrame, cells: type) -> DataFrame:
    """(traj, nodes, vxs, vys): the recorded trajectories, each a round long at most, as of _packed(); vxs and vys null where
    nothing moves."""
    order = F.array_sort(F.collect_list(F.struct("pos", "node", "vx", "vy")))
    moving = not states.where("vx <> 0 or vy <> 0").isEmpty()
    speed = lambda c: F.col(f"s.{c}") if moving else F.lit(None).cast("array<double>")
    every = states.groupBy("traj").agg(order.alias("s")).select("traj", F.col("s.node").alias("nodes"), speed("vx").alias("vxs"), speed("vy").alias("vys"))
    return packed(every, {"nodes": cells, "vxs": float, "vys": float})


def paths(requests: DataFrame, keys: Sequence[str], clock: DataFrame, states: DataFrame, tracks: DataFrame, rings: DataFrame, reached: DataFrame, parts: dict, cfg: b.Recursion, size: Sizes) -> DataFrame:
    """(keys, round, ks, offs, lens, nodes, vxs, vys): pieces of paths from each request to the end of its segment. clock: keys
    and CLOCK."""
    done = None
    columns = [*keys, "round", "ks", "offs", "lens", "nodes", "vxs", "vys"]
    while True:
        piece = stored(draw(requests, keys, states, tracks, rings, reached, parts, cfg, size), "pieces")
        own = piece.where("part is null").select(*columns)
        done = own if done is None else done.unionByName(own)
        ended = piece.where("part is not null").select(*keys, "round", "side", "part", "ks", "offs", "nodes", "vxs", "vys")
        if ended.isEmpty():
            return done
        requests = ended.join(long_side(clock.select(*keys, *CLOCK)), list(keys)).select(*keys, "round", "side", "part", "ks", "offs", "nodes", "vxs", "vys", *_no_spot(), *CLOCK)


# -- the filter -----------------------------------------------------------------------------------------------------


def segments(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """steps of one entity each with segment: how often it was sighted up to the step; and step counted from there."""
    w = Window.partitionBy(*keys).orderBy("step")
    cut = steps.withColumn("segment", F.sum((F.col("seen")[0] >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min("step").over(Window.partitionBy(*keys, "segment"))
    return cut.withColumn("step", (F.col("step") - first).cast("int"))


def _clock(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a segment: keys, side, seen (at its start), hx, hy and CLOCK, what requests need to know of each step, as of
    _packed(): the age of the sighting at the segment's start (nan: none), and the weapon shown then."""
    sighted = lambda c: F.min_by(F.when(F.col("seen")[0] >= 0, c), F.when(F.col("seen")[0] >= 0, F.col("step")))
    weapon = F.col("weapon")[0] if "weapon" in steps.columns else F.lit(-1)
    buy = F.col("buy") if "buy" in steps.columns else F.lit(None).cast("array<double>")
    head = [F.min_by(F.col(c), "step").alias(c) if c in steps.columns else F.lit(None).cast("double").alias(c) for c in ("hx", "hy")]
    order = F.array_sort(F.collect_list(F.struct("step", F.col("t").cast("double").alias("t"), "phase", buy.alias("buy"))))
    each = steps.groupBy(*keys).agg(F.min_by("side", "step").alias("side"), sighted(F.col("seen")[0]).alias("seen"), sighted(F.col("t")).alias("__t"), sighted(weapon).alias("__weapon"), *head, order.alias("__steps"))
    nan = F.lit(float("nan"))
    ages = F.transform("__steps", lambda x: F.coalesce(F.when(F.col("seen").isNotNull(), x["t"] - F.col("__t")), nan))
    buys = F.flatten(F.transform("__steps", lambda x: F.coalesce(x["buy"], F.array(nan, nan, nan)))) if "buy" in steps.columns else F.lit(None).cast("array<double>")
    armed = F.when(F.col("seen").isNotNull(), F.col("__weapon")).otherwise(F.lit(-1)).cast("int")
    every = each.select(*keys, "side", "seen", "hx", "hy", F.col("__steps.t").alias("ts"), F.col("__steps.phase").alias("phases"), ages.alias("ages"), buys.alias("buys"), armed.alias("weapon"))
    return packed(every, {"ts": float, "phases": np.int32, "ages": float, "buys": float})


def weighed(begin: np.ndarray, long: np.ndarray, h: np.ndarray, seen: np.ndarray, chances: np.ndarray | None, look: np.ndarray, pieces: pa.Array, models: b.Models, cfg: b.Recursion, size: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of all steps of segments side by side, and requests (segment, k, round, off, node, vx, vy; a row each) of those that
    must have them answered first. begin, long, h, pieces: where the segments lie among the steps, their hashes and pieces; look:
    each step's row of chances to stay unseen."""
    n, m, steps = models.n, size.m, int(long.sum())
    path = np.full((steps, m), -1, size.cells)
    # all pieces end to end: which segment, particle, step and round each cell is of
    per = pa.compute.fill_null(pieces.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(int)
    rows = pieces.flatten()
    column = lambda c: rows.field(rows.type.get_field_index(c))
    (lens, items), (nodes, _), (offs, _), (ks, _) = (_unpacked(column(c), t) for c, t in (("lens", size.number), ("nodes", size.cells), ("offs", size.number), ("ks", size.number)))
    lens = lens.astype(int)
    segment = np.repeat(np.repeat(np.arange(len(begin)), per), items)
    number = np.repeat(column("round").to_numpy(zero_copy_only=False), items)
    line = np.repeat(begin[segment] + offs, lens) + _runs(lens)
    particle = np.repeat(ks, lens)
    speed = None
    if column("vxs").null_count < len(rows):
        speed = np.zeros((steps, m, 2))
        moves = np.stack([_unpacked(column(c), float)[0] for c in ("vxs", "vys")], 1)
    later = np.flatnonzero(np.repeat(number, lens)) if number.any() else np.zeros(0, int)
    later_of = np.repeat(segment, lens)[later], np.repeat(number, lens)[later]
    now = slice(None) if not len(later) else np.repeat(number, lens) == 0
    path[line[now], particle[now]] = nodes[now]
    if speed is not None:
        speed[line[now], particle[now]] = moves[now]
    order = np.argsort(-long, kind="stable")
    known = np.array([path[lo, 0] >= 0 for lo in begin], bool)  # else nothing was ever recorded of this side
    weight, rounds, waits = np.full((len(begin), m), 1.0 / m), np.zeros(len(begin), int), np.zeros(len(begin), bool)
    beliefs, asked = np.full((steps, n), 1.0 / n), []
    for s in range(int(long.max(initial=0))):
        live = order[: np.searchsorted(-long[order], -s, "left")]
        live = live[known[live] & ~waits[live]]
        at, w = begin[live] + s, weight[live]
        hidden = seen[at] < 0
        if cfg.unseen and chances is not None:
            x = w * np.take_along_axis(chances[look[at]] ** cfg.gamma, path[at].astype(np.int64), 1)
            total = x.sum(1, keepdims=True)
            w = np.where(hidden[:, None], np.where(total > 1e-300, x / np.maximum(total, 1e-300), 1.0 / m), w)
        few = np.flatnonzero(hidden & (1.0 / np.sum(w**2, 1) < m / 3))
        for i in few:
            e, a = int(live[i]), int(at[i])
            end = int(begin[e] + long[e])
            picked = b.systematic(w[i], float(uniforms(np.array([h[e] ^ s]), 2)[0]))
            again = np.flatnonzero(np.diff(picked) == 0) + 1
            path[a:end] = path[a:end, picked]
            if speed is not None:
                speed[a:end] = speed[a:end, picked]
            rounds[e] += 1
            if len(again):
                own = later[(later_of[0] == e) & (later_of[1] == rounds[e])]
                if not len(own):
                    waits[e] = True
                    v = np.zeros((len(again), 2)) if speed is None else speed[a, again]
                    asked.append(np.column_stack([np.full(len(again), e), again, np.full(len(again), rounds[e]), np.full(len(again), s), path[a, again], v]))
                    continue
                path[line[own], particle[own]] = nodes[own]
                if speed is not None:
                    speed[line[own], particle[own]] = moves[own]
            w[i] = 1.0 / m
        weight[live] = w
        mass = np.bincount((np.arange(len(live))[:, None] * n + path[at]).ravel(), w.ravel(), len(live) * n).reshape(len(live), n)
        if models.smooth is not None:
            one = models.smooth.push(mass)
            mass = 0.4 * mass + 0.4 * one + 0.2 * models.smooth.push(one)
        beliefs[at] = (1 - b.FLOOR) * mass / mass.sum(1, keepdims=True) + b.FLOOR / n
    return beliefs, np.concatenate(asked) if asked else np.zeros((0, 7))


def score(steps: DataFrame, keys: Sequence[str], states: DataFrame, rings: DataFrame, models: b.Models, configs: Sequence[b.BeliefConfig], unseen=None, m: int = 512, least: int = 40) -> DataFrame:
    """Samples as of belief.score() for configurations with one particle recursion among their parts, over steps of one
    entity each cut by segments() (keys with segment among them); hx and hy, if there, are the displacement a step since a sighting
    at most two steps before. states: the library, STATE's columns; rings: of
    node_rings(). Evidence is sightings and their absence; kills and fires need episodes whole and are not taken here."""
    parts = {p for c in configs for _, p in c.parts if p.motion == "particles"}
    if len(parts) != 1 or next(iter(parts)).fires or any(c in steps.columns for c in ("kills", "fires")):
        raise ValueError("one particle recursion, without kills and fires")
    cfg, keys, n = next(iter(parts)), list(keys), models.n
    steps, states = stored(steps, "steps"), stored(states, "states")
    clock = stored(_clock(steps, keys), "clock")
    size = Sizes(n, m, int(clock.agg(F.max(F.octet_length("ts"))).first()[0] or 8) // 8)
    rings, tracks = stored(rings, "rings"), stored(trajectories(states, size.cells), "tracks")
    reached = stored(reach(rings, states, least), "reach")
    places = _parts(states, reached, n)
    part_of = F.broadcast(_part_of(steps.sparkSession, places).withColumnRenamed("goes", "part"))
    none = F.lit(None).cast("binary")
    start = clock.withColumn("node", F.coalesce(F.col("seen"), F.lit(EARLY)).cast("int")).join(part_of, ["side", "node"])
    requests = start.select(*keys, F.lit(0).alias("round"), "side", "part", *(none.alias(c) for c in ("ks", "offs", "nodes", "vxs", "vys")), F.col("node").alias("spot"), "hx", "hy", *CLOCK)
    inputs, schema = b.inputs_of(steps), b.sample_schema(steps, keys)
    request_columns = "k int, round int, off int, node int, vx double, vy double"
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
    plain = set(inputs) == set(b.PLAIN) and all(c.output.line_ups is None and not c.output.fires and not c.output.calibrated for c in configs)
    names = [x.split()[0] for x in request_columns.split(", ")]

    def at_once(segments: pa.Table) -> Iterator[pa.Table]:
        own, per = segments["own"].combine_chunks(), segments["own"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(int)
        flat = own.flatten()
        place = np.repeat(np.arange(len(segments)), per)
        table = pa.table({k: segments[k].take(pa.array(place)) for k in keys} | {c: flat.field(flat.type.get_field_index(c)) for c in inputs})
        begin, h = np.cumsum(per) - per, segments["__h"].to_numpy()
        seen = pa.compute.list_element(table["seen"], 0).to_numpy().astype(int)
        episodes = None if plain else [b.episode_of(table.slice(lo, k), models, unseen) for lo, k in zip(begin, per, strict=True)]
        if plain:
            looks, look = np.unique(seen, return_inverse=True)
            chances = None if unseen is None else np.stack([unseen(np.array([x])) for x in looks])
        else:
            look, chances = np.arange(len(seen)), None if episodes[0].unseen is None else np.concatenate([e.unseen for e in episodes])
        beliefs, asked = weighed(begin, per, h, seen, chances, look, segments["pieces"].combine_chunks(), models, cfg, size)
        waits = np.zeros(len(segments), bool)
        waits[asked[:, 0].astype(int)] = True
        if plain and not waits.all():
            kept = ~waits[place]
            for samples in b.samples_side_by_side(table.filter(pa.array(kept)).combine_chunks(), np.cumsum(per[~waits]).tolist(), keys, models, configs, unseen, {cfg: beliefs[kept]}):
                yield pa.table([*samples.columns, *(pa.nulls(len(samples), t) for t in types)], names=[*samples.column_names, *names])
        for i in [] if plain else np.flatnonzero(~waits):
            rows = slice(begin[i], begin[i] + per[i])
            samples = b.samples_of(episodes[i], b.run_all(episodes[i], models, configs, given={cfg: iter(beliefs[rows, None, :])}), models, table.slice(begin[i], per[i]).select(keys))
            yield pa.table([*samples.columns, *(pa.nulls(len(samples), t) for t in types)], names=[*samples.column_names, *names])
        if len(asked):
            ids = segments.select(keys).take(pa.array(asked[:, 0].astype(int)))
            blank = [pa.nulls(len(asked), t) for t in _sample_types()]
            yield pa.table([*ids.columns, *blank, *(pa.array(asked[:, i + 1].astype(t.to_pandas_dtype()), t) for i, t in enumerate(types))], names=[*keys, *(x.split()[0] for x in b.SAMPLE.split(", ")), *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = pa.Table.from_batches([batch])
            upto = np.cumsum(every["own"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(int)) if len(every) else []
            at = 0
            while at < len(every):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEPS, "right")))
                for samples in at_once(every.slice(at, end - at).combine_chunks()):
                    yield from samples.to_batches()
                at = end

    ordered = F.array_sort(F.collect_list(F.struct("step", *(c for c in inputs if c != "step")))).alias("own")
    left = stored(steps.groupBy(*keys).agg(ordered).withColumn("__h", F.xxhash64(F.lit(cfg.seed), *keys)), "segments")
    made, scores = None, None
    while True:
        fresh = paths(requests, keys, clock, states, tracks, rings, reached, places, cfg, size)
        made = fresh if made is None else made.join(long_side(requests.select(*keys).distinct()), keys, "left_semi").unionByName(fresh)
        pieces = made.groupBy(*keys).agg(F.collect_list(F.struct("round", "ks", "offs", "lens", "nodes", "vxs", "vys")).alias("pieces"))
        out = stored(left.join(long_side(pieces), keys, "left").select(*keys, "__h", "own", "pieces").mapInArrow(run, f"{schema}, {request_columns}"), "weighed")
        found = out.where("model is not null").drop(*names)
        scores = found if scores is None else scores.unionByName(found)
        asked = out.where("k is not null")
        if asked.isEmpty():
            return scores
        each = F.array_sort(F.collect_list(F.struct("k", "off", "node", "vx", "vy"))).alias("s")
        again = asked.join(long_side(clock.select(*keys, "side")), keys).join(part_of, ["side", "node"]).groupBy(*keys, "round", "side", "part").agg(each)
        again = again.select(*keys, "round", "side", "part", *(F.col(f"s.{c}").alias(name) for c, name in (("k", "ks"), ("off", "offs"), ("node", "nodes"), ("vx", "vxs"), ("vy", "vys"))))
        again = packed(again, {"ks": size.number, "offs": size.number, "nodes": size.cells, "vxs": float, "vys": float})
        requests = again.join(long_side(clock.select(*keys, *CLOCK)), keys).select(*keys, "round", "side", "part", "ks", "offs", "nodes", "vxs", "vys", *_no_spot(), *CLOCK)
        left = left.join(long_side(again.select(*keys).distinct()), keys, "left_semi")


def _sample_types() -> list[pa.DataType]:
    known = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    return [known[x.split()[1]] for x in b.SAMPLE.split(", ")]
