"""Weighted draws and the trajectory filter as joins, against numpy and the filter in one process."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.operators import belief as b
from fogline.operators import particles as p
from fogline.operators import sampling


@pytest.fixture(scope="module")
def weighted(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, int(rng.integers(0, 9))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "key string, id long, w long").repartition(7)


def test_prefix_sums_of_keys_that_lie_in_many_partitions(weighted):
    rows, df = weighted
    got = sampling.prefix_sums(df, ["key"], ["id"], "w").collect()
    for key in {r[0] for r in rows}:
        own = sorted((i, w) for k, i, w in rows if k == key and w > 0)
        ends = np.cumsum([w for _, w in own])
        found = sorted((r["id"], r["before"], r["upto"], r["total"]) for r in got if r["key"] == key)
        assert found == [(i, e - w, e, ends[-1]) for (i, w), e in zip(own, ends.tolist(), strict=True)]


def test_draws_with_replacement_follow_the_cumulated_weights(spark, weighted):
    rows, df = weighted
    rng = np.random.default_rng(2)
    asked = [("hot", float(u), n) for n, u in enumerate([0.0, *rng.random(400)])] + [("k3", float(u), -1 - n) for n, u in enumerate(rng.random(50))] + [("none", 0.5, 9999), (None, 0.5, 10_000)]
    draws = spark.createDataFrame(asked, "key string, u double, n long")
    got = {r["n"]: r["id"] for r in sampling.with_replacement(draws, df, ["key"], ["id"], "w", "u", ["id"]).collect()}
    assert set(got) == {n for *_, n in asked} and got[9999] is None and got[10_000] is None
    for key, u, n in asked[:-2]:
        own = sorted((i, w) for k, i, w in rows if k == key and w > 0)
        ends = np.cumsum([w for _, w in own])
        assert got[n] == own[int(np.searchsorted(ends, u * ends[-1], "right"))][0]


def test_systematic_copies_equal_the_array_version(spark, weighted):
    rows, df = weighted
    got = sampling.systematic(df, ["key"], ["id"], "w", 500, F.lit(0.37)).collect()
    for key in ("hot", "k0"):
        own = sorted((i, w) for k, i, w in rows if k == key and w > 0)
        w = np.array([x for _, x in own], float)
        picks = np.searchsorted(np.cumsum(w) / w.sum(), (np.arange(500) + 0.37) / 500, "right").clip(0, len(w) - 1)
        counts = np.bincount(picks, minlength=len(w))
        assert {r["id"]: r["copies"] for r in got if r["key"] == key} == {own[i][0]: int(n) for i, n in enumerate(counts) if n}


def line(spark, n):
    cells = spark.range(n).select(F.col("id").cast("int").alias("node"))
    edges = cells.select(F.col("node").alias("src"), F.explode(F.array(F.col("node") - 1, F.col("node") + 1)).alias("dst")).where(f"dst between 0 and {n - 1}")
    return p.node_rings(cells, edges)


def states(spark, rows):
    """rows: traj, pos, node, t."""
    full = [(traj, pos, 0, node, float(t), 0, None, 2, -1, 0.0, 0.0) for traj, pos, node, t in rows]
    return spark.createDataFrame(full, p.STATE)


def test_reach_widens_ring_by_ring(spark):
    counts = {0: 50, 3: 10, 4: 5, 5: 30, 9: 1}
    s = states(spark, [(f"x{n}", i, n, 0) for n, k in counts.items() for i in range(k)])
    got = {r["node"]: (r["ring"], r["n"]) for r in p.reach(line(spark, 20), s, 40).collect()}
    for node in range(20):
        found = None
        for ring in range(4):
            n = sum(k for c, k in counts.items() if abs(c - node) <= ring)
            if n:
                found = (min(r for r in range(ring + 1) if sum(k for c, k in counts.items() if abs(c - node) <= r) == n), n)
            if n >= 40:
                break
        assert got.get(node) == found, node


def models_of(n, region=None):
    row, col = np.indices((n, n)).reshape(2, -1)
    near = np.abs(row - col) <= 1
    walk = b.Chain(row[near], col[near], 1.0 / np.bincount(row[near])[row[near]], n)
    return b.Models({(0, 0, k, -1): walk for k in range(6)}, walk, np.full((1, n), 1 / n), {(0, 0): np.full((1, n), 1 / n)}, np.arange(n) if region is None else region)


def steps_of(spark, rows):
    """rows: entity, step, seen, true."""
    df = spark.createDataFrame(rows, "who string, step int, seen int, true int")
    full = df.select("who", F.lit(0).alias("side"), "step", F.col("step").cast("double").alias("t"), F.lit(0).alias("phase"), F.array("seen").alias("seen"), F.array(F.lit(True)).alias("alive"), F.array("true").alias("true"))
    return p.segments(full, ["who"])


PF = b.configurations()["pf"]


def probabilities(df):
    return {(r["who"], r["segment"], r["step"]): np.array(r["probs"]) for r in df.collect()}


def test_one_recorded_path_is_followed_and_the_next_one_is_taken_at_its_end(spark):
    # the only states at 5 lead to 6, 7, 8; those at 8 to 9
    lib = states(spark, [("a", i, 5 + i, 10 + i) for i in range(4)] + [("b", 0, 8, 13), ("b", 1, 9, 14)] * 1)
    steps = steps_of(spark, [("e", s, 5 if s == 2 else -1, 1) for s in range(8)])
    got = probabilities(p.score(steps, ["who", "segment"], lib, line(spark, 12), models_of(12), [PF], m=64, least=1))
    assert [int(got["e", 1, s].argmax()) for s in (1, 2, 3)] == [6, 7, 8]
    # segment 0 starts at first states of trajectories (none is early): 5 or 8
    assert got["e", 0, 0][[5, 8]].sum() > 0.99
    assert all(np.isclose(x.sum(), 1) for x in got.values()) and len(got) == 7


def test_a_sighting_far_from_all_records_falls_back_to_starts(spark):
    lib = states(spark, [("a", 0, 2, 0), ("a", 1, 3, 1), ("b", 0, 4, 0), ("b", 1, 5, 1)])
    got = probabilities(p.score(steps_of(spark, [("e", 0, 11, 1), ("e", 1, -1, 1)]), ["who", "segment"], lib, line(spark, 12), models_of(12), [PF], m=400))
    assert got["e", 1, 1][[3, 5]].sum() > 0.99 and 0.3 < got["e", 1, 1][3] < 0.7


def test_nothing_recorded_is_uniform_and_empty_steps_give_nothing(spark):
    lib = states(spark, [])
    got = probabilities(p.score(steps_of(spark, [("e", 0, 1, 1), ("e", 1, -1, 1)]), ["who", "segment"], lib, line(spark, 6), models_of(6), [PF], m=8))
    assert np.allclose(got["e", 1, 1], 1 / 6)
    assert p.score(steps_of(spark, []), ["who", "segment"], states(spark, [("a", 0, 2, 0)]), line(spark, 6), models_of(6), [PF], m=8).collect() == []


def test_blocks_and_groups_of_requests_draw_by_weight(spark, monkeypatch):
    monkeypatch.setattr(p, "MOST_CANDIDATES", 7)
    monkeypatch.setattr(p, "MOST_REQUESTS", 2)
    # forty states at 3, each followed by its own cell; their clocks differ, so their weights do
    lib = states(spark, [x for i in range(40) for x in ((f"t{i:02}", 0, 3, i), (f"t{i:02}", 1, 10 + i, i + 1))])
    steps = steps_of(spark, [(f"e{k}", s, 3 if s == 0 else -1, 1) for k in range(6) for s in range(2)])
    got = probabilities(p.score(steps, ["who", "segment"], lib, line(spark, 60), models_of(60), [PF], m=2000))
    mean = np.mean([got[f"e{k}", 1, 1][10:50] for k in range(6)], 0)
    w = np.exp(-0.5 * (np.arange(40) / 15.0) ** 2)
    assert np.abs(mean - w / w.sum()).max() < 0.006
    # particles of different entities are drawn apart
    assert np.abs(got["e0", 1, 1] - got["e1", 1, 1]).max() > 0


def evidence(seen):
    out = np.ones(12)
    out[:6] = 1e-4
    return out


def test_resampled_copies_get_paths_of_their_own(spark):
    # all but a fifth of the paths run through cells that are watched
    rows = [(f"t{i:02}", k, 3 if k == 0 else (2 if i % 5 else 7 + k % 4), k) for i in range(50) for k in range(8)]
    steps = steps_of(spark, [("e", s, 3 if s == 0 else -1, 1) for s in range(8)])
    got = probabilities(p.score(steps, ["who", "segment"], states(spark, rows), line(spark, 12), models_of(12), [PF], evidence, m=256))
    assert all(got["e", 1, s][6:].sum() > 0.95 for s in range(1, 8))
    again = probabilities(p.score(steps.repartition(5), ["who", "segment"], states(spark, rows).repartition(3), line(spark, 12), models_of(12), [PF], evidence, m=256))
    assert all(np.array_equal(got[k], again[k]) for k in got)


def test_agrees_with_the_filter_in_one_process(spark):
    rng = np.random.default_rng(4)
    n, rows = 12, []
    for i in range(150):
        at = int(rng.integers(0, n))
        for k in range(int(rng.integers(3, 12))):
            rows.append((f"t{i:03}", k, at, k))
            at = int(np.clip(at + rng.integers(-1, 2), 0, n - 1))
    lib = b.Library(
        np.array([r[2] for r in rows]), np.zeros(len(rows), int), np.array([float(r[3]) for r in rows]), np.zeros(len(rows), int), np.full(len(rows), np.nan), np.full(len(rows), 2),
        np.full(len(rows), -1), np.zeros((len(rows), 2)), np.array([i + 1 if i + 1 < len(rows) and rows[i + 1][0] == rows[i][0] else -1 for i in range(len(rows))]), n,
    )
    models = models_of(n)
    models.library = lib
    seen = [-1, -1, 4, -1, -1, -1, -1, -1, 9, -1, -1, -1]
    ep = b.Episode(0, np.arange(12.0), np.zeros(12, int), np.array(seen)[:, None], np.ones((12, 1), bool), np.ones((12, 1), int), unseen=np.stack([0.3 + 0.7 * (np.arange(n) > 5)] * 12))
    want = list(b.run_particles(ep, models, PF.parts[0][1], m=20_000))
    steps = steps_of(spark, [("e", s, x, 1) for s, x in enumerate(seen)])
    got = probabilities(p.score(steps, ["who", "segment"], states(spark, rows), line(spark, n), models, [PF], lambda _: 0.3 + 0.7 * (np.arange(n) > 5), m=20_000))
    at = {0: 0, 1: 2, 2: 8}
    assert len(got) == 10
    for (_, segment, step), x in got.items():
        # the array version starts anywhere in the first seconds, this one at starts only, so segment 0 is left out
        if segment:
            assert np.abs(x - want[at[segment] + step][0]).max() < 0.03, (segment, step)


def test_sniper_weights_heed_neither_knives_nor_the_unknown():
    from types import SimpleNamespace

    k = 6
    lib = SimpleNamespace(t=np.zeros(k), phase=np.zeros(k, int), since=np.zeros(k), buy=np.full(k, 2), weapon=np.array([-1, 0, 1, 2, 3, 4]), velocity=np.zeros((k, 2)))
    w = lambda weapon, mode: b.state_weights(lib, np.arange(k), 0.0, 0, 0.0, None, None, weapon, b.Recursion("particles", other_weapon=0.5, weapons=mode)).round(6).tolist()
    assert w(0, "awp") == [1, 1, 0.5, 0.5, 0.5, 1] and w(1, "awp") == [1, 0.5, 1, 1, 1, 1]
    assert w(4, "awp") == w(-1, "awp") == w(4, "guns") == [1] * 6
    assert w(1, "guns") == [1, 0.5, 1, 0.5, 0.5, 1] and w(4, "all") == [1, 0.5, 0.5, 0.5, 0.5, 1]


def test_one_plain_particle_recursion_is_asked_for(spark):
    named = b.configurations()
    for configs in ([named["hmm"]], [named["ens"]], [named["pf"], named["pf_noneg"]]):
        with pytest.raises(ValueError):
            p.score(steps_of(spark, []), ["who", "segment"], states(spark, []), line(spark, 6), models_of(6), configs + [named["ens_fire_wait"]])


def test_episodes_side_by_side_are_those_one_by_one(spark, monkeypatch):
    """Several sides, phases, dead and unknown entities, sightings that are looked at, and sparse and full chains."""
    rng = np.random.default_rng(6)
    row, col = np.indices((12, 12)).reshape(2, -1)
    full = rng.random((12, 12))
    full /= full.sum(1, keepdims=True)
    near = np.abs(row - col) <= 1
    walk = b.Chain(row[near], col[near], 1.0 / np.array([2 if x in (0, 11) else 3 for x in row[near]]), 12)
    sparse = b.Chain(np.arange(12), (np.arange(12) + 1) % 12, np.ones(12), 12)
    first = rng.random((2, 12))
    first /= first.sum(1, keepdims=True)
    models = b.Models({(0, 0, 1, -1): b.Chain(row, col, full.ravel(), 12), (1, 0, 5, -1): sparse}, walk, first, {(s, p): np.stack([first[s], first[1 - s]]) for s in (0, 1) for p in (0, 1)}, np.arange(12) // 4)
    rows = [(f"k{k % 7}" if k % 9 else None, k, k % 2, i, 1.7 * i, int(i > 5), [int(rng.integers(12)) if rng.random() < 0.3 else -1], [bool(rng.random() < 0.9)], [int(rng.integers(-1, 12))]) for k in range(40) for i in range(1 + k % 13)]
    steps = spark.createDataFrame(rows, "name string, k long, side int, step int, t double, phase int, seen array<int>, alive array<boolean>, true array<int>").repartition(3)
    named = b.configurations()
    configs = [named[x] for x in ("last_seen", "prior", "prior_neg", "diffuse", "hmm_noneg", "hmm")] + [b.BeliefConfig("mixed", ((0.4, named["hmm"].parts[0][1]), (0.6, named["prior"].parts[0][1])))]
    unseen = lambda x: np.where(np.arange(12) % 5 == x[0] % 5, 0.4, 1.0)
    monkeypatch.setattr(b, "TOGETHER", 50)
    together = b.score(steps, ["name", "k"], models, configs, unseen=unseen)
    alone = b.score(steps.withColumn("friends", F.lit(-1)), ["name", "k"], models, configs, unseen=unseen)
    key = lambda r: (r.k, r.model, r.step)
    got, want = (sorted(x.collect(), key=key) for x in (together, alone))
    assert len(got) == len(want) > 500 and together.schema == alone.schema
    for x, y in zip(got, want, strict=True):
        assert all(u == pytest.approx(v, abs=1e-12) if isinstance(v, float) or isinstance(v, list) else u == v for u, v in zip(x, y, strict=True)), (x, y)
    # an episode of two entities is taken by itself
    two = [(0, 0, i, 1.0 * i, 0, [i % 3 - 1, -1], [True, True], [1, 2]) for i in range(5)]
    pair = spark.createDataFrame(two, "k long, side int, step int, t double, phase int, seen array<int>, alive array<boolean>, true array<int>")
    assert {r.entity for r in b.score(pair, ["k"], models, configs, unseen=unseen).collect()} == {0, 1}
    assert "MapInArrow" in together._jdf.queryExecution().toString()


def test_only_tables_of_a_map_are_broadcast(spark, monkeypatch):
    """Steps, requests, states and trajectories grow with the input; small as their files are, they go by shuffles."""
    plans, stored = {}, p.stored

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(p, "stored", kept)
    rows = [(f"t{i:02}", k, (i + k) % 12, k) for i in range(24) for k in range(4)]
    steps = steps_of(spark, [(f"e{e}", s, e if s == 0 else -1, 1) for e in range(3) for s in range(4)])
    p.score(steps, ["who", "segment"], states(spark, rows), line(spark, 12), models_of(12), [PF], m=8)
    assert {"requests", "pieces", "weighed"} <= plans.keys() and "SortMergeJoin [traj" in plans["pieces"]
    for label in set(plans) - {"rings"}:
        for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plans[label]):
            assert set(re.findall(r"([a-z_]+)#", keys)) <= {"side", "node", "near"}, (label, keys)


def test_weights_of_states_that_are_alike_equal_the_general_ones():
    from types import SimpleNamespace

    rng, k = np.random.default_rng(3), 40
    plain = SimpleNamespace(t=rng.random(k) * 90, phase=np.zeros(k, int), since=np.full(k, np.nan), buy=np.full(k, 2), weapon=np.full(k, -1), velocity=np.zeros((k, 2)))
    mixed = SimpleNamespace(t=plain.t, phase=rng.integers(0, 2, k), since=np.where(rng.random(k) < 0.5, np.nan, 3.0), buy=rng.integers(0, 3, k), weapon=rng.integers(-1, 5, k), velocity=rng.normal(0, 30, (k, 2)))
    armed = b.Recursion("particles", other_weapon=0.5)
    for lib in (plain, mixed):
        for phase in (0, 1):
            for since in (np.nan, 4.0):
                for buy in (None, np.array([0.2, 0.3, 0.5])):
                    for heading in (None, np.zeros(2), np.array([30.0, 0.0])):
                        for cfg, weapon in ((PF.parts[0][1], -1), (armed, 1)):
                            asked = (12.5, phase, since, buy, heading, weapon, cfg)
                            assert np.array_equal(p._Alike(lib).weights(*asked), b.state_weights(lib, np.arange(k), *asked))


def mixed_list(k, at=3):
    """A list of k candidates of all kinds of one cell, held as a group of draws holds it."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    since, weapon = pa.array(rng.random(k) * 20, mask=rng.random(k) < 0.4), pa.array(rng.integers(-1, 5, k).astype(np.int32))
    held = {"node": np.full(k, at, np.int32), "id": np.arange(k), "t": rng.random(k) * 90, "phase": rng.integers(0, 2, k).astype(np.int32), "since": since, "buy": rng.integers(0, 3, k).astype(np.int32), "weapon": weapon, "vx": rng.normal(0, 30, k), "vy": rng.normal(0, 30, k)}
    ones = p._packed(np.zeros(k, np.int16), np.ones(k, int))
    return p._Lists(pa.table(held | {"rest": ones, "restx": pa.nulls(k, pa.binary()), "resty": pa.nulls(k, pa.binary())}), 12, np.int16, b.Recursion("particles", other_weapon=0.5), 0)


SITUATIONS = [(12.5, 0, np.nan, None, None, -1), (300.0, 1, 4.0, None, None, 1), (40.0, 0, 4.0, [0.2, 0.3, 0.5], [30.0, 0.0], 1), (40.0, 2, np.nan, [0.2, 0.3, 0.5], [0.0, 0.0], 4)]


def drawn(lists, many):
    """Draws for all SITUATIONS at once."""
    t, phase, since, buy, heading, weapon = zip(*SITUATIONS, strict=True)
    array = lambda x, width: np.array([v if v is not None else [np.nan] * width for v in x])
    spot = np.repeat(np.arange(len(t)), many)
    own = np.arange(len(spot)) * np.int64(0x632BE59BD9B4E019)
    return spot, *lists.draw(np.zeros(len(t), int), spot, own, np.array(t), np.array(phase), np.array(since), array(buy, 3), array(heading, 2), np.array(weapon))


@pytest.mark.parametrize("tries", [16, 1])
def test_draws_by_bounds_follow_the_weights(monkeypatch, tries):
    """Also where most are left to the weighed list; and the race's numbers are exponential by the total weight."""
    monkeypatch.setattr(p, "TRIES", tries)
    lists = mixed_list(60)
    spot, place, race = drawn(lists, 60_000)
    for i, (t, phase, since, buy, heading, weapon) in enumerate(SITUATIONS):
        w = b.state_weights(lists.lib, np.arange(60), t, phase, since, None if buy is None else np.array(buy), None if heading is None else np.array(heading), weapon, lists.cfg)
        share = w / w.sum()
        got = np.bincount(place[spot == i], minlength=60) / 60_000
        assert np.abs(got - share).max() < 5 * np.sqrt(share.max() / 60_000), i
        assert race[spot == i].mean() * w.sum() == pytest.approx(1, abs=0.03), i


def test_a_draw_does_not_weigh_all_of_its_list(monkeypatch):
    """Work grew with requests times candidates: at 6 times the input, 36 times."""
    weighed, weights = [], b.state_weights
    monkeypatch.setattr(b, "state_weights", lambda lib, found, *a: (weighed.append(len(found)), weights(lib, found, *a))[1])
    lib = list_by_clock(20_000)
    for spots in (100, 1000):
        weighed.clear()
        of = np.zeros(spots, int)
        lib.draw(of, np.arange(spots), np.arange(spots) * np.int64(0x632BE59BD9B4E019), np.linspace(0, 90, spots), of, np.full(spots, 4.0), None, np.zeros((spots, 2)), of - 1)
        assert sum(weighed) < 3 * spots


def list_by_clock(k):
    """A list of states that differ in their clocks alone."""
    import pyarrow as pa

    rng, zero = np.random.default_rng(6), np.zeros(k, np.int32)
    held = {"node": zero, "id": np.arange(k), "t": rng.random(k) * 90, "phase": zero, "since": pa.nulls(k, pa.float64()), "buy": zero, "weapon": zero - 1, "vx": np.zeros(k), "vy": np.zeros(k)}
    return p._Lists(pa.table(held | {"rest": p._packed(np.zeros(k, np.int16), np.ones(k, int)), "restx": pa.nulls(k, pa.binary()), "resty": pa.nulls(k, pa.binary())}), 12, np.int16, PF.parts[0][1], 0)


@pytest.mark.parametrize("most", [1, 3])
def test_paths_through_cells_of_several_parts(spark, monkeypatch, most):
    """The path of test_one_recorded_path..., where cells are in parts or blocks of their own."""
    monkeypatch.setattr(p, "MOST_CANDIDATES", most)
    lib = states(spark, [("a", i, 5 + i, 10 + i) for i in range(4)] + [("b", 0, 8, 13), ("b", 1, 9, 14)])
    got = probabilities(p.score(steps_of(spark, [("e", s, 5 if s == 2 else -1, 1) for s in range(8)]), ["who", "segment"], lib, line(spark, 12), models_of(12), [PF], m=64, least=1))
    assert [int(got["e", 1, s].argmax()) for s in (1, 2, 3)] == [6, 7, 8]
    # the fourth step is drawn at 8 anew: by both of its states, of which that of b goes on to 9, and that of a ends and is drawn again
    assert got["e", 1, 4][[8, 9]].sum() > 0.99
    assert all(np.isclose(x.sum(), 1) for x in got.values()) and len(got) == 7


def test_moving_armed_states_agree_with_the_filter_in_one_process(spark):
    """Velocities, weapons, buys and phases, episodes that are taken one by one, and resampled copies."""
    rng = np.random.default_rng(7)
    n, rows = 12, []
    for i in range(200):
        at = int(rng.integers(0, n))
        for k in range(int(rng.integers(3, 10))):
            # all that leave a cell are of one speed, so whose heading is a cell's does not matter
            rows.append((f"t{i:03}", k, 0, at, float(k), i % 2, None, i % 3, i % 5, 30.0 if at < 6 else 0.0, 0.0))
            at = int(np.clip(at + rng.integers(-1, 2), 0, n - 1))
    column = lambda i: np.array([r[i] for r in rows])
    follows = np.array([i + 1 if i + 1 < len(rows) and rows[i + 1][0] == rows[i][0] else -1 for i in range(len(rows))])
    models = models_of(n)
    models.library = b.Library(column(3), np.zeros(len(rows), int), column(4), column(5), np.full(len(rows), np.nan), column(7), column(8), np.stack([column(9), column(10)], 1), follows, n)
    cfg = b.Recursion("particles", other_weapon=0.3, kills=False)
    seen, weapon, phase = [4, -1, -1, -1, -1, -1, 9, -1, -1], [1, -1, -1, -1, -1, -1, 2, -1, -1], [0, 0, 0, 1, 1, 1, 1, 1, 1]
    away = lambda _: np.where(np.arange(n) == 5, 1e-3, 1.0)
    buy = np.array([[0.6, 0.3, 0.1]] * 9)
    ep = b.Episode(0, np.arange(9.0), np.array(phase), np.array(seen)[:, None], np.ones((9, 1), bool), np.ones((9, 1), int), unseen=np.stack([away(None)] * 9), weapon=np.array(weapon)[:, None], buy={"estimate": buy})
    want = list(b.run_particles(ep, models, cfg, m=20_000))
    df = spark.createDataFrame([("e", 0, s, float(s), phase[s], [seen[s]], [True], [1], [weapon[s]], buy[s].tolist()) for s in range(9)], "who string, side int, step int, t double, phase int, seen array<int>, alive array<boolean>, true array<int>, weapon array<int>, buy array<double>")
    got = probabilities(p.score(p.segments(df, ["who"]), ["who", "segment"], spark.createDataFrame(rows, p.STATE), line(spark, n), models, [b.BeliefConfig("pf", ((1.0, cfg),))], away, m=20_000))
    assert len(got) == 7
    for (_, segment, step), x in got.items():
        assert np.abs(x - want[{1: 0, 2: 6}[segment] + step][0]).max() < 0.03, (segment, step)
