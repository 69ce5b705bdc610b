"""Operators on literal rows and their invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.functions import bins, maths, words
from fogline.operators import belief as b
from fogline.operators import components, corrections, counting, fitting, graph, history, ingest, maps, scoring, temporal


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- time


def test_flashes_are_rebuilt_from_shuffled_durations(spark):
    first = [0.0, 3.2, 3.2, 3.4, 3.4, 0.0, 0.6]
    durations = [("m", 1, 10 + i, x) for i, x in enumerate(first)] + [("m", 2, 10 + i, 0.0) for i in range(7)]
    d = spark.createDataFrame(durations[::-1], "demo_id string, steamid long, tick int, blind_duration double")
    det = spark.createDataFrame([("m", 13, 6, 4), ("m", 11, 5, 3), ("m", 11, 9, 8)], "demo_id string, tick int, entityid int, attacker_steamid long")
    assert rows(ingest.flashes(d, det).select("tick", F.coalesce("attacker_steamid", F.lit(-1)), F.coalesce("entityid", F.lit(-1)))) == [(11, 3, 5), (13, 4, 6), (16, -1, -1)]


def test_grenades_end_at_the_next_strict_expiry(spark):
    starts = spark.createDataFrame([("m", 7, 100), ("m", 7, 2000), ("m", 8, 100), ("m", 9, 50)], "demo_id string, entity_id int, tick int")
    ends = spark.createDataFrame([("m", 7, 100), ("m", 7, 1200), ("m", 8, 9000), ("x", 9, 60)], "demo_id string, entity_id int, tick int")
    got = ingest.grenade_ends(starts, ends, 18).select("entity_id", "start_tick", "end_tick")
    assert rows(got) == [(7, 100, 1200), (7, 2000, 3152), (8, 100, 1252), (9, 50, 1202)]


def test_events_get_their_round(spark):
    rounds = spark.createDataFrame([("m", 1, None, 90), ("m", 2, 100, 200), ("m", 3, 300, 400)], "demo_id string, round_num int, freeze_end int, end int")
    events = spark.createDataFrame([("m", 50), ("m", 100), ("m", 200), ("m", 201), ("m", 350), ("n", 350)], "demo_id string, tick int")
    assert rows(ingest.with_round(events, rounds).select("tick", "round_num")) == [(100, 2), (200, 2), (350, 3)]


def test_plants_go_to_the_nearer_site(spark):
    ticks = spark.createDataFrame([("m", "BombsiteA", 0.0, 0.0), ("m", "BombsiteB", 100.0, 0.0), ("n", "BombsiteA", 0.0, 0.0)], "demo_id string, place string, X double, Y double")
    plants = spark.createDataFrame([("m", 1, 20.0, 5.0), ("m", 2, 80.0, 5.0), ("n", 1, 0.0, 0.0)], "demo_id string, round_num int, X double, Y double")
    got = ingest.plant_sites(plants, ticks).select("demo_id", "round_num", F.coalesce("bomb_site", F.lit("-")))
    assert rows(got) == [("m", 1, "bombsite_a"), ("m", 2, "bombsite_b"), ("n", 1, "-")]


def test_interval_join_bounds(spark):
    p = spark.createDataFrame([("k", t) for t in (999, 1032, 1399, 1400)], "k string, t int")
    s = spark.createDataFrame([("k", 1000, 1400)], "k string, s int, e int")
    assert [r[1] for r in rows(temporal.interval_join(p, s, ["k"], "t", "s", "e", 64).select("k", "t"))] == [1032, 1399]
    assert [r[1] for r in rows(temporal.interval_join(p, s, ["k"], "t", "s", "e", 64, closed=True, how="left_semi").select("k", "t"))] == [1032, 1399, 1400]


def test_fill_islands_and_asof_keep_keys_apart(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("b", 1, None), ("b", 2, 9)], "k string, t int, v int")
    strict = temporal.forward_fill(d, ["k"], ["t"], F.col("v"), F.col("v").isNotNull(), "f", strict=True).select("k", "t", F.coalesce("f", F.lit(-1)))
    assert rows(strict) == [("a", 1, -1), ("a", 2, 5), ("a", 3, 5), ("b", 1, -1), ("b", 2, -1)]
    steps = spark.createDataFrame([("a", s) for s in (1, 2, 3, 7, 8, 12)], "k string, s long")
    assert rows(temporal.islands(steps, ["k"], "s", 2).select("first", "last", "n", "place")) == [(7, 8, 2, 2), (12, 12, 1, 1)]
    left = spark.createDataFrame([("a", 5, 1), ("b", 5, 2)], "k string, t int, id long")
    right = spark.createDataFrame([("a", 5, 10), ("a", 6, 11)], "k string, t int, x int")
    assert rows(temporal.asof_backward(left, right, ["k"], "t", ["x"], "id").select("id", F.coalesce("x", F.lit(-1)))) == [(1, 10), (2, -1)]
    assert rows(temporal.asof_forward_strict(left, right, ["k"], "t", ["x"], "id").select("id", F.coalesce("x", F.lit(-1)))) == [(1, 11), (2, -1)]


# -- bins, maths, words


def test_bins_at_their_edges(spark):
    r = one(spark, *(bins.since_bin(F.lit(x)).alias(f"s{i}") for i, x in enumerate((0.0, 2.0, 25.0))), bins.since_bin(F.lit(None).cast("double")).alias("never"), bins.bin_left(F.lit(250.0), (250, 500)).alias("left"), bins.unit_bin(F.lit(1.0), (0, 0.5, 1)).alias("unit"), bins.fixed_bin(F.lit(-3.0), 5, 4).alias("low"), bins.fixed_bin(F.lit(99.0), 5, 4).alias("high"))
    assert tuple(r) == (0, 1, 4, 5, 0, 1, 0, 3)


def test_weapons(spark):
    names = ["AWP", "AK-47", "MP9", "Glock-18", "Knife", "ak47", "usp_silencer", "Negev"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", bins.weapon_class(F.col("n")).alias("c"))
    assert [r.c for r in got.orderBy("i").collect()] == [0, 1, 2, 3, 4, 1, 3, 2]


def test_split_shares(spark):
    shares = {r.s: r["count"] for r in spark.range(4000).groupBy(bins.split_of(F.concat(F.lit("demo"), F.col("id"))).alias("s")).count().collect()}
    assert 0.17 < shares["test"] / 4000 < 0.23 and 0.08 < shares["val"] / 4000 < 0.12


def test_segment_distance(spark):
    d = lambda *v: maths.segment_distance(*(F.lit(float(x)) for x in v))
    r = one(spark, d(5, 3, 0, 0, 10, 0).alias("a"), d(5, 3, 0, 0, 0, 10).alias("b"), d(13, 4, 0, 0, 10, 0).alias("c"), d(3, 4, 0, 0, 0, 0).alias("e"))
    assert tuple(r) == (3.0, 5.0, 5.0, 5.0)


def test_ties_are_shared_or_count_against(spark):
    p = F.array(*(F.lit(x) for x in (0.4, 0.4, 0.1, 0.1)))
    r = one(spark, maths.rank_against(p, F.lit(0)).alias("a"), maths.split_credit(p, F.lit(0), 1).alias("b"), maths.split_credit(p, F.lit(2), 1).alias("c"), maths.split_credit(p, F.lit(2), 3).alias("d"), maths.first_argmax(p).alias("e"))
    assert tuple(r) == (1, 0.5, 0.0, 0.5, 0)


def test_kernels(spark):
    never = F.lit(None).cast("double")
    r = one(spark, maths.log_time_kernel(never, never).alias("a"), maths.log_time_kernel(never, F.lit(1.0)).alias("b"), maths.class_kernel(F.lit(0), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("c"), maths.class_kernel(F.lit(1), F.array(F.lit(0.5), F.lit(0.0), F.lit(0.5))).alias("d"))
    assert tuple(round(x, 6) for x in r) == (1.0, 0.05, 0.49, 0.7)


def test_answers(spark):
    a = F.from_json(F.lit('{"Bombsite A": 3, "C": -1}'), "map<string,double>")
    zero = F.from_json(F.lit('{"Bombsite A": 0}'), "map<string,double>")
    r = one(spark, words.clean_answer(a, ["Bombsite A", "C"]).alias("a"), words.clean_answer(zero, ["Bombsite A"]).alias("z"), words.two_stage(F.lit(0.4), F.array(F.lit(0.75), F.lit(0.0), F.lit(0.25)), F.lit(1)).alias("s"), words.callout_name(F.lit("TopofMid")).alias("t"), words.callout_name(F.lit("NewPlace")).alias("n"))
    assert r.a == [1.0, 0.0] and r.z is None and [round(x, 6) for x in r.s] == [0.45, 0.4, 0.15] and (r.t, r.n) == ("Top of Mid", "New Place")


def test_prices(spark):
    r = one(spark, words.price(F.lit(700_000), F.lit(200_000), F.lit(100_000), F.lit(2_000_000), (0.10, 0.01, 0.125, 0.50)).alias("a"), words.price(F.lit(0), F.lit(0), F.lit(0), F.lit(2_000_000), (0, 0, 0, 0.5), 0.5).alias("b"), words.reach_fact(F.lit(6.0), F.lit(5.5), F.lit(4.0)).alias("c"), words.threshold_fact(F.lit(0.12), 0.25, 0.10).alias("d"))
    assert r.a == pytest.approx(0.7 * 0.10 + 0.2 * 0.01 + 0.1 * 0.125 + 2 * 0.50) and r.b == 0.5 and (r.c, r.d) == ("too far", "partly")


def test_calibration_maps_keep_order_and_sum(spark):
    rng = np.random.default_rng(0)
    for kind, theta in (("power", (2.0,)), ("platt", (1.3, 0.2)), ("piecewise", (0.5, 1.0, 2.0, 0.1))):
        p = rng.dirichlet(np.ones(6), 50)
        q = corrections.apply_map(p, kind, theta)
        assert np.allclose(q.sum(1), 1) and (np.argsort(p, 1) == np.argsort(q, 1)).all()
        column = {"power": lambda c: maths.power_map(c, 2.0), "platt": lambda c: maths.platt_map(c, 1.3, 0.2), "piecewise": lambda c: maths.piecewise_map(c, (0.5, 1.0, 2.0, 0.1))}[kind]
        got = one(spark, column(F.array(*(F.lit(float(x)) for x in p[0]))).alias("q")).q
        assert np.allclose(got, q[0], atol=1e-5)


# -- rounds


def test_loss_bonus_and_halves(spark):
    winners = ["ct", "t", "ct", "ct", "ct"] + ["t"] * 7 + ["ct", "t"]
    d = spark.createDataFrame([("m", i + 1, w == "t") for i, w in enumerate(winners)], "m string, number int, won boolean")
    half, place = history.half_numbers(F.col("number"))
    d = d.withColumn("half", half).withColumn("p", place)
    got = {r.number: (r.half, r.p, r.losses) for r in history.loss_bonus(d, ["m", "half"], ["p"], F.col("won")).collect()}
    assert got[3] == (1, 3, 0) and got[6] == (1, 6, 3) and got[13] == (2, 1, 0)
    late = spark.createDataFrame([(25,), (27,), (28,)], "number int").select(*history.half_numbers(F.col("number"))).collect()
    assert [tuple(r) for r in late] == [(3, 1), (3, 3), (4, 1)]


def test_knife_rounds_are_not_numbered(spark):
    rounds = spark.createDataFrame([("a", r) for r in (1, 2, 3)] + [("b", r) for r in (1, 2, 3)], "demo_id string, round_num int")
    kills = spark.createDataFrame([("a", 1, "knife"), ("a", 1, "world"), ("a", 2, "ak47"), ("b", 1, "knife"), ("b", 1, "ak47")], "demo_id string, round_num int, weapon string")
    assert rows(history.round_numbers(rounds, kills)) == [("a", 2, 1), ("a", 3, 2), ("b", 1, 1), ("b", 2, 2), ("b", 3, 3)]


# -- graphs


def test_components_of_stars_chains_and_loops(spark):
    edges = [(1, i) for i in range(2, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500), (7, 1), (900, 901), (901, 900), (None, 3)]
    got = dict(rows(components.connected_components(spark.createDataFrame(edges, "src long, dst long"))))
    assert all(got[i] == 1 for i in range(1, 60)) and all(got[100 + i] == 100 for i in range(41)) and got[500] == 500 and got[901] == 900
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_random_graphs_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(170)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s, d in edges:
        a, c = root(s), root(d)
        parent[max(a, c)] = min(a, c)
    assert rows(components.connected_components(spark.createDataFrame(edges, "src long, dst long"))) == sorted((x, root(x)) for x in parent)


def test_floors_majority_and_factors(spark):
    z = [0.0] * 9 + [5.0] + [200.0] * 8 + [500.0] * 3
    got = counting.floors(spark.createDataFrame([("c", x) for x in z], "c string, z double"), ["c"], "z", 110, 8)
    assert rows(got.select("floor", "n", "height")) == [(0, 10, 0.0), (1, 8, 200.0)]
    named = counting.majority(spark.createDataFrame([(1, "b"), (1, "a"), (2, ""), (2, None)], "node int, place string"), "node", "place")
    assert rows(named) == [(1, "a"), (2, "Unknown")]
    f = counting.pair_factors(spark.createDataFrame([(1, 2, 5, 3.0), (2, 1, 4, 1.0), (3, 3, 0, 2.0)], "a int, b int, k long, e double"), "a", "b")
    assert rows(f) == [(1, 2, 12 / 7), (2, 1, 12 / 7), (3, 3, 3 / 7)]


def test_shortest_paths_and_regions(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 5.0), (0, 2, 3.0), (3, 3, 0.0)], "src long, dst long, length double")
    d = {(r.src, r.dst): r.distance for r in graph.shortest_paths(e).collect()}
    assert d[0, 2] == 3.0 and d[1, 2] == 4.0 and d[2, 0] == 1e5 and d[3, 3] == 0.0


# -- scores and fits


def test_highest_density_keeps_ties(spark):
    d = spark.createDataFrame([(1, i, m) for i, m in enumerate((0.5, 0.2, 0.2, 0.1))], "k int, i int, m double")
    assert [r[1] for r in rows(scoring.highest_density(d, ["k"], "m", 0.7, "i").select("k", "i"))] == [0, 1, 2]


def test_bootstrap_covers_and_pairs(spark):
    rng = np.random.default_rng(1)
    data = [(m, c, float(x + (m == "b"))) for c in range(60) for m in "ab" for x in [rng.normal()]]
    r = {x.model: x for x in scoring.bootstrap(spark.createDataFrame(data, "model string, c int, v double"), "model", "c", "v", 400, pairs=[("b", "a")]).collect()}
    spread = np.std([v for m, _, v in data if m == "a"]) / np.sqrt(60)
    assert r["a"].lo < r["a"].mean < r["a"].hi and 3 * spread < r["a"].hi - r["a"].lo < 5 * spread
    assert r["b - a"].mean == pytest.approx(r["b"].mean - r["a"].mean)


def test_parameters_are_recovered(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(5), 4000)
    sharp = p**2 / (p**2).sum(1, keepdims=True)
    truth = [int(rng.choice(5, p=q)) for q in sharp]
    d = spark.createDataFrame([(q.tolist(), t, i % 4) for i, (q, t) in enumerate(zip(p, truth, strict=True))], "p array<double>, truth int, fold int")
    assert fitting.fit_calibration(d, "power")[0] == pytest.approx(2.0, abs=0.2)
    losses = fitting.choose_calibration(d, "fold", 2, ("power", "platt"))
    assert losses["power"] < losses["none"]
    x = rng.normal(size=(4000, 4, 2))
    u = np.exp(x @ [1.5, -0.7])
    chosen = [int(rng.choice(4, p=q / q.sum())) for q in u]
    d = spark.createDataFrame([(v.ravel().tolist(), t) for v, t in zip(x, chosen, strict=True)], "x array<double>, truth int")
    assert fitting.maximise(d, fitting.choice_likelihood(), (0.0, 0.0)) == pytest.approx([1.5, -0.7], abs=0.15)
    ends = fitting.bootstrap_weights(d.withColumn("c", F.monotonically_increasing_id()), "c", fitting.choice_likelihood(), (1.5, -0.7))
    assert all(lo < t < hi and 0.05 < hi - lo < 0.3 for (lo, hi), t in zip(ends, (1.5, -0.7), strict=True))
    loss, weights = fitting.held_out_loss(d.withColumn("fold", F.pmod(F.xxhash64("truth", "x"), F.lit(3))), "fold", 3, fitting.choice_likelihood(), (0.0, 0.0), pull=0.0)
    assert 0.3 < loss < 1.3 and weights == pytest.approx([1.5, -0.7], abs=0.2)
    bounded = fitting.maximise(d, fitting.choice_likelihood(), (0.0, 0.0), bounds=(-0.3, 1.0))
    assert bounded == pytest.approx([1.0, -0.3], abs=1e-6)


def test_binned_logit(spark):
    rng = np.random.default_rng(4)
    cells = [(i, j, 4000, int(rng.binomial(4000, 1 / (1 + np.exp(-(a + c)))))) for i, a in enumerate((-1.0, 0.0, 1.0)) for j, c in enumerate((-0.5, 0.5))]
    a, c = fitting.fit_binned_logit(spark.createDataFrame(cells, "i int, j int, n long, k long"), [("i", 3), ("j", 2)])
    assert a[2] - a[0] == pytest.approx(2.0, abs=0.15) and c[1] - c[0] == pytest.approx(1.0, abs=0.15)


# -- beliefs


def chain3():
    row, col = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 1, 2, 2, 0])
    return b.Chain(row, col, np.full(6, 0.5), 3)


def test_masked_moves_keep_mass():
    out = chain3().moved(np.array([1.0, 0.0, 0.0]), np.array([1.0, 0.1, 1.0]))
    assert out == pytest.approx([0.5 / 0.55, 0.05 / 0.55, 0.0])


def test_the_48_configurations_and_what_they_share():
    named = b.configurations()
    # ens_team_p100c and ens_uncal are two names of one configuration
    assert len(named) == 48 and len({(c.parts, c.output) for c in named.values()}) == 47
    assert named["ens"].parts == named["ens_uncal"].parts == named["ens_indep"].parts != named["ens_nofire"].parts
    assert named["ens_team_best"].parts == named["ens_team"].parts
    assert all(sum(w for w, _ in c.parts) == pytest.approx(1.0) for c in named.values())
    # an evaluation of all runs each recursion once
    assert len({p for c in named.values() for _, p in c.parts}) == 26


@pytest.mark.parametrize("single", [False, True])
def test_assignments_equal_all_permutations(single):
    rng = np.random.default_rng(3)
    for k in range(1, 6):
        fit = rng.choice([0.0, 0.5, 1.0, 2.0], (20, k, 5))
        total, share = corrections.assignments(fit, single)
        for row in range(20):
            ways = list(itertools.permutations(range(5), k))
            weights = [np.prod([fit[row, e, j] for e, j in enumerate(way)]) for way in ways]
            kept = [int(np.argmax(weights))] if single else range(len(ways))
            assert total[row] == pytest.approx(sum(weights[i] for i in kept))
            want = np.zeros((k, 5))
            for i in kept:
                for e, j in enumerate(ways[i]):
                    want[e, j] += weights[i]
            assert share[row] == pytest.approx(want)


def models3(**more):
    c = chain3()
    return b.Models({(0, 0, k, -1): c for k in range(6)}, c, np.array([[0.6, 0.3, 0.1]]), {(0, 0): np.array([[0.2, 0.3, 0.5]])}, np.array([0, 0, 1]), **more)


def episode3(steps=6, seen_at=2):
    seen = np.full((steps, 1), -1)
    seen[seen_at, 0] = 1
    e = b.Episode(0, np.arange(steps) * 0.25, np.zeros(steps, int), seen, np.ones((steps, 1), bool), np.ones((steps, 1), int))
    e.unseen = np.tile([1.0, 1.0, 0.2], (steps, 1))
    return e


def library3(n=300):
    rng = np.random.default_rng(0)
    node = rng.integers(0, 3, n)
    nxt = np.arange(1, n + 1)
    nxt[9::10] = -1
    return b.Library(node, np.zeros(n, int), rng.random(n) * 2, np.zeros(n, int), np.full(n, np.nan), np.full(n, 2), np.full(n, -1), np.zeros((n, 2)), nxt, 3)


@pytest.mark.parametrize("name", ["last_seen", "prior", "prior_neg", "diffuse", "hmm_noneg", "hmm", "pf_noneg", "pf", "ens_nofire", "ens_nokill"])
def test_beliefs_sum_to_one_and_collapse_on_sightings(name):
    cfg = b.configurations()[name]
    models = models3(library=library3(), smooth=None)
    for s, out in b.run_all(episode3(), models, [cfg]):
        assert out[name].sum(1) == pytest.approx(1.0)
        if s == 2 and "prior" not in name and len(cfg.parts) == 1:
            assert out[name][0, 1] > 0.99
        assert (out[name] >= 0).all()


def test_absence_moves_mass_away():
    named = b.configurations()
    for s, out in b.run_all(episode3(seen_at=5), models3(), [named["hmm"], named["hmm_noneg"]]):
        assert s == 5 or out["hmm"][0, 2] < out["hmm_noneg"][0, 2]


def fires3():
    e = episode3(steps=8, seen_at=0)
    e.unseen = None
    e.fire_step = {s: np.array([1.0, 0.0, 0.5]) for s in range(8)}
    e.fire_occ = {s: np.array([1.0, 0.1, 1.0]) for s in range(8)}
    return e


def test_particles_wait_and_weigh_at_fires():
    """A particle goes on with the chance of the next cell over that of its own; occupancy, not the step, weighs."""
    n = 4000
    node, nxt = np.tile([2, 2], n // 2), np.arange(n) + 1
    nxt[1::2] = -1
    lib = b.Library(node, np.zeros(n, int), np.zeros(n), np.zeros(n, int), np.full(n, np.nan), np.full(n, 2), np.full(n, -1), np.zeros((n, 2)), nxt, 3)
    e = fires3()
    e.seen[:] = -1
    models = models3(library=lib, smooth=None)
    moved = []
    for fires in ("", "wait"):
        runs = list(b.run_particles(e, models, b.Recursion("particles", fires=fires), m=2000))
        moved.append(runs[1][0])
    assert moved[0] == pytest.approx(moved[1])  # from 0.5 to 0.5 all go on
    weighed = list(b.run_particles(e, models3(library=library3(3000), smooth=None), b.Recursion("particles", fires="weight"), m=4000))[0][0]
    free = list(b.run_particles(e, models3(library=library3(3000), smooth=None), b.Recursion("particles"), m=4000))[0][0]
    want = free * [1.0, 0.1, 1.0]
    assert weighed == pytest.approx(want / want.sum(), abs=0.02)


def test_systematic_draws():
    w = np.array([0.1, 0.2, 0.7])
    assert np.bincount(b.systematic(np.repeat(w, 100) / 100, 0.5) // 100, minlength=3) == pytest.approx([30, 60, 210], abs=2)


def test_independent_line_ups_correct_nothing_and_stacks_do():
    grid = [(i, j) for i in range(4) for j in range(4)]
    flat = {"clock": np.zeros(16), "alive": np.full(16, 2), "buy": np.full(16, 2), "places": np.array([[*g, -1, -1, -1] for g in grid])}
    p = np.tile(np.array([0.4, 0.3, 0.2, 0.1]), (2, 1))
    sharp = b.LineUps(pseudo=0.0)
    assert corrections.team_ratio(flat, 0.0, None, p, sharp) == pytest.approx(1.0, abs=1e-6)
    stack = flat | {"places": np.array([[i % 4, i % 4, -1, -1, -1] for i in range(16)])}
    known = np.array([[0.97, 0.01, 0.01, 0.01], [0.25, 0.25, 0.25, 0.25]])
    out = known[1] * corrections.team_ratio(stack, 0.0, None, known, sharp)[1]
    assert out[0] / out.sum() > 0.9
    assert corrections.team_ratio(flat, 100.0, None, p, sharp) is None


def test_counted_line_ups_weigh_like_repeated_ones():
    rng = np.random.default_rng(4)
    n = 30
    once = {"clock": np.sort(rng.random(n)), "alive": np.full(n, 3), "buy": np.full(n, 2), "places": np.hstack([rng.integers(0, 4, (n, 3)), np.full((n, 2), -1)]), "count": rng.integers(1, 6, n)}
    repeated = {k: np.repeat(v, once["count"], axis=0) for k, v in once.items() if k != "count"}
    p = rng.dirichlet(np.ones(4), 2)
    for options in (b.LineUps(), b.LineUps(single=True)):
        assert corrections.team_ratio(once, 0.5, None, p, options) == pytest.approx(corrections.team_ratio(repeated, 0.5, None, p, options))


def test_fire_factors():
    x = np.array([50.0, 150.0, 250.0, 50.0])
    out = corrections.ring_factors(x, np.zeros(4), np.array([0, 0, 0, 500.0]), np.array([[0.0, 0, 0]]), np.array([0, 100.0, 200]), np.array([0.1, 0.5]))
    assert out.tolist() == [0.1, 0.5, 1.0, 1.0]
    both = corrections.ring_factors(x, np.zeros(4), np.zeros(4), np.array([[0.0, 0, 0], [200.0, 0, 0]]), np.array([0, 100.0, 200]), np.array([0.2, 0.6]))
    assert both.tolist() == [0.2, 0.2, 0.2, 0.2]


def test_buy_posterior_rises_with_rifles():
    guns = np.array([[0.7, 0.2, 0.05, 0.05], [0.3, 0.4, 0.2, 0.1], [0.1, 0.1, 0.6, 0.2]])
    p = [corrections.buy_posterior(np.array([0.4, 0.3, 0.3]), np.array([0, 0, k, 0]), guns)[2] for k in range(3)]
    assert p[0] < p[1] < p[2]


def test_situations(spark):
    t, f, z = F.lit(True), F.lit(False), F.lit(0)
    r = one(spark, maps.situation(F.lit(3), F.lit(1), t, t, z).alias("a"), maps.situation(F.lit(1), F.lit(1), t, t, z).alias("b"), maps.situation(F.lit(2), F.lit(2), f, f, z).alias("c"), maps.situation(F.lit(1), F.lit(3), f, t, z).alias("d"), maps.situation(F.lit(1), F.lit(7), f, f, F.lit(9)).alias("e"))
    assert tuple(r) == ("overtime", "pistol round", "after losing the pistol round", "lost round 2 after winning the pistol round", "after a loss, loss count 4")
