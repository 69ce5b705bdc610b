"""From synthetic matches through storage to maps, models, beliefs and scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.operators import belief as b
from fogline.operators import graph, maps, scoring
from fogline.sources import schemas, store
from tests import generator


@pytest.fixture(scope="module")
def tables(spark):
    return {k: v.persist() for k, v in generator.matches(spark).items()}


@pytest.fixture(scope="module")
def matches(spark, tables, tmp_path_factory):
    s = store.MatchStore(spark, str(tmp_path_factory.mktemp("matches")))
    for name in schemas.TABLES:
        s.write(name, tables[name])
    s.write_meta(tables["meta"])
    return s


def test_tables_survive_storage(spark, tables, matches):
    for name in ("ticks", "rounds", "kills", "shots"):
        assert matches.read(name).count() == tables[name].count()
    one = tables["meta"].limit(1)
    assert {r.demo_id for r in matches.read("ticks", demos=one).select("demo_id").distinct().collect()} == {one.first().demo_id}
    assert matches.read("ticks", sources=["none"]).count() == 0
    assert matches.read("ticks", columns=["tick"]).columns == ["source", "demo_id", "tick"]
    plan = matches.read("ticks", ["synthetic"], columns=["tick"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "place" not in plan.rsplit("ReadSchema", 1)[1]


def test_a_refresh_replaces_only_its_matches(spark, tables, matches):
    before = {r.demo_id: r["count"] for r in matches.read("smokes").groupBy("demo_id").count().collect()}
    demo = sorted(before)[0]
    kept = matches.read("smokes").where(F.col("demo_id") == demo).limit(1)
    matches.write("smokes", spark.createDataFrame(kept.collect(), kept.schema))
    after = {r.demo_id: r["count"] for r in matches.read("smokes").groupBy("demo_id").count().collect()}
    assert after == before | {demo: 1}
    matches.write("smokes", tables["smokes"])


def test_catalog_splits_and_todo(spark, tables, matches, tmp_path):
    ids = sorted(r.demo_id for r in matches.demos().collect())
    lists = [spark.createDataFrame([(ids[0], "val"), (ids[1], "val")], schemas.SPLITS), spark.createDataFrame([(ids[0], "test")], schemas.SPLITS)]
    assert {r.demo_id: r.split for r in matches.demos(listed=lists).collect()} == {ids[0]: "test", ids[1]: "val"}
    assert matches.demos(splits=["val"], listed=lists).count() == 1
    found = spark.createDataFrame([("synthetic", ids[0]), ("synthetic", "new")], "source string, demo_id string")
    assert [r.demo_id for r in matches.todo(found).collect()] == ["new"]
    store.write_csv(lists[0], f"{tmp_path}/splits")
    assert sorted(map(tuple, store.read_splits(spark, f"{tmp_path}/splits").collect())) == [(ids[0], "val"), (ids[1], "val")]
    names = spark.createDataFrame([("x-m1-mirage.dem",), ("X-M2-MIRAGE.dem",), ("x-m3-nuke.dem",), ("mirage.dem",)], "path string")
    assert [r.number for r in store.wanted_entries(names, "mirage").orderBy("number").collect()] == [1, 2]


def test_caches_and_missing_parts(spark, matches, tmp_path):
    a = spark.createDataFrame([("k", 1, {"A": 1.0}), ("k", 2, None), ("j", 1, {"B": 1.0})], "key string, written int, answers map<string,double>")
    store.append_answers(a, f"{tmp_path}/cache")
    store.append_answers(a.where("key = 'k' and written = 1").withColumn("written", F.lit(5)), f"{tmp_path}/cache")
    got = store.read_answers(spark, f"{tmp_path}/cache", "key string, written int, answers map<string,double>")
    assert sorted((r.key, r.written) for r in got.collect()) == [("j", 1), ("k", 5)]
    assert matches.load_part("m", "spot") is None
    matches.save_model("m", {"spot": a.select("key")})
    assert matches.load_part("m", "spot").count() == 3
    assert store.model_name(["b", "a"]) == "a+b"
    calls = []
    make = lambda: calls.append(1) or a.select("key")
    assert store.once(spark, f"{tmp_path}/once", make).count() == store.once(spark, f"{tmp_path}/once", make).count() == 3 and len(calls) == 1


@pytest.fixture(scope="module")
def world(spark, tables):
    play = maps.in_play(tables["ticks"].where("is_alive"), tables["rounds"]).persist()
    grid = maps.build_grid(play)
    grid.cells, grid.edges = grid.cells.persist(), grid.edges.persist()
    return play, grid


def test_the_grid_is_the_map(world):
    _, grid = world
    cells = grid.cells.collect()
    assert len(cells) == len(generator.cells()) and sorted(r.node for r in cells) == list(range(len(cells)))
    assert sum(r.floor == 1 for r in cells) == 6 and {r.place for r in cells} <= set(generator.PLACES)
    assert grid.edges.count() == len({(r.src, r.dst) for r in grid.edges.collect()})


def test_positions_are_found_again(spark, world):
    play, grid = world
    at = maps.on_grid(play.where("tick % 16 = 0"), grid).join(grid.cells.select("node", F.col("x").alias("cx2"), F.col("y").alias("cy2"), F.col("z").alias("cz")), "node")
    far = at.where((F.hypot(F.col("X") - F.col("cx2"), F.col("Y") - F.col("cy2")) > 64) | (F.abs(F.col("Z") - F.col("cz")) > 60)).count()
    assert far <= 0.03 * at.count()
    lost = spark.createDataFrame([(-4000.0, -4000.0, 0.0)], "X double, Y double, Z double")
    assert maps.on_grid(lost, grid).first().node is not None


@pytest.fixture(scope="module")
def states(world, tables):
    play, grid = world
    located = maps.on_grid(play.where("tick % 16 = 0"), grid)
    named = located.join(grid.cells.select("node", F.col("place").alias("region")), "node")
    buys = maps.team_buys(tables["ticks"], tables["rounds"])
    from fogline.functions.bins import weapon_class

    return maps.since_seen(named).join(buys, ["demo_id", "round_num", "side"], "left").withColumn("weapon_class", weapon_class(F.col("weapon"))).persist()


def test_the_walk_is_recovered(states, world):
    _, grid = world
    m = maps.motion_tables(states, grid.cells, grid.edges)
    for name in ("walk", "base", "learned"):
        keys = [c for c in m[name].columns if c not in ("next_node", "p")]
        assert all(abs(r.s - 1) < 1e-9 for r in m[name].groupBy(*keys).agg(F.sum("p").alias("s")).collect())
    stay = m["base"].where("node = next_node").groupBy("side").agg(F.avg("p").alias("p")).collect()
    assert all(abs(r.p - 0.4) < 0.12 for r in stay)
    for name in ("spawn", "occupancy"):
        keys = [c for c in m[name].columns if c not in ("node", "n", "p")]
        assert all(abs(r.s - 1) < 1e-9 for r in m[name].groupBy(*keys).agg(F.sum("p").alias("s")).collect())


def test_library_and_line_ups(states):
    lib = maps.trajectory_library(states)
    linked = lib.where("next is not null")
    assert linked.join(lib.select(F.col("state").alias("next"), F.col("t").alias("t2")), "next").where("abs(t2 - t - 0.25) < 1e-6").count() == linked.count()
    ups = maps.line_ups(states)
    assert ups.where("size(places) <> alive or alive > 5 or alive < 1").count() == 0
    assert ups.where(F.col("places") != F.array_sort("places")).count() == 0


def test_sight_and_fires(world, tables):
    play, grid = world
    lines = maps.sight_lines(grid.cells, maps.pixel_bands(play))
    n = grid.cells.count()
    assert lines.where("a = b").count() == n
    assert lines.join(lines.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti").count() == 0
    rings = maps.fire_rings(play, tables["infernos"].withColumn("start_tick", F.col("start_tick")))
    assert rings.count() > 5 and rings.where("occupancy < 0").count() == 0


def test_from_states_to_scores(spark, states, world):
    """A whole evaluation: models from the states, beliefs by round and side, metrics."""
    _, grid = world
    m = maps.motion_tables(states, grid.cells, grid.edges)
    n = grid.cells.count()
    side = {"t": 0, "ct": 1}
    walk = m["walk"].toPandas()
    chains = {}
    for key, part in m["learned"].toPandas().groupby(["side", "phase", "sbin"]):
        have = set(part.node)
        rest = walk[~walk.node.isin(have)]
        chains[side[key[0]], key[1], key[2], -1] = b.Chain(np.append(part.node, rest.node), np.append(part.next_node, rest.next_node), np.append(part.p, rest.p), n)
    spawn = np.zeros((2, n))
    for r in m["spawn"].collect():
        spawn[side[r.side], r.node] = r.p
    occupancy = {(s, p): np.full((36, n), 1.0 / n) for s in (0, 1) for p in (0, 1, 2)}
    for r in m["occupancy"].collect():
        occupancy[side[r.side], r.phase][r.tbin, r.node] = r.p
    places = {p: i for i, p in enumerate(generator.PLACES)}
    region = np.array([places.get(r.place, 0) for r in grid.cells.orderBy("node").collect()])
    models = b.Models(chains, b.Chain(walk.node, walk.next_node, walk.p, n), spawn, occupancy, region)
    keys = ["demo_id", "round_num", "side_name"]
    per = states.withColumn("e", F.struct("steamid", F.when(F.col("spotted"), F.col("node")).otherwise(-1).alias("seen"), F.col("node").alias("true")))
    steps = per.groupBy("demo_id", "round_num", F.col("side").alias("side_name"), "tick").agg(F.array_sort(F.collect_list("e")).alias("e"), F.min("t").alias("t"), F.min("phase").alias("phase"))
    who = per.groupBy("demo_id", "round_num", F.col("side").alias("side_name")).agg(F.array_sort(F.collect_set("steamid")).alias("who"))
    steps = steps.join(who, keys).withColumn("m", F.map_from_entries(F.transform("e", lambda x: F.struct(x["steamid"], x))))
    of = lambda f: F.transform("who", lambda w: F.coalesce(F.element_at("m", w)[f].cast("long"), F.lit(-1)))
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy(*keys).orderBy("tick")) - 1
    rows = steps.select(*keys, F.when(F.col("side_name") == "t", 0).otherwise(1).alias("side"), step.alias("step"), "t", "phase", of("seen").alias("seen"), F.transform("who", lambda w: F.map_contains_key("m", w)).alias("alive"), of("true").alias("true"))
    named = b.configurations()
    samples = b.score(rows, keys, models, [named[k] for k in ("last_seen", "prior", "hmm_noneg")]).persist()
    s = {r.model: r for r in scoring.summary(samples.withColumn("r", F.col("region_rank")), [["model"]], "r", "p_region").collect()}
    assert s["hmm_noneg"].log_loss < s["prior"].log_loss and s["hmm_noneg"].log_loss < s["last_seen"].log_loss
    assert samples.where("abs(aggregate(probs, 0D, (a, x) -> a + x) - 1) > 1e-6").count() == 0
    distances = graph.shortest_paths(grid.edges)
    assert distances.where("src = dst and distance <> 0").count() == 0


def test_smokes_blinds_and_factors_reach_the_looks(spark):
    from fogline.operators import sight

    cells = spark.createDataFrame([(i, 300.0 * i, 0.0, 0.0) for i in range(3)], "node long, x double, y double, z double")
    lines = spark.createDataFrame([(a, c, True, True) for a in range(3) for c in range(3)], "a long, b long, walk boolean, carve boolean")
    tables = [np.zeros(32), np.zeros(36), np.zeros(10)]
    factors = spark.createDataFrame([(0, 2, 0.1)], "a long, b long, factor double")
    watcher = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0)], "tick int, node long, X double, Y double, Z double, yaw double, pitch double")
    missed = lambda lines, smokes=None: dict(zip(*sight.looks(watcher, cells, lines, tables, ["tick"], smokes).select("looked", "missed").first(), strict=True))
    assert missed(sight.with_factors(lines, None)) == pytest.approx({0: 0.5, 1: 0.5, 2: 0.5})
    assert missed(sight.with_factors(lines, factors)) == pytest.approx({0: 0.5, 1: 0.5, 2: 0.95})
    cloud = spark.createDataFrame([(1, 450.0, 0.0)], "tick int, sx double, sy double")
    assert missed(sight.with_factors(lines, None), cloud) == pytest.approx({0: 0.5, 1: 0.5, 2: 1.0})
    kills = spark.createDataFrame([(1, 0, 0.0, 0.0, False), (2, 0, 0.0, 0.0, True)], "id int, node long, X double, Y double, obstructed boolean")
    like = {r.id: r.like for r in sight.shooter_likelihood(kills, cells, sight.with_factors(lines, factors), tables, ["id"]).collect()}
    assert like[1] == pytest.approx([1.0, 1.0, 0.145]) and like[2] == [1.0, 1.0, 1.0]


def test_slabs_block_and_sightings_open(spark):
    cells = spark.createDataFrame([(0, 8.0, 8.0, 0.0), (1, 168.0, 8.0, 0.0)], "node long, x double, y double, z double")
    flat = [(i, 0, 0.0, 0.0) for i in range(11)]
    bands = lambda rows: spark.createDataFrame(rows, "px int, py int, lo double, hi double")
    pairs = lambda rows, opened=None: {(r.a, r.b): (r.walk, r.carve) for r in maps.sight_lines(cells, bands(rows), opened).collect() if r.a < r.b}
    assert pairs(flat) == {(0, 1): (True, True)}
    slab = [(i, 0, 0.0, 80.0 if i == 5 else 0.0) for i in range(11)]
    assert pairs(slab) == {(0, 1): (True, True)}  # too low a gap for a floor
    slab = [(i, 0, -60.0, 62.0) if i == 5 else (i, 0, 0.0, 0.0) for i in range(11)]
    assert pairs(slab) == {}
    opened = spark.createDataFrame([(5, 0, 50.0, 60.0)], "px int, py int, low double, high double")
    assert pairs(slab, opened) == {(0, 1): (False, True)}


def test_floors_points_and_rays(spark):
    """Literal cases: the upper floor is the least height above the gap, a point is a walked pixel, rays go eye to eye."""
    rows = [(3.0, 3.0, z) for z in (5.0, 40.0, 116.0, 130.0, 300.0)] + [(20.0, 3.0, 7.0), (-1.0, 3.0, 1.0), (-1.0, 3.0, 112.0), (40.0, 60.0, 2.0)]
    positions = spark.createDataFrame(rows, "X double, Y double, Z double")
    bands = maps.pixel_bands(positions)
    assert {(r.px, r.py): (r.n, r.lo, r.hi) for r in bands.collect()} == {(0, 0): (5, 5.0, 116.0), (1, 0): (1, 7.0, 7.0), (-1, 0): (2, 1.0, 112.0), (2, 3): (1, 2.0, 2.0)}
    cells = spark.createDataFrame([(0, 0, 0, 30.0, 30.0), (1, 9, 9, 600.0, 600.0), (2, -1, 0, -40.0, 8.0)], "node long, cx int, cy int, x double, y double")
    # pixels of the first column: middles (8, 8), (24, 8), (40, 56)
    assert {r.node: (r.x, r.y) for r in maps.representative_points(cells, bands, 0.0, 0.0).collect()} == {0: (24.0, 8.0), 1: (600.0, 600.0), 2: (-8.0, 8.0)}
    ray = spark.createDataFrame([(1, 0.0, 8.0, 64.0, 160.0, 8.0, 64.0), (2, 0.0, 8.0, 0.0, 30.0, 8.0, 0.0)], "id int, ax double, ay double, az double, bx double, by double, bz double")
    got = sorted((r.id, r.px, r.z) for r in maps.ray_samples(ray).collect() if r.px is not None)
    assert got == [(1, int(8 * i // 16), 64.0) for i in range(3, 18)]  # none within 20 of an end
    flat = spark.createDataFrame([(i, 0, 0.0, 0.0) for i in range(11)], "px int, py int, lo double, hi double")
    clear = lambda b: {r.id: (r.walk, r.carve) for r in maps.clear_rays(ray, ["id"], b).collect()}
    assert clear(flat) == {1: (True, True), 2: (True, True)}
    assert clear(flat.where("px <> 4")) == {1: (False, False), 2: (True, True)}
    risen = flat.withColumn("lo", F.when(F.col("px") == 4, 57.0).otherwise(F.col("lo"))).withColumn("hi", F.greatest("lo", "hi"))
    assert clear(risen)[1] == (False, False)


def test_guns_of_the_feed_count_and_unknown_situations_take_the_overall_rates(spark):
    sniper, rifle = 0, 1
    guns = np.array([[0.6, 0.2, 0.15, 0.05], [0.3, 0.4, 0.2, 0.1], [0.1, 0.1, 0.6, 0.2]])
    prior, none = np.full((3, 3), 1 / 3), np.full((3, 2), -1)
    seen = np.array([[-1, -1], [rifle, -1], [-1, rifle]])
    feed = np.array([[-1, -1], [-1, -1], [sniper, -1]])
    base = b.estimated_buys(prior, seen, guns)
    assert (b.estimated_buys(prior, seen, guns, none) == base).all()
    got = b.estimated_buys(prior, seen, guns, feed)
    assert (got[:2] == base[:2]).all() and (got[2] != base[2]).any()
    want = (1 / 3) * (guns[:, 3] * guns[:, 2]) ** 0.7  # a sniper in the feed outdoes the rifle seen before
    assert got[2] == pytest.approx(want / want.sum())
    rates = maps.buy_rates(spark.createDataFrame([("x", 0), ("x", 2), ("y", 2), ("y", 1)], "situation string, buy int")).first()["p"]
    assert rates == [0.25, 0.25, 0.5]
    assert maps.buy_rates(spark.createDataFrame([], "situation string, buy int")).first()["p"] is None


def test_fire_choices_keep_every_cell(spark):
    """More next cells than any list would hold, and two fires: one row a move, the nearest fire's ring for a cell."""
    cells = spark.createDataFrame([(i, 20.0 * i, 0.0, 0.0) for i in range(30)], "node long, x double, y double, z double")
    learned = spark.createDataFrame([("t", 0, 5, 0, i, 1 / 30) for i in range(30)], "side string, phase int, sbin int, node long, next_node long, p double")
    row = lambda tick, node: ("d", 1, 7, "t", tick, 0, None, node, 20.0 * node, 0.0, 0.0)
    states = spark.createDataFrame([row(160, 0), row(176, 29)], "demo_id string, round_num int, steamid long, side string, tick int, phase int, since double, node long, X double, Y double, Z double")
    fires = spark.createDataFrame([("d", 1, 0.0, 0.0, 0.0, 0, 400), ("d", 1, 200.0, 0.0, 0.0, 0, 400)], "demo_id string, round_num int, X double, Y double, Z double, start_tick int, end_tick int")
    (r,) = maps.fire_choices(states, fires, cells, learned).collect()
    rings = np.minimum(np.minimum(np.arange(30), np.abs(np.arange(30) - 10)), 14)
    assert r.truth == 14 and r.base == pytest.approx(np.bincount(rings, minlength=15) / 30)
    assert maps.fire_choices(states, fires.withColumn("end_tick", F.lit(170)), cells, learned).count() == 0  # out where the move ends


def test_stored_tables_can_be_cleared(spark):
    from fogline.session import clear_stored, stored

    clear_stored(spark)
    df = stored(spark.range(3), "x")
    assert df.count() == 3 and clear_stored(spark) == 1 and clear_stored(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from fogline import session

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def check_tables(spark, samples, folder):
    """The tables of a run against SQL over its samples."""
    import duckdb

    from fogline.operators import reports
    from fogline.plans import evaluation

    samples.write.parquet(f"{folder}/samples")
    evaluation.write_tables(spark.read.parquet(f"{folder}/samples"), folder, "last_seen", draws=40)
    sql = duckdb.connect().execute(f"CREATE VIEW x AS SELECT * FROM '{folder}/samples/*.parquet'").execute("""CREATE VIEW a AS SELECT model, demo_id, round_num, friendly, step, region, sum(p) AS expected, sum((region = true_region)::INT) AS actual, bool_or(contact) AS contact, count(*) AS hidden
        FROM (SELECT *, unnest(range(len(probs))) AS region, unnest(probs) AS p FROM x) GROUP BY ALL""")
    csv = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}").collect()
    close = lambda x, y: sorted(x) == [tuple(pytest.approx(v) if isinstance(v, float) else v for v in r) for r in sorted(y)]
    team = spark.read.parquet(f"{folder}/team").groupBy("model", "contact").agg(F.count("*").alias("n"), F.sum("count_brier").alias("b"), F.sum("hidden").alias("h")).collect()
    want = sql.execute("SELECT model, contact, count(*), sum(b), sum(h)::BIGINT FROM (SELECT model, demo_id, round_num, friendly, step, bool_or(contact) AS contact, sum((expected - actual) ** 2) AS b, max(hidden) AS h FROM a GROUP BY ALL) GROUP BY ALL").fetchall()
    assert len(want) > 4 and close([tuple(r) for r in want], [tuple(r) for r in team])
    edges = " ".join(f"WHEN expected < {e} THEN {i}" for i, e in enumerate(reports.COUNTS[1:-1]))
    want = sql.execute(f"SELECT model, contact, CASE {edges} ELSE {len(reports.COUNTS) - 2} END AS bin, count(*), avg(expected), avg(actual) FROM a GROUP BY ALL").fetchall()
    assert close(want, [(r.model, r.contact, r.bin, r.n, r.expected, float(r.actual)) for r in csv("counts")])
    want = sql.execute("SELECT model, 'top3' AS metric, count(*), avg((region_rank < 3)::INT) FROM x WHERE since IS NOT NULL GROUP BY ALL UNION ALL SELECT model, 'cell_loss', count(*), avg(-ln(p_true)) FROM x WHERE since IS NOT NULL GROUP BY ALL").fetchall()
    got = csv("intervals")
    assert close(want, [(r.model, r.metric, r.n, r["mean"]) for r in got if r.metric in ("top3", "cell_loss")])
    assert all(r.lo <= r["mean"] + 1e-9 and r["mean"] <= r.hi + 1e-9 for r in got) and all((r["diff"] is None) == (r.model == "last_seen") for r in got)
    means = {(r.model, r.metric): r["mean"] for r in got}
    assert all(r["diff"] == pytest.approx(means[r.model, r.metric] - means["last_seen", r.metric]) for r in got if r["diff"] is not None)
    want = sql.execute("SELECT model, contact, count(*), avg((region_rank < 1)::INT) FROM x GROUP BY ALL").fetchall()
    assert close(want, [(r.model, r.after, r.n, r.top1) for r in csv("contact")])
    want = sql.execute("SELECT model, hidden, count(*) FROM x WHERE since IS NOT NULL AND friends = 1 GROUP BY ALL").fetchall()
    assert close(want, [(r.model, r.hidden, r.n) for r in csv("clutches")])
    picks = {r.model: r.picks_last for r in csv("picks")}
    assert picks["last_seen"] == pytest.approx(1.0) and 0 <= picks["hmm"] <= 1
    assert {r.horizon for r in csv("horizons")} <= set(reports.AGE_NAMES) and all(0 <= r.ece <= 1 for r in csv("ece"))
    assert sum(r.n for r in csv("reliability")) == sql.execute("SELECT sum(len(probs)) FROM x WHERE since IS NOT NULL").fetchone()[0]
    assert {r.contact for r in csv("team_intervals")} == {True, False} and len(csv("summary")) > 4
    assert sql.execute("SELECT count(*) FROM x WHERE contact <> (since IS NOT NULL) AND since IS NOT NULL").fetchone()[0] == 0


def test_fit_evaluate_calibrate(spark, tmp_path):
    """The three calls over a store, and the calibrated configuration after them."""
    from fogline.plans import evaluation

    tables = generator.matches(spark, 1, rounds=4, seconds=20, seed=3)
    s = store.MatchStore(spark, str(tmp_path))
    for name in schemas.TABLES:
        s.write(name, tables[name])
    s.write_meta(tables["meta"])
    evaluation.fit(s, "m")
    models, names, xy = evaluation.load(s, "m")
    assert models.fires is not None and (models.fires["occupancy"] <= 1).all() and (models.fires["step"] <= 1).all() and len(models.rings) == models.n
    assert models.library is not None and models.teams and models.calibration is None and len(xy) == models.n and "TSpawn" in names
    samples = evaluation.evaluate(s, "m", ["last_seen", "hmm", "hmm_noneg", "pf"]).persist()
    table = {(r.model, r.horizon): r for r in evaluation.report(samples).collect()}
    assert table["hmm", None].log_loss < table["last_seen", None].log_loss
    assert samples.groupBy("model").count().select("count").distinct().count() == 1
    steps = evaluation.episode_steps(s, "m", evaluation.states_of(s, evaluation.load_grid(s, "m"))).persist()
    assert steps.where("size(fires) > 0").count() > 0 and steps.where("size(kills) > 0").count() > 0
    bad = steps.where("size(kills) > 0").select(F.explode("kills").alias("k")).where(f"size(k.like) <> {models.n} or array_max(k.like) > 1 or array_min(k.like) < 0.05 - 1e-9 or k.e >= 5")
    assert bad.count() == 0 and steps.where("size(looked) <> size(missed)").count() == 0
    assert samples.where("p_region <> probs[true_region]").count() == 0
    check_tables(spark, samples, str(tmp_path / "run"))
    # every variant sees its own evidence: weapons, buys and fires change what their bases put out
    bases = {"hmm": ("hmm_weapon", "hmm_fire", "hmm_noneg"), "ens_nofire": ("ens_w0.7", "ens_w0.5", "ens_w0.3", "ens_awp0.5", "ens_awp0.3", "ens_guns0.5", "ens_hmmw", "ens_w0.5_hmmw", "ens_fire_occ", "ens_fire_wait", "ens_fire_weight", "ens_indep", "ens_seed1"), "ens_uncal": ("ens_truebuy", "ens_histbuy", "ens_nobuy", "ens_uncal_seed1", "ens_indep", "ens_team", "ens_team_best")}
    # the synthetic players walk through fires
    burnt = s.load_part("m", "fires").withColumn("occupancy", F.least(F.lit(1.0), F.col("lo") / 300 + 0.1)).collect()
    s.save_model("m", {"fires": spark.createDataFrame(burnt)})
    names = sorted({*bases, *(v for of in bases.values() for v in of)})
    every = evaluation.evaluate(s, "m", names).select("model", "demo_id", "round_num", "friendly", "step", "entity", "p_true").persist()
    own = every.withColumnsRenamed({"model": "base", "p_true": "p_base"})
    gaps = {(r.base, r.model): r.gap for r in every.join(own, ["demo_id", "round_num", "friendly", "step", "entity"]).groupBy("base", "model").agg(F.max(F.abs(F.col("p_true") - F.col("p_base"))).alias("gap")).collect()}
    assert not [(base, v) for base, of in bases.items() for v in of if gaps[base, v] < 1e-6]
    losses = evaluation.calibrate(s, "m", samples, "hmm", kinds=("power",))
    assert set(losses) == {"none", "power"}
    evaluation.fit(s, "m", only=["buys"])
    assert s.load_part("m", "buys").where("abs(aggregate(p, 0D, (a, x) -> a + x) - 1) > 1e-9").count() == 0
    assert evaluation.evaluate(s, "m", ["ens"]).where("p_true is null or p_true < 0").count() == 0
