"""Moment documents, requests and reach on a literal round."""

import json

import pytest
from pyspark.sql import functions as F

from fogline.operators import documents as d

STATES = "demo_id string, round_num int, steamid long, side string, tick int, X double, Y double, Z double, region string, spotted boolean, buy int"


def state(who, side, tick, x, region, spotted=False, y=0.0, buy=2):
    return ("m", 1, who, side, tick, x, y, 0.0, region, spotted, buy)


@pytest.fixture(scope="module")
def round1(spark):
    """CTs 1 and 2 look for Ts 10 to 13: 10 runs and is lost, 11 is on the radar, 12 dies, 13 is never seen."""
    rows = [state(i, "ct", t, 0.0, "CTSpawn" if i == 1 else "TRamp") for i in (1, 2) for t in range(160, 1200, 16) if (i, t) < (2, 640)]
    rows += [state(10, "t", t, 10.0 * (t - 160) / 16, "TSpawn" if t < 240 else "TopofMid", 192 <= t <= 224, buy=0) for t in range(160, 1200, 16)]
    rows += [state(11, "t", t, 5.0, "BombsiteA", t >= 320, buy=0) for t in range(160, 1200, 16)]
    rows += [state(12, "t", t, 7.0, "BombsiteB", True, buy=0) for t in range(160, 400, 16)]
    rows += [state(13, "t", t, 9.0, "TSpawn", buy=0) for t in range(160, 1200, 16)]
    return spark.createDataFrame(rows, STATES)


@pytest.fixture(scope="module")
def documents(spark, round1):
    moments = spark.createDataFrame([("m", 1, "ct", 800), ("m", 1, "ct", 208), ("m", 1, "t", 800), ("m", 1, "ct", 800)], "demo_id string, round_num int, friendly string, tick int")
    rounds = spark.createDataFrame([("m", 1, 160, 650, "bombsite_b")], "demo_id string, round_num int, freeze_end int, bomb_plant int, bomb_site string")
    kills = spark.createDataFrame(
        [("m", 1, 630, 10, "t", "ct", True, "TRamp"), ("m", 1, 394, 2, "ct", "t", False, "BombsiteB"), ("m", 1, 801, 11, "t", "ct", False, "CTSpawn"), ("m", 1, 700, 10, "t", "t", False, "TSpawn")],
        "demo_id string, round_num int, tick int, attacker_steamid long, attacker_side string, victim_side string, obstructed boolean, region string",
    )
    active = spark.createDataFrame([("m", 1, 800, "BombsiteA"), ("m", 1, 800, "BombsiteA"), ("m", 1, 800, "SnipersNest"), ("m", 1, 816, "TSpawn")], "demo_id string, round_num int, tick int, region string")
    watched = spark.createDataFrame([("m", 1, "ct", 800, "TopofMid", 0.3), ("m", 1, "ct", 800, "TSpawn", 0.2), ("m", 1, "ct", 800, "Unknown", 0.9)], "demo_id string, round_num int, friendly string, tick int, region string, chance double")
    looks = spark.createDataFrame([("m", 1, 800, 1, "CTSpawn", 0.9), ("m", 1, 800, 1, "TopofMid", 0.4), ("m", 1, 800, 1, "TRamp", 0.3), ("m", 1, 208, 1, "TRamp", 0.1)], "demo_id string, round_num int, tick int, steamid long, region string, chance double")
    able = round1.where("not (steamid = 2 and tick = 208)").select("demo_id", "round_num", "steamid", "tick")
    locate = lambda p: p.withColumn("region", F.when(F.col("X") > 300, "TopofMid").otherwise("TSpawn"))
    return d.moment_documents(moments, round1, rounds, kills, locate, active, None, watched, able, looks)


def shown(documents):
    return {(r.friendly, r.tick): json.loads(r.s) for r in documents.select("friendly", "tick", F.to_json("state").alias("s")).collect()}


def test_what_a_team_knows(documents):
    got = shown(documents)
    assert set(got) == {("ct", 800), ("ct", 208), ("t", 800)}
    x = got["ct", 800]
    assert x["your_team"] == "CT" and x["seconds_into_round"] == 10 and x["players_alive"] == {"your_team": 1, "enemies": 3}
    assert x["bomb"] == "planted on B site 2 s ago (explodes in 38 s)" and x["enemy_team_buy"] == "eco (little or no equipment)"
    assert x["enemies"] == [
        # last seen at tick 224, ten units a step: 40 a second are no movement
        {"id": "T1", "status": "off your radar", "last_seen_at": "T Spawn", "seconds_since_seen": 9, "when_last_seen": "holding still"},
        {"id": "T2", "status": "on your radar now", "at": "Bombsite A"},
        {"id": "T3", "status": "dead"},
        {"id": "T4", "status": "not seen yet this round"},
    ]
    assert x["your_teammates"] == [{"id": "CT1", "at": "CT Spawn", "looking_toward": "Top of Mid"}]
    assert x["callouts_your_team_is_watching"] == ["Top of Mid"] and x["smokes_active_at"] == ["Bombsite A", "Snipers Nest"] and x["molotovs_burning_at"] == ["none"]
    assert x["recent_kill_feed"] == [{"seconds_ago": 2, "killer": "T1", "victim_was_at": "T Ramp", "note": "through smoke or a wall"}]  # 630 is told at 640
    early = got["ct", 208]
    assert early["bomb"] == "not planted (114 s of round time left)" and early["no_recent_kills"] == "no recent kills by enemies" and "recent_kill_feed" not in early
    assert early["your_teammates"] == [{"id": "CT1", "at": "CT Spawn", "looking_toward": "a nearby wall or corner"}, {"id": "CT2", "at": "T Ramp", "status": "flashed (blind)"}]
    assert early["callouts_your_team_is_watching"] == ["none"] and [e["status"] for e in early["enemies"]] == ["on your radar now", "not seen yet this round", "on your radar now", "not seen yet this round"]
    other = got["t", 800]
    assert [e["status"] for e in other["enemies"]] == ["not seen yet this round", "dead"] and other["enemy_team_buy"] == "full buy" and len(other["your_teammates"]) == 3
    assert other["recent_kill_feed"] == [{"seconds_ago": 6, "killer": "CT2", "victim_was_at": "Bombsite B"}]


def test_movement(spark, round1):
    fast = round1.withColumn("X", F.when(F.col("steamid") == 10, F.col("X") * 3).otherwise(F.col("X")))
    moments = spark.createDataFrame([("m", 1, "ct", 800)], "demo_id string, round_num int, friendly string, tick int")
    for edge, words in ((300.0, "moving toward Top of Mid"), (1e9, "moving within T Spawn")):
        locate = lambda p, edge=edge: p.withColumn("region", F.when(F.col("X") > edge, "TopofMid").otherwise("TSpawn"))
        e = d.enemy_entries(moments, fast, locate).first().enemies[0]
        assert e.when_last_seen == words
    # a sighting after a gap tells no movement
    gap = fast.withColumn("spotted", F.col("spotted") & ((F.col("steamid") != 10) | (F.col("tick") != 208)))
    assert d.enemy_entries(moments, gap, locate).first().enemies[0].when_last_seen is None


def test_requests_and_reach(spark, documents):
    cells = spark.createDataFrame([(0, "TSpawn"), (1, "TopofMid"), (2, "BombsiteA"), (3, "Unknown"), (4, "Shop")], "node long, place string")
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (0, 0)], "src long, dst long")
    connected = d.neighbours(cells, edges)
    assert {r.region: r.text for r in connected.collect()} == {"T Spawn": "Connects to: Top of Mid.", "Top of Mid": "Connects to: Bombsite A, T Spawn.", "Bombsite A": "Connects to: Top of Mid.", "Shop": "Connects to: nothing listed."}
    (r,) = d.requests(documents, connected).collect()
    assert r.key == "m|ct|1|800" and set(r.questions) == {"T1"} and r.questions["T1"].instructions == "Where is T1 now?" and r.questions["T1"].type == "choice"
    assert r.questions["T1"].criteria["Shop"] == "Connects to: nothing listed." and len(r.questions["T1"].criteria) == 4
    seconds = spark.createDataFrame([("T Spawn", "T Spawn", 0.0), ("T Spawn", "Top of Mid", 9.9), ("T Spawn", "Shop", 10.1)], "region string, to string, seconds double")
    (r,) = d.with_reach(documents, seconds).collect()
    assert (r.friendly, r.tick, r.id) == ("ct", 800, "T1") and list(r.could_have_reached) == ["T Spawn", "Top of Mid"]


def test_no_moments(spark, round1):
    none = spark.createDataFrame([], "demo_id string, round_num int, friendly string, tick int")
    rounds = spark.createDataFrame([], "demo_id string, round_num int, freeze_end int, bomb_plant int, bomb_site string")
    kills = spark.createDataFrame([], "demo_id string, round_num int, tick int, attacker_steamid long, attacker_side string, victim_side string, obstructed boolean, region string")
    assert d.moment_documents(none, round1, rounds, kills, lambda p: p.withColumn("region", F.lit("x"))).collect() == []
