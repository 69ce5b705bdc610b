"""Refreshes of parsed tables: named columns are made anew for some matches, the others stay."""

from pyspark.sql import functions as F

from fogline.sources import refresh
from fogline.sources.store import MatchStore


def test_grenade_ends_of_some_matches(spark, tmp_path):
    s = MatchStore(spark, str(tmp_path))
    rows = [("a", d, 1, t, -1) for d in ("m1", "m2") for t in (100, 5000)] + [("a", "m1", 2, 100, -1)]
    s.write("smokes", spark.createDataFrame(rows, "source string, demo_id string, entity_id int, start_tick int, end_tick int"))
    expiries = spark.createDataFrame([("smokes", "m1", 1, 1200), ("smokes", "m1", 1, 100), ("infernos", "m1", 1, 300), ("smokes", "m1", 2, 99_999)], "table string, demo_id string, entity_id int, tick int")
    refresh.refresh_grenade_ends(s, expiries, spark.createDataFrame([("m1",)], "demo_id string"))
    got = {(r.demo_id, r.entity_id, r.start_tick): r.end_tick for r in s.read("smokes").collect()}
    # the next expiry if it is near, else the usual eighteen seconds; the other match as it was
    assert got == {("m1", 1, 100): 1200, ("m1", 1, 5000): 5000 + 18 * 64, ("m1", 2, 100): 100 + 18 * 64, ("m2", 1, 100): -1, ("m2", 1, 5000): -1}
    before = s.read("smokes").count()
    refresh.refresh_grenade_ends(s, expiries, spark.createDataFrame([("m1",)], "demo_id string"))
    assert s.read("smokes").count() == before and s.read("infernos").count() == 0


def test_blinds_of_some_matches(spark, tmp_path):
    s = MatchStore(spark, str(tmp_path))
    s.write("rounds", spark.createDataFrame([("a", d, 1, 50, 500) for d in ("m1", "m2")], "source string, demo_id string, round_num int, freeze_end int, end int"))
    s.write("blinds", spark.createDataFrame([("a", d, 1, "old") for d in ("m1", "m2")], "source string, demo_id string, tick int, user_name string"))
    flashed = [("a", "m1", 7, "seven", t, x) for t, x in ((60, 0.0), (61, 2.5), (62, 2.5), (63, 1.0), (64, 0.0), (900, 3.0))]
    durations = spark.createDataFrame(flashed, "source string, demo_id string, steamid long, name string, tick int, blind_duration float")
    detonations = spark.createDataFrame([("m1", 61, 5, 99), ("m1", 61, 4, 98)], "demo_id string, tick int, entityid int, attacker_steamid long")
    refresh.refresh_blinds(s, durations, detonations, spark.createDataFrame([("m1",)], "demo_id string"))
    got = s.read("blinds").select("demo_id", "tick", "user_name", "user_steamid", "blind_duration", "entityid", "attacker_steamid", "round_num").orderBy("demo_id", "tick").collect()
    # a rise and a change are flashes of the round, the one after its end is none
    assert [tuple(r) for r in got] == [("m1", 61, "seven", "7", 2.5, 4, 98, 1), ("m1", 63, "seven", "7", 1.0, None, None, 1), ("m2", 1, "old", None, None, None, None, None)]


def test_refresh_replaces_a_table_in_place(spark, tmp_path):
    s = MatchStore(spark, str(tmp_path))
    s.write("bomb", spark.createDataFrame([("a", "m1", i, "drop") for i in range(50)], "source string, demo_id string, tick int, event string"))
    s.refresh("bomb", lambda rows: rows.where("tick % 2 = 0").withColumn("event", F.lit("x")))
    assert s.read("bomb").count() == 25 and s.read("bomb").select("event").distinct().first().event == "x"
