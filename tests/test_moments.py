"""Documents and requests from a store with fitted models."""

import json

from pyspark.sql import functions as F

from fogline.operators import documents
from fogline.plans import evaluation
from fogline.sources import schemas, store
from tests import generator


def test_documents_of_a_store(spark, tmp_path):
    tables = generator.matches(spark, 1, rounds=2, seconds=15, seed=5)
    s = store.MatchStore(spark, str(tmp_path))
    for name in schemas.TABLES:
        s.write(name, tables[name])
    s.write_meta(tables["meta"])
    evaluation.fit(s, "m", only=["grid", "spot"])
    grid = evaluation.load_grid(s, "m")
    states = evaluation.states_of(s, grid)
    ticks = states.groupBy("demo_id", "round_num").agg(F.percentile_approx("tick", 0.5).alias("tick"))
    moments = ticks.withColumn("friendly", F.explode(F.array(F.lit("t"), F.lit("ct"))))
    docs = evaluation.moment_documents(s, "m", moments).persist()
    rows = {(r.round_num, r.friendly): (r.tick, json.loads(r.s)) for r in docs.select("round_num", "friendly", "tick", F.to_json("state").alias("s")).collect()}
    assert len(rows) == moments.count() >= 2
    for (number, friendly), (tick, x) in rows.items():
        now = states.where((F.col("round_num") == number) & (F.col("tick") == tick)).collect()
        own = [r for r in now if r.side == friendly]
        other = {r.steamid: r for r in now if r.side != friendly}
        assert x["players_alive"] == {"your_team": len(own), "enemies": len(other)}
        assert len(x["your_teammates"]) == len(own) and all(("status" in m) != ("looking_toward" in m) for m in x["your_teammates"])
        assert [e["id"][-1] for e in x["enemies"]] == [str(i + 1) for i in range(len(x["enemies"]))]
        alive = [e for e in x["enemies"] if e["status"] != "dead"]
        assert len(alive) == len(other) and sum(e["status"] == "on your radar now" for e in alive) == sum(r.spotted for r in other.values())
        assert all(("last_seen_at" in e) == (e["status"] == "off your radar") for e in x["enemies"])
        assert x["callouts_your_team_is_watching"] and x["smokes_active_at"] and x["molotovs_burning_at"]
    asked = documents.requests(docs, documents.neighbours(grid.cells, grid.edges)).collect()
    hidden = {k: [e["id"] for e in x["enemies"] if e["status"] == "off your radar"] for k, (_, x) in rows.items()}
    assert {(r.round_num, r.friendly): sorted(r.questions) for r in asked} == {k: v for k, v in hidden.items() if v}
