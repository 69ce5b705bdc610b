"""The stream's grid filter: batches against the batch recursion, late and repeated rows, state that ends with its round."""

import numpy as np
from pyspark.sql import functions as F

from fogline.operators import belief as b
from fogline.session import held
from fogline.streaming import online, runs
from tests.test_particles import models_of

ROUND = 100_000_000
CFG = b.configurations()["hmm"].parts[0][1]


def unseen(seen):
    return np.where(np.arange(12) < 4, 0.5, 1.0)


def stream(spark, path, late="0 seconds"):
    e = spark.readStream.schema("who string, us long, event_id long, seen int, true int").parquet(path)
    e = e.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    return e.withColumn("round", F.expr(f"us div {ROUND}")).withColumn("until", (F.col("round") + 1) * ROUND)


def deliver(spark, base, rows, late="0 seconds"):
    spark.createDataFrame(rows, "who string, us long, event_id long, seen int, true int").coalesce(1).write.mode("append").parquet(f"{base}/input")
    with held(spark, online.PROVIDER):
        out = runs.finished(online.beliefs(stream(spark, f"{base}/input", late), ["who", "round"], models_of(12), CFG, unseen), "append", base)
        state = spark.read.format("statestore").option("stateVarName", "belief").load(f"{base}/state").select("key.*").collect()
    return out.collect(), {(r["who"], r["round"]) for r in state}


def expected(rows):
    """event_id -> (step, age, probability) by the recursion over each round's rows at once."""
    out, rounds = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        rounds.setdefault((r[0], r[1] // ROUND), []).append(r)
    for own in rounds.values():
        seen = np.array([[r[3]] for r in own])
        ep = b.Episode(0, np.array([r[1] / 1e6 for r in own]), np.zeros(len(own), int), seen, np.ones(seen.shape, bool), np.array([[r[4]] for r in own]), unseen=np.stack([unseen(x) for x in seen]))
        age = ep.since()[:, 0]
        for s, x in enumerate(b.run_cells(ep, models_of(12), CFG)):
            out[own[s][2]] = (s, age[s], x[0][own[s][4]])
    return out


def test_batches_go_on_where_the_last_one_ended(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{k}", int(i * 3_000_000 + k + 1_000_000), 10 * i + k, int(rng.integers(0, 12)) if rng.random() < 0.2 else -1, int(rng.integers(0, 12))) for i in range(60) for k in range(3)]
    base, want = runs.new_base(spark), expected(rows)
    for part in range(0, 180, 45):
        got, state = deliver(spark, base, rows[part : part + 45])
    assert {r["event_id"] for r in got} == set(want) and not any(r["late"] for r in got)
    for r in got:
        step, age, p = want[r["event_id"]]
        assert r["step"] == step and np.isclose(r["p_region"], p, atol=1e-12)
        assert np.isnan(age) and (r["since"] is None or np.isnan(r["since"])) or np.isclose(r["since"], age)
    # the first round (up to 100 s) is over, and its state is gone
    assert state == {(f"u{k}", 1) for k in range(3)}


def test_late_and_repeated_rows_change_nothing(spark):
    base = runs.new_base(spark)
    first = [("a", 10_000_000, 1, 3, 3), ("a", 20_000_000, 2, -1, 4), ("a", 20_000_000, 2, -1, 4)]
    second = [("a", 15_000_000, 3, 9, 9), ("a", 20_000_000, 2, -1, 4), ("a", 30_000_000, 4, -1, 4)]
    deliver(spark, base, first, "1 hour")
    got, _ = deliver(spark, base, second, "1 hour")
    want = expected([first[0], first[1], second[2]])
    said = {r["event_id"]: r["p_region"] for r in got if not r["late"]}
    assert said.keys() == want.keys() and all(np.isclose(said[k], want[k][2], atol=1e-12) for k in want)
    assert sorted(r["event_id"] for r in got if r["late"]) == [2, 2, 3]


def test_steps_that_were_taken_once_are_looked_up(monkeypatch):
    """Entities that are moved and looked for alike share their beliefs; they equal those of the recursion."""
    rng, models, calls = np.random.default_rng(2), models_of(12), []
    moved = b.Chain.moved
    for name in ("last_seen", "prior", "prior_neg", "diffuse", "hmm_noneg", "hmm"):
        cfg = b.configurations()[name].parts[0][1]
        for most in (20_000, 3):
            steps = online.Steps(models, cfg, unseen)
            steps.MOST = most
            for _ in range(40):
                seen = np.where(rng.random(8) < 0.4, rng.integers(0, 3, 8), -1)
                t = np.cumsum(rng.integers(1, 3, 8) * 1.5)
                ep = b.Episode(0, t, np.zeros(8, int), seen[:, None], np.ones((8, 1), bool), np.zeros((8, 1), int), unseen=np.stack([unseen(x) for x in seen]))
                want, ages, got, at = [x[0] for x in b.run_cells(ep, models, cfg)], [None, *ep.since()[:, 0]], steps.start, []
                monkeypatch.setattr(b.Chain, "moved", lambda self, x: calls.append((name, most)) or moved(self, x))
                for s in range(8):
                    got = steps.take(got, t[s], ages[s], int(seen[s]))
                    at.append(got.mass)
                monkeypatch.setattr(b.Chain, "moved", moved)
                assert np.allclose(want, at, rtol=0, atol=1e-15)
                assert [p for p, _ in got.said] == np.bincount(models.region, got.mass).tolist()
    # forty entities of seven moves each
    assert 0 < sum(c == ("diffuse", 20_000) for c in calls) < 140 and sum(c == ("diffuse", 3) for c in calls) <= 280
