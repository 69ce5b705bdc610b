"""Batched conditional logits against single fits; folds that leak nothing; refits on resampled clusters."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.operators import choices, fitting, scoring

SCHEMA = "id long, grp int, truth int, x array<double>"
TRUE = np.array([1.2, -0.6, 0.3])


def invented(seed, n=1500, groups=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4, 3)) * (1.0, 5.0, 0.2)
    u = np.exp(x @ (TRUE / (1.0, 5.0, 0.2)))
    return [(i, i % groups, int(rng.choice(4, p=q / q.sum())), v.ravel().tolist()) for i, (v, q) in enumerate(zip(x, u, strict=True))]


@pytest.fixture(scope="module")
def rows():
    return invented(1)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def solved(rows, w, pull=0.0, towards=0.0, scale=1.0):
    """One weighted fit by plain gradient steps on the penalised mean log-likelihood."""
    x, truth = np.array([r[3] for r in rows]).reshape(len(rows), 4, 3) / scale, np.array([r[2] for r in rows])
    theta = np.zeros(3)
    for _ in range(60):
        p = np.exp(x @ theta - (x @ theta).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        m = np.einsum("rc,rcd->rd", p, x)
        g = (w[:, None] * (x[np.arange(len(x)), truth] - m)).sum(0) / w.sum() - 2 * pull * (theta - towards)
        h = (np.einsum("r,rc,rcd,rce->de", w, p, x, x) - np.einsum("r,rd,re->de", w, m, m)) / w.sum() + 2 * pull * np.eye(3)
        theta = theta + np.linalg.solve(h, g)
    return theta


def test_many_fits_equal_single_ones(frame, rows):
    rng = np.random.default_rng(2)
    table = rng.integers(0, 3, (40, 7)).astype(float)
    table[:, 6] = 0  # a fit without rows
    w = F.create_map(*(v for g in range(40) for v in (F.lit(g), F.array(*(F.lit(float(x)) for x in table[g])))))
    got = choices.fit_choices(frame.withColumn("w", F.element_at(w, F.col("grp"))), 3, 7, pull=0.02, towards=(1.0, 0.0, 0.0))
    for i in range(6):
        assert got[i] == pytest.approx(solved(rows, table[[r[1] for r in rows], i], 0.02, np.array([1.0, 0, 0])), abs=1e-7)
    assert got[6].tolist() == [1, 0, 0]


def test_known_weights_are_recovered_and_agree_with_the_other_optimiser(frame):
    theta = choices.fit_choices(frame, 3)[0]
    assert theta * (1, 5, 0.2) == pytest.approx(TRUE, abs=0.15)
    assert fitting.maximise(frame.select("x", "truth"), fitting.choice_likelihood(), (0.0, 0.0, 0.0)) == pytest.approx(theta, abs=0.02)


def test_scales_are_those_of_the_rows_that_are_weighed(frame, rows):
    w = F.array(F.lit(1.0), (F.col("grp") < 10).cast("double"))
    got = choices.feature_scales(frame.withColumn("w", w), 3, 2, (0,))
    for i, own in enumerate((rows, [r for r in rows if r[1] < 10])):
        want = np.array([r[3] for r in own]).reshape(-1, 3).std(0) + 1e-9
        want[0] = 1
        assert got[i] == pytest.approx(want)


def test_cross_fitting_keeps_clusters_whole_and_recovers_weights(spark, frame, rows):
    held, fits = choices.cross_fitted(frame, "grp", 3, pull=0.003, towards=(1.0, 0.0, 0.0), unscaled=(0,), folds=5, seeds=3)
    folds = {r["grp"]: r["fold"] for r in choices.fold_draws(frame, "grp", 5, 3).collect()}
    assert all(sorted(np.bincount([f[s] for f in folds.values()], minlength=5).tolist()) == [8] * 5 for s in range(3))
    assert len({tuple(f[s] for _, f in sorted(folds.items())) for s in range(3)}) == 3
    # each fit is the plain fit of the rows outside its fold, scaled by their own deviations
    for s, f in ((0, 0), (2, 3)):
        w = np.array([float(folds[r[1]][s] != f) for r in rows])
        theta, scale = fits[s * 5 + f]
        assert theta == pytest.approx(solved(rows, w, 0.003, np.array([1.0, 0, 0]), scale), abs=1e-7)
        assert theta / scale * (1, 5, 0.2) == pytest.approx(TRUE, abs=0.2)
    got = {r["id"]: r["p"] for r in held.collect()}
    assert len(got) == len(rows) and held.columns == ["id", "grp", "truth", "x", "p"]
    for i in (0, 777):
        x = np.array(rows[i][3]).reshape(1, 4, 3)
        own = [choices.probabilities(x, (fits[s * 5 + folds[rows[i][1]][s]][0] / fits[s * 5 + folds[rows[i][1]][s]][1])[None])[0, :, 0] for s in range(3)]
        assert got[i] == pytest.approx(np.mean(own, 0))


def test_held_out_rows_leak_into_no_fit_that_predicts_them(spark, rows):
    """Other answers for one cluster change neither the fits that leave it out nor, so, its own predictions."""
    changed = [(i, g, (t + 1) % 4 if g == 7 else t, x) for i, g, t, x in rows]
    p, fits = zip(*((({r["id"]: r["p"] for r in held.collect()}), f) for held, f in (choices.cross_fitted(spark.createDataFrame(x, SCHEMA), "grp", 3, pull=0.01, unscaled=(0,), folds=4, seeds=2) for x in (rows, changed))), strict=True)
    own = [i for i, g, *_ in rows if g == 7]
    assert all(p[0][i] == pytest.approx(p[1][i], abs=1e-9) for i in own)
    other = [i for i, g, *_ in rows if g != 7]
    assert max(np.abs(np.array(p[0][i]) - p[1][i]).max() for i in other) > 1e-3


def test_refits_equal_fits_on_the_drawn_clusters(frame, rows):
    got = choices.refits(frame, "grp", 3, pull=0.01, draws=20, seed=5)
    copies = {}
    for r in scoring.cluster_draws(frame, "grp", 20, 5).collect():
        copies[r["draw"], r["grp"]] = r["copies"]
    assert all(sum(copies.get((d, g), 0) for g in range(40)) == 40 for d in range(20))
    for d in (0, 7, 19):
        w = np.array([float(copies.get((d, r[1]), 0)) for r in rows])
        assert got[d] == pytest.approx(solved(rows, w, 0.01), abs=1e-7)
    assert got.std(0).min() > 0


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert choices.fit_choices(empty, 3, towards=(1.0, 0.0, 0.0))[0].tolist() == [1, 0, 0]
    held, _ = choices.cross_fitted(empty, "grp", 3)
    assert held.collect() == [] and scoring.cluster_draws(empty, "grp", 5).collect() == []


def test_intervals_pair_models_on_the_same_draws(spark):
    rng = np.random.default_rng(6)
    data = [(m, c, float(v + (m == "b") * 0.5), float(v > 0)) for c in range(50) for v in rng.normal(size=3) for m in "ab"]
    df = spark.createDataFrame(data, "model string, c int, v double, hit double")
    got = {(r["model"], r["metric"]): r for r in scoring.intervals(df, "model", "c", ["v", "hit"], "a", draws=300).collect()}
    assert len(got) == 4 and got["a", "v"]["diff"] is None and got["a", "v"]["diff_lo"] is None
    b = got["b", "v"]
    assert b["diff"] == pytest.approx(0.5) and b["diff_lo"] == pytest.approx(0.5) and b["diff_hi"] == pytest.approx(0.5)
    assert got["a", "v"]["lo"] < got["a", "v"]["mean"] < got["a", "v"]["hi"] and got["a", "hit"]["n"] == 150
    assert got["b", "hit"]["diff"] == 0


def test_means_of_blocks_are_those_of_the_picks(spark, monkeypatch):
    """Stretches and blocks of a few picks, a number that is not finite, a missing one and a model of few clusters."""
    from fogline.operators import sampling

    rows = [(m, c, float("inf") if (m, c) == ("a", 3) else None if c == 5 else 1.0 * (c * 7 % 11) + len(m or ""), 1.0) for m, c in [("a", c) for c in range(40)] + [(None, c) for c in range(90, 130)] + [("few", 200)]] + [("a", None, 5.0, 1.0)]
    frame = spark.createDataFrame(rows + rows[:9], "model string, c int, v double, one double")
    monkeypatch.setattr(scoring, "STRETCH", 7)
    monkeypatch.setattr(scoring, "MOST_PICKS", 300)
    got = {(r.model, r.metric, r.draw): r["mean"] for r in scoring.resampled_means(frame, "model", "c", ["v", "one"], 30, 4).collect()}
    want = frame.join(scoring.cluster_draws(frame, "c", 30, 4), "c").groupBy("model", "draw").agg(*((F.sum(F.col("copies") * F.col(m)) / F.sum(F.when(F.col(m).isNotNull(), F.col("copies")))).alias(m) for m in ("v", "one"))).collect()
    assert set(got) == {(r.model, m, r.draw) for r in want for m in ("v", "one")} and any(got[k] == float("inf") for k in got)
    for r in want:
        assert got[r.model, "one", r.draw] == r.one and got[r.model, "v", r.draw] == pytest.approx(r.v)
    for prefix, first in ((b"0|1|", 0), (b"12345678901234567890|1999999|", 99_990), (b"", 9)):
        assert sampling.hashed(prefix, first, 1_200, 500).tolist() == [int(hashlib.md5(prefix + str(j).encode()).hexdigest()[:15], 16) for j in range(first, first + 1_200)]
