"""Team factors as joins against the array version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogline.operators import lineups
from fogline.operators.belief import LineUps
from fogline.operators.corrections import team_ratio

RECORDED = "clock double, places array<int>, buy int, n long"


@pytest.fixture(scope="module")
def recorded():
    rng = np.random.default_rng(3)
    seen = {}
    for _ in range(600):
        n = int(rng.integers(0, 6))
        row = (float(rng.integers(0, 40)) / 2, tuple(sorted(int(x) for x in rng.integers(0, 6, n))), int(rng.integers(0, 3)))
        seen[row] = seen.get(row, 0) + int(rng.integers(1, 4))
    return [(c, list(places), buy, n) for (c, places, buy), n in sorted(seen.items())]


def arrays(rows):
    return {"clock": np.array([r[0] for r in rows]), "alive": np.array([len(r[1]) for r in rows]), "buy": np.array([r[2] for r in rows]), "count": np.array([r[3] for r in rows]), "places": np.array([[*r[1], *[-1] * (5 - len(r[1]))] for r in rows], int).reshape(-1, 5)}


@pytest.mark.parametrize("options", [LineUps(most=10**6), LineUps(power=0.5, pseudo=100.0, surplus=1.0, most=10**6), LineUps(single=True, sigma=4.0, most=10**6)])
def test_factors_equal_the_array_version(spark, recorded, options):
    rng = np.random.default_rng(5)
    asked = []
    for i in range(12):
        k = i % 5 + 1
        p = rng.random((k, 6)) + 0.01
        buy = None if i % 3 == 0 else (rng.random(3) + 0.1)
        asked.append((i, float(rng.random() * 22 - 1), (p / p.sum(1, keepdims=True)).tolist(), None if buy is None else (buy / buy.sum()).tolist()))
    asked.append((99, 500.0, [[1 / 6] * 6], None))  # no line-up is near
    asked.append((100, 5.0, [[1 / 6] * 6] * 6, None))  # more entities than a line-up has
    asked.append((101, 5.0, [], None))
    requests = spark.createDataFrame(asked, "id int, clock double, p array<array<double>>, buy array<double>")
    got = {(r["id"], r["entity"], r["region"]): r["factor"] for r in lineups.team_factors(requests, spark.createDataFrame(recorded, RECORDED), ["id"], 6, options).collect()}
    want = {}
    for i, clock, p, buy in asked[:-3]:
        ratio = team_ratio(arrays(recorded), clock, None if buy is None else np.array(buy), np.array(p), options)
        if ratio is not None:
            want |= {(i, e, r): ratio[e, r] for e in range(len(p)) for r in range(6)}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_ways(spark):
    kinds = spark.createDataFrame([(5, 2), (3, 3), (2, 3), (5, 2), (4, 0)], "alive int, k int")
    got = lineups.ways(kinds).groupBy("alive", "k").agg(F.count("*").alias("n"), F.countDistinct("slots").alias("m")).collect()
    assert sorted(map(tuple, got)) == [(3, 3, 6, 6), (5, 2, 20, 20)]


def test_nothing_recorded(spark):
    requests = spark.createDataFrame([(1, 5.0, [[0.5, 0.5]])], "id int, clock double, p array<array<double>>")
    assert lineups.team_factors(requests, spark.createDataFrame([], RECORDED), ["id"], 2).collect() == []
