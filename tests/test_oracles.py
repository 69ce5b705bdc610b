"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run and keep their promises."""

import datetime
import decimal

import duckdb
import numpy as np
import pytest

from fogline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(x):
    if x is None or x != x:
        return None
    if isinstance(x, (bool, str, datetime.datetime)):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 5) + 0.0
    return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.sql(catalogue.SQL[name])
    assert sorted(found.columns) == columns
    key = lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    a = sorted((tuple(normal(r[c]) for c in columns) for r in got.collect()), key=key)
    at = [found.columns.index(c) for c in columns]
    b = sorted((tuple(normal(r[i]) for i in at) for r in found.fetchall()), key=key)
    assert a == b


def test_queries_without_sql(spark):
    q = catalogue.QUERIES
    assert set(q) - set(catalogue.SQL) == {"particle_filter", "platt_fit", "spot_fit"}
    assert all(r.lo <= r.weight <= r.hi and r.held_out_loss > 0 for r in q["formula_bootstrap"](spark, SF).collect())
    for r in q["bootstrap_ci"](spark, SF).collect():
        assert r.lo <= r.mean <= r.hi
    f = q["grouped_folds"](spark, SF).collect()
    assert len(f) == 4 and max(r.clusters for r in f) - min(r.clusters for r in f) <= 1
    b = {r.model: r for r in q["belief_recursion"](spark, SF).collect()}
    assert len({r.n for r in b.values()}) == 1 and b["hmm"].log_loss < b["last_seen"].log_loss
    p = {r.model: r for r in q["particle_filter"](spark, SF).collect()}
    assert p["ens_nofire"].log_loss <= p["pf"].log_loss + 0.05
    assert all(r.factor > 0 for r in q["team_correction"](spark, SF).collect())
    assert {r.kind for r in q["platt_fit"](spark, SF).collect()} == {"power", "platt", "piecewise"}
    for r in q["formula_fit"](spark, SF).collect() + q["stack_fit"](spark, SF).collect():
        assert all(np.isfinite(x) for x in r if isinstance(x, float))
    spot = q["spot_fit"](spark, SF).collect()
    assert len(spot) == 11 and all(np.isfinite(x) for r in spot for x in r if isinstance(x, float))


def test_the_library_holds_every_state(spark, tmp_path):
    from fogline.plans import model_queries as m

    events = spark.range(25_000).selectExpr("id AS event_id", "id % 50 AS user_id", "timestamp_micros(id * 1000000) AS ts", "'view' AS event_type", "1.0 AS value", "concat('{\"k\": ', id % 100, '}') AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    lib = m._states(spark, str(tmp_path)).toPandas()
    assert len(lib) == 25_000 and lib.groupby("traj").pos.agg(lambda p: sorted(p) == list(range(len(p)))).all()
    assert lib.traj.nunique() == 50 and sorted(lib.node) == sorted(np.arange(25_000) % 100)


def test_line_ups_are_the_last_places_of_a_day(spark, tmp_path):
    """More events earlier on the same day, all in low regions, change no line-up."""
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 100, (20, 30))
    for name, earlier in (("few", 0), ("many", 8)):
        rows = [(day * 1000 + user * 20 + i, user, day * 86_400 + i, int(cells[day, user]) if i == 8 else i) for day in range(20) for user in range(30) for i in range(8 - earlier, 9)]
        events = spark.createDataFrame(rows, "event_id long, user_id long, s long, k int").selectExpr("event_id", "user_id", "timestamp_seconds(s) AS ts", "'view' AS event_type", "1.0 AS value", "concat('{\"k\": ', k, '}') AS props")
        events.write.parquet(f"{tmp_path}/{name}/events.parquet")
    few, many = (sorted(map(tuple, catalogue.QUERIES["team_correction"](spark, f"{tmp_path}/{x}").collect())) for x in ("few", "many"))
    assert few and few == many


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
