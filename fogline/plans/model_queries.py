"""Fits and recursions over the event tables: a user is an entity, its cell (in tens) the place, a view a sighting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import maths
from ..operators import belief as b
from ..operators import counting as c
from ..operators import choices, fitting, lineups, maps, particles, reports
from ..session import table
from .common import DAY, E, sightings
from .registry import query

CELLS = 100


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    t = (F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / DAY
    seen = F.when(F.col("event_type") == "view", F.col("cell")).otherwise(-1)
    return e.select("user_id", F.lit(0).alias("side"), (F.row_number().over(w) - 1).alias("step"), t.alias("t"), F.lit(0).alias("phase"), F.array(seen).alias("seen"), F.array(F.lit(True)).alias("alive"), F.array("cell").alias("true"))


def chain_models(spark: SparkSession, sf_dir: str) -> b.Models:
    """Models of the 100 cells from all users' moves."""
    e = sightings(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    moved = e.select("cell", F.lead("cell").over(w).alias("next_cell")).where("next_cell is not null")
    counts = c.transitions(moved, [], "cell", "next_cell").collect()  # 100 x 100 at most
    m = np.full((CELLS, CELLS), 0.05)
    for r in counts:
        m[r["cell"], r["next_cell"]] += r["n"]
    m /= m.sum(1, keepdims=True)
    row, col = np.indices(m.shape).reshape(2, -1)
    chain = b.Chain(row, col, m.ravel(), CELLS)
    near = np.abs(row - col) <= 1
    walk = b.Chain(row[near], col[near], 1.0 / np.array([2 if x in (0, CELLS - 1) else 3 for x in row[near]]), CELLS)
    first = np.full(CELLS, 1e-3)
    for r in e.groupBy("cell").agg(F.count("*").alias("n")).collect():
        first[r["cell"]] += r["n"]
    first /= first.sum()
    return b.Models({(0, 0, k, -1): chain for k in range(6)}, walk, first[None, :], {(0, 0): first[None, :]}, np.arange(CELLS) // 10, smooth=walk)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All states of the event table as recorded trajectories: those of a user within thirty days, of 512 states at most."""
    e = sightings(spark, sf_dir).withColumn("span", F.expr(f"us div {30 * DAY}"))
    place = F.row_number().over(Window.partitionBy("user_id", "span").orderBy("us", "event_id")) - 1
    placed = e.withColumn("place", place)
    traj = F.concat_ws("|", "user_id", "span", F.expr("place div 512"))
    never = F.lit(None).cast("double")
    return placed.select(traj.alias("traj"), F.pmod("place", F.lit(512)).alias("pos"), F.lit(0).alias("side"), F.col("cell").alias("node"), F.pmod(F.col("us") / DAY, F.lit(30.0)).alias("t"), F.lit(0).alias("phase"), never.alias("since"), F.lit(2).alias("buy"), F.lit(-1).alias("weapon"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))


def _unseen(seen: np.ndarray) -> np.ndarray:
    """Looks at the neighbourhood of the cell of a sighting elsewhere: nothing is seen near the map's middle."""
    out = np.ones(CELLS)
    out[45:55] = 0.7
    return out


def _summary(samples: DataFrame) -> DataFrame:
    s = samples.groupBy("model").agg(F.count("*").alias("n"), F.avg((F.col("region_rank") < 1).cast("double")).alias("top1"), F.avg(maths.log_loss(F.col("p_region"))).alias("log_loss"))
    return s.select("model", "n", F.round("top1", 6).alias("top1"), F.round("log_loss", 6).alias("log_loss"))


#: Steps of all users, and the summary of a recursion over them.
STEPS_SQL = "SELECT user_id AS walker, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS step, CASE WHEN event_type = 'view' THEN cell ELSE -1 END AS seen, cell AS true_cell FROM e"
SUMMARY_SQL = "SELECT model, count(*) AS n, round(avg((place < 1)::INTEGER), 6) AS top1, round(avg(-ln(greatest(own, 1e-9))), 6) AS log_loss FROM h GROUP BY model"


def recursion_sql(steps: str, models: tuple[str, ...], answer: str) -> str:
    """The grid filters as a recursion over lists of a hundred cells; see belief.run_cells for the order of a step. steps:
    (walker, event_id, step, seen, true_cell) from e; answer: over g (a row a hidden step, region probabilities p) or h."""
    lists = lambda rows: f"(SELECT list(x ORDER BY j) FROM (SELECT j, list(p ORDER BY i) AS x FROM {rows} GROUP BY j))"
    return f"""WITH RECURSIVE {E}, c AS (SELECT i::INTEGER AS i FROM range({CELLS}) t(i)),
  k AS (SELECT cell, nxt, count(*) AS n FROM (SELECT cell, lead(cell) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nxt FROM e) WHERE nxt IS NOT NULL GROUP BY ALL),
  t AS (SELECT i, j, (0.05::DOUBLE + coalesce(n, 0)) / sum(0.05::DOUBLE + coalesce(n, 0)) OVER (PARTITION BY i) AS p FROM c JOIN (SELECT i AS j FROM c) ON true LEFT JOIN k ON k.cell = i AND k.nxt = j),
  w AS (SELECT i, j, CASE WHEN abs(i - j) > 1 THEN 0.0 WHEN i IN (0, {CELLS - 1}) THEN 1 / 2 ELSE 1 / 3 END::DOUBLE AS p FROM t),
  o AS (SELECT list(p ORDER BY i) AS first FROM (SELECT i, (0.001::DOUBLE + count(cell)) / ({CELLS} * 0.001::DOUBLE + (SELECT count(*) FROM e)) AS p FROM c LEFT JOIN e ON cell = i GROUP BY i)),
  v AS (SELECT {lists("t")} AS learned, {lists("w")} AS walk, first, list_transform(range({CELLS}), lambda i: CASE WHEN i >= 45 AND i < 55 THEN 0.7::DOUBLE ELSE 1.0 END) AS unseen, [x for x in range({CELLS})] AS cells FROM o),
  s AS ({steps}),
  m AS (SELECT * FROM (VALUES ('last_seen', 'none', false), ('prior', 'prior', false), ('prior_neg', 'prior', true), ('diffuse', 'walk', true), ('hmm_noneg', 'learned', false), ('hmm', 'learned', true)) q(model, motion, neg) WHERE model IN ({", ".join(f"'{m}'" for m in models)})),
  r AS (SELECT walker, -1::BIGINT AS event_id, -1::BIGINT AS step, -1 AS seen, -1 AS true_cell, model, motion, neg, first AS b FROM (SELECT DISTINCT walker FROM s), m, v
   UNION ALL
   SELECT walker, event_id, step, seen, true_cell, model, motion, neg,
     CASE WHEN motion = 'prior' THEN CASE WHEN seen >= 0 THEN list_transform(cells, lambda i: (i = seen)::INTEGER::DOUBLE) ELSE b2 END
       ELSE list_transform(CASE WHEN seen >= 0 THEN list_transform(cells, lambda i: (i = seen)::INTEGER::DOUBLE) ELSE b2 END, lambda x: (1 - {b.FLOOR}::DOUBLE) * x + {b.FLOOR}::DOUBLE / {CELLS}) END
   FROM (SELECT *, CASE WHEN neg AND list_sum(list_transform(b1, lambda x, i: x * unseen[i])) > 1e-12 THEN list_transform(list_transform(b1, lambda x, i: x * unseen[i]), lambda x: x / list_sum(list_transform(b1, lambda x, i: x * unseen[i]))) ELSE b1 END AS b2
     FROM (SELECT s.*, r.model, r.motion, r.neg, v.cells, v.unseen,
       CASE WHEN r.motion = 'prior' THEN v.first WHEN s.step = 0 OR r.motion = 'none' THEN r.b WHEN r.motion = 'walk' THEN list_transform(v.walk, lambda x: list_dot_product(r.b, x)) ELSE list_transform(v.learned, lambda x: list_dot_product(r.b, x)) END AS b1
       FROM r JOIN s ON s.walker = r.walker AND s.step = r.step + 1, v))),
  g AS (SELECT model, walker, event_id, step, true_cell // 10 AS region, list_transform(range(10), lambda i: list_sum(b[10 * i + 1:10 * i + 10])) AS p FROM r WHERE step >= 0 AND seen < 0),
  h AS (SELECT model, p[region + 1] AS own, len(list_filter(p, lambda x: x >= p[region + 1] * (1 - 1e-12::DOUBLE))) - 1 AS place FROM g)
  {answer}"""


@query(recursion_sql(STEPS_SQL, ("last_seen", "prior", "prior_neg", "diffuse", "hmm_noneg", "hmm"), SUMMARY_SQL))
def belief_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid filters of all users, scored where the entity is hidden."""
    named = b.configurations()
    configs = [named[k] for k in ("last_seen", "prior", "prior_neg", "diffuse", "hmm_noneg", "hmm")]
    steps = particles.segments(_steps(spark, sf_dir), ["user_id"])
    return _summary(b.score(steps, ["user_id", "segment"], chain_models(spark, sf_dir), configs, unseen=_unseen))


@query()
def particle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory filters and their mixture with the grid filter."""
    named = b.configurations()
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("node"))
    edges = cells.select(F.col("node").alias("src"), F.explode(F.array(F.col("node") - 1, F.col("node") + 1)).alias("dst")).where(f"dst between 0 and {CELLS - 1}")
    steps = particles.segments(_steps(spark, sf_dir), ["user_id"])
    return _summary(particles.score(steps, ["user_id", "segment"], _states(spark, sf_dir), particles.node_rings(cells, edges), chain_models(spark, sf_dir), [named["pf"], named["ens_nofire"]], _unseen))


def _line_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clock, places, alive, count): how often each line-up was recorded; at most 60 x 3002 rows from any table.

    A team is five users; a snapshot holds the last region of each that was seen on a day, so five at most.
    """
    e = sightings(spark, sf_dir).select("user_id", F.floor(F.col("us") / DAY).alias("day"), F.floor(F.col("cell") / 10).cast("int").alias("region"), F.struct("us", "event_id").alias("at"))
    last = e.groupBy("user_id", "day").agg(F.max_by("region", "at").alias("region"))
    ups = last.groupBy(F.floor(F.col("user_id") / 5).alias("team"), "day").agg(F.array_sort(F.collect_list("region")).alias("places"))
    return ups.groupBy(F.pmod("day", F.lit(60)).cast("double").alias("clock"), "places").agg(F.count("*").alias("count")).withColumn("alive", F.size("places"))


#: Regions that the beliefs of the three entities of team_correction favour.
FAVOURED = (1, 4, 8)


def _team_sql() -> str:
    o = b.LineUps()
    return f"""WITH {E}, l AS (SELECT user_id, us // {DAY} AS day, arg_max(cell // 10, ROW(us, event_id)) AS region FROM e GROUP BY ALL),
  u AS (SELECT day % 60 AS clock, list(region ORDER BY region) AS places FROM l GROUP BY user_id // 5, day), r AS (SELECT clock, places, len(places) AS alive, count(*) AS n FROM u GROUP BY ALL),
  q AS (SELECT clock::INTEGER AS q FROM range(0, 60, 5) t(clock)), x AS (SELECT region, e, CASE WHEN region = favoured THEN 0.55 ELSE 0.05 END AS p FROM range(10) t(region), (VALUES {", ".join(f"({i}, {f})" for i, f in enumerate(FAVOURED))}) v(e, favoured)),
  m AS (SELECT q, clock, places, alive, n, {o.surplus}::DOUBLE ** (alive - 3) * exp(-0.5 * ((clock - q) / {o.sigma}::DOUBLE) ** 2) AS s FROM q JOIN r ON abs(clock - q) <= {1.5 * o.sigma} WHERE alive >= 3),
  z AS (SELECT q, region, sum(s * n) AS mass FROM (SELECT q, s, n, unnest(places) AS region FROM m) GROUP BY ALL),
  g AS (SELECT q.q, t.region, greatest(coalesce(mass, 0) / sum(mass) OVER (PARTITION BY q.q), 0.001) AS usual FROM q JOIN range(10) t(region) ON true LEFT JOIN z ON z.q = q.q AND z.region = t.region),
  f AS (SELECT q, e, g.region, usual, (p / usual) / sum(p) OVER (PARTITION BY q, e) AS lift FROM g JOIN x ON x.region = g.region),
  w AS (SELECT n, a, b, c FROM range(3, 6) t(n), range(1, 6) ta(a), range(1, 6) tb(b), range(1, 6) tc(c) WHERE a <= n AND b <= n AND c <= n AND a <> b AND a <> c AND b <> c),
  y AS (SELECT m.*, m.places[w.a] AS pa, m.places[w.b] AS pb, m.places[w.c] AS pc, f0.lift * f1.lift * f2.lift / (alive * (alive - 1) * (alive - 2)) AS fit FROM m JOIN w ON w.n = alive
    JOIN f f0 ON f0.q = m.q AND f0.e = 0 AND f0.region = m.places[w.a] JOIN f f1 ON f1.q = m.q AND f1.e = 1 AND f1.region = m.places[w.b] JOIN f f2 ON f2.q = m.q AND f2.e = 2 AND f2.region = m.places[w.c]),
  t AS (SELECT q, sum(n * k) AS total, sum(n * k) ** 2 / sum(n * k * k) AS size FROM (SELECT q, s, n, s * sum(fit) AS k FROM y GROUP BY q, clock, places, s, n) GROUP BY q),
  h AS (SELECT q, e, region, sum(s * n * fit) AS met FROM (SELECT *, 0 AS e, pa AS region FROM y UNION ALL SELECT *, 1, pb FROM y UNION ALL SELECT *, 2, pc FROM y) GROUP BY ALL)
  SELECT t.q AS clock, f.e AS entity, f.region::INTEGER AS region, round((size * coalesce(met, 0) / total + {o.pseudo} * usual * lift) / (size + {o.pseudo}) / (usual * lift), 6) AS factor
  FROM t JOIN f ON f.q = t.q LEFT JOIN h ON h.q = f.q AND h.e = f.e AND h.region = f.region"""


@query(_team_sql())
def team_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team factors for three independent beliefs from all recorded line-ups of five users a snapshot."""
    recorded = _line_ups(spark, sf_dir).select("clock", "places", F.lit(2).alias("buy"), F.col("count").alias("n"))
    beliefs = F.array(*(F.array(*(F.lit(0.55 if r == f else 0.05) for r in range(10))) for f in FAVOURED))
    requests = spark.range(0, 60, 5).select(F.col("id").cast("int").alias("at"), F.col("id").cast("double").alias("clock"), beliefs.alias("p"))
    return lineups.team_factors(requests, recorded, ["at"], 10).select(F.col("at").alias("clock"), "entity", "region", F.round("factor", 6).alias("factor"))


#: P(shown weapon class | buy), fixed for the query.
GUNS = ((0.6, 0.2, 0.15, 0.05), (0.3, 0.4, 0.2, 0.1), (0.1, 0.1, 0.6, 0.2))


def _posterior_sql() -> str:
    logs = [" + ".join(f"0.7 * k{g} * ln({GUNS[i][g]})" for g in range(4)) for i in range(3)]
    return f"""WITH {E}, k AS (SELECT user_id, {', '.join(f"sum((cell % 40 = {g})::INT) AS k{g}" for g in range(4))} FROM e GROUP BY 1),
      p AS (SELECT user_id, {', '.join(f"exp({x}) * {w} AS x{i}" for i, (x, w) in enumerate(zip(logs, (0.4, 0.3, 0.3), strict=True)))} FROM k)
      SELECT user_id, {', '.join(f"round(x{i} / (x0 + x1 + x2), 6) AS p{i}" for i in range(3))} FROM p"""


@query(_posterior_sql())
def buy_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(buy) by user from a prior and the weapons shown."""
    e = sightings(spark, sf_dir)
    k = e.groupBy("user_id").agg(*(F.sum((F.col("cell") % 40 == g).cast("int")).alias(f"k{g}") for g in range(4)))
    terms = [sum((0.7 * F.col(f"k{g}") * float(np.log(GUNS[i][g])) for g in range(4)), F.lit(float(np.log(w)))) for i, w in enumerate((0.4, 0.3, 0.3))]
    p = k.select("user_id", maths.softmax(F.array(*terms)).alias("p"))
    return p.select("user_id", *(F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)))


@query(f"""WITH {E}, b AS (SELECT cell, count(*) / (SELECT count(*) FROM e) AS b FROM e GROUP BY 1), t AS (SELECT cell AS i, cell + d AS j, 1 / 3 AS p FROM b, (VALUES (-1), (0), (1)) v(d) WHERE cell + d BETWEEN 0 AND 99),
  m AS (SELECT cell, CASE WHEN cell BETWEEN 40 AND 44 THEN 0.1 WHEN cell BETWEEN 43 AND 49 THEN 0.5 ELSE 1.0 END AS m FROM b), r AS (SELECT i, sum(p * m) AS reach FROM t JOIN m ON j = cell GROUP BY 1)
  SELECT j AS cell, round(sum(b / reach * p) * any_value(m.m), 6) AS b FROM t JOIN b ON b.cell = i JOIN r USING (i) JOIN m ON m.cell = j GROUP BY j""")
def fire_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One masked step of a walk: moves into burning cells are reweighted and a cell's mass is kept."""
    e = sightings(spark, sf_dir)
    n = e.count()
    now = e.groupBy("cell").agg((F.count("*") / n).alias("b"))
    t = now.select(F.col("cell").alias("i"), F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))).alias("j")).where("j between 0 and 99").withColumn("p", F.lit(1 / 3))
    m = now.select(F.col("cell").alias("j"), F.when(F.col("cell").between(40, 44), 0.1).when(F.col("cell").between(43, 49), 0.5).otherwise(1.0).alias("m"))
    masked = t.join(m, "j")
    reach = masked.groupBy("i").agg(F.sum(F.col("p") * F.col("m")).alias("reach"))
    moved = masked.join(reach, "i").join(now.withColumnRenamed("cell", "i"), "i")
    return moved.groupBy(F.col("j").alias("cell")).agg(F.round(F.sum(F.col("b") / F.col("reach") * F.col("p") * F.col("m")), 6).alias("b"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("truth"), F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(4 * x.cast("double"))).alias("w"))
    return v.select("vec_id", "truth", maths.normalise(F.col("w")).alias("p"))


@query()
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration maps fitted to stated probabilities."""
    df = _choices(spark, sf_dir)
    rows = [(kind, i, round(float(x), 4)) for kind in fitting.STARTS for i, x in enumerate(fitting.fit_calibration(df, kind))]
    return spark.createDataFrame(rows, "kind string, i int, theta double")


#: The ten places of a vector with two features each, and whether a place is the true one.
CHOICES_SQL = """c AS (SELECT vec_id, label::INTEGER AS truth, unnest(range(10)) AS i, list_transform(embedding[1:10], lambda x: exp(4 * x::DOUBLE)) AS w FROM embeddings),
  p AS (SELECT vec_id, truth, i, w[i + 1] / list_sum(w) AS p FROM c)"""


def newton_sql(rows: str, fits: str, pull: float, towards: tuple[float, float], answer: str, rounds: int = 25) -> str:
    """Conditional logits of two features by Newton steps. rows: (vec_id, truth, i, x0, x1, base) from p; fits: (fit,
    vec_id, w); answer: over t (fit, t0, t1), the last step."""
    return f"""WITH RECURSIVE {CHOICES_SQL}, x AS ({rows}), f AS ({fits}),
  r AS (SELECT fit, 0 AS step, {towards[0]}::DOUBLE AS t0, {towards[1]}::DOUBLE AS t1 FROM (SELECT DISTINCT fit FROM f)
   UNION ALL
   SELECT fit, step + 1, t0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), t1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
     SELECT fit, step, t0, t1, sum(w * (x0 - m0)) / sum(w) - {2 * pull} * (t0 - {towards[0]}) AS g0, sum(w * (x1 - m1)) / sum(w) - {2 * pull} * (t1 - {towards[1]}) AS g1,
       sum(w * (s00 - m0 * m0)) / sum(w) + {2 * pull} AS h00, sum(w * (s01 - m0 * m1)) / sum(w) AS h01, sum(w * (s11 - m1 * m1)) / sum(w) + {2 * pull} AS h11
     FROM (SELECT fit, step, t0, t1, vec_id, any_value(w) AS w, max(CASE WHEN i = truth THEN x0 END) AS x0, max(CASE WHEN i = truth THEN x1 END) AS x1,
         sum(e * x0) / sum(e) AS m0, sum(e * x1) / sum(e) AS m1, sum(e * x0 * x0) / sum(e) AS s00, sum(e * x0 * x1) / sum(e) AS s01, sum(e * x1 * x1) / sum(e) AS s11
       FROM (SELECT r.fit, step, t0, t1, x.vec_id, truth, i, x0, x1, w, exp(base + x0 * t0 + x1 * t1) AS e FROM r JOIN f ON f.fit = r.fit JOIN x ON x.vec_id = f.vec_id WHERE step < {rounds})
       GROUP BY fit, step, t0, t1, vec_id)
     GROUP BY fit, step, t0, t1)),
  t AS (SELECT fit, t0, t1 FROM r WHERE step = {rounds})
  {answer}"""


def _two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability and position of ten places."""
    return _choices(spark, sf_dir).select("vec_id", (F.col("vec_id") % 50).alias("grp"), "truth", "p", F.flatten(F.transform("p", lambda p, i: F.array(F.log(p + 0.01), i.cast("double") / 10))).alias("x"))


FORMULA_SQL = "SELECT vec_id, truth, i, ln(p + 0.01) AS x0, i / 10 AS x1, 0 AS base FROM p"
ONE_SQL = "SELECT 0 AS fit, vec_id, 1.0::DOUBLE AS w FROM (SELECT DISTINCT vec_id FROM p)"


@query(newton_sql(FORMULA_SQL, ONE_SQL, 0.01, (0.0, 0.0), "SELECT i::INTEGER AS i, round(CASE WHEN i = 0 THEN t0 ELSE t1 END, 4) AS weight FROM t, range(2) q(i)"))
def formula_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conditional logit on log-probability and position of ten places."""
    theta = choices.fit_choices(_two_features(spark, sf_dir), 2, pull=0.01)[0]
    return spark.createDataFrame([(i, round(float(t), 4)) for i, t in enumerate(theta)], "i int, weight double")


@query(newton_sql("SELECT vec_id, truth, i, ln(greatest(p, 1e-9)) AS x0, (i % 3 = 0)::INTEGER::DOUBLE AS x1, 0 AS base FROM p", ONE_SQL, 0.01, (1.0, 0.0), "SELECT i::INTEGER AS i, round(CASE WHEN i = 0 THEN t0 ELSE t1 END, 4) AS weight FROM t, range(2) q(i)"))
def stack_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction on top of given log-probabilities, drawn to leaving them alone."""
    x = _choices(spark, sf_dir).select("truth", F.flatten(F.transform("p", lambda p, i: F.array(F.log(F.greatest(p, F.lit(1e-9))), (i % 3 == 0).cast("double")))).alias("x"))
    theta = choices.fit_choices(x, 2, pull=0.01, towards=(1.0, 0.0))[0]
    return spark.createDataFrame([(i, round(float(t), 4)) for i, t in enumerate(theta)], "i int, weight double")


#: Five folds under five seeds, fitted on rows of other folds with features of their own scale.
FOLDS_SQL = """SELECT s * 5 + g AS fit, vec_id, (f <> g)::INTEGER::DOUBLE AS w FROM (SELECT s, grp, (row_number() OVER (PARTITION BY s ORDER BY md5(s || '|' || grp), grp) - 1) % 5 AS f FROM (SELECT DISTINCT vec_id % 50 AS grp FROM p), range(5) t(s))
    JOIN (SELECT DISTINCT vec_id FROM p) ON vec_id % 50 = grp, range(5) q(g)"""
#: The second feature is scaled fit by fit: its ridge is that of the scaled weight.
STACK_SQL = "SELECT vec_id, truth, i, ln(greatest(p, 1e-9)) AS x0, i / 10 AS x1, 0 AS base FROM p"


@query(newton_sql(STACK_SQL, FOLDS_SQL, 0.0, (1.0, 0.0), """, q AS (SELECT f.vec_id, fit // 5 AS s, truth, i, exp(x0 * t0 + x1 * t1) / sum(exp(x0 * t0 + x1 * t1)) OVER (PARTITION BY f.vec_id, fit) AS p FROM f JOIN t USING (fit) JOIN x ON x.vec_id = f.vec_id WHERE w = 0),
  m AS (SELECT vec_id, truth, i, avg(p) AS p FROM q GROUP BY ALL) SELECT vec_id, round(max(CASE WHEN i = truth THEN p END), 5) AS p_true, round(max(p), 5) AS most FROM m GROUP BY vec_id"""))
def cross_fitted_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of a stack over given log-probabilities: five folds of whole groups under five seeds."""
    x = _choices(spark, sf_dir).select("vec_id", (F.col("vec_id") % 50).alias("grp"), "truth", F.flatten(F.transform("p", lambda p, i: F.array(F.log(F.greatest(p, F.lit(1e-9))), i.cast("double") / 10))).alias("x"))
    held, _ = choices.cross_fitted(x, "grp", 2, towards=(1.0, 0.0), unscaled=(0,))
    return held.select("vec_id", F.round(F.get("p", F.col("truth")), 5).alias("p_true"), F.round(F.array_max("p"), 5).alias("most"))


@query()
def spot_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive logit tables from binomial cells of all lines."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("q"), F.least(F.floor(F.col("l_extendedprice") / 10000), F.lit(5)).cast("int").alias("x"))  # noqa: E741
    tables = fitting.fit_binned_logit(c.binomial_cells(l, ["q", "x"], F.col("l_returnflag") == "R"), [("q", 5), ("x", 6)])
    return spark.createDataFrame([(k, i, round(float(v), 5)) for k, t in enumerate(tables) for i, v in enumerate(t)], "tab int, bin int, coefficient double")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, o_totalprice > 150000 AS won, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders WHERE o_custkey IS NOT NULL),
  h AS (SELECT *, CASE WHEN number <= 24 THEN (number - 1) // 12 + 1 ELSE (number - 25) // 3 + 3 END AS half, CASE WHEN number <= 24 THEN (number - 1) % 12 + 1 ELSE (number - 25) % 3 + 1 END AS hr FROM r),
  w AS (SELECT *, lag(won) OVER (PARTITION BY o_custkey, half ORDER BY hr) AS last FROM h),
  s AS (SELECT CASE WHEN half > 2 THEN 'overtime' WHEN hr = 1 THEN 'pistol round' WHEN hr = 2 AND last THEN 'after winning the pistol round' WHEN hr = 2 THEN 'after losing the pistol round' WHEN last THEN 'after a win' ELSE 'after a loss' END AS situation,
    CAST((o_totalprice >= 100000)::INT + (o_totalprice >= 200000)::INT AS INTEGER) AS buy FROM w),
  o AS (SELECT avg((buy = 0)::INT) AS a, avg((buy = 1)::INT) AS b, avg((buy = 2)::INT) AS c FROM s)
  SELECT situation, round((sum((buy = 0)::INT) + 3 * any_value(a)) / (count(*) + 3), 6) AS eco, round((sum((buy = 1)::INT) + 3 * any_value(b)) / (count(*) + 3), 6) AS force, round((sum((buy = 2)::INT) + 3 * any_value(c)) / (count(*) + 3), 6) AS full_buy FROM s, o GROUP BY 1""")
def buy_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import history as h

    o = table(spark, sf_dir, "orders").where("o_custkey is not null").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_totalprice") > 150_000).alias("won"))
    o = o.withColumn("number", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    half, place = h.half_numbers(F.col("number"))
    o = h.earlier_results(o.withColumn("half", half).withColumn("hr", place), ["o_custkey", "half"], ["hr"], "won")
    name = maps.situation(F.col("half"), F.col("hr"), F.col("won_last"), F.lit(False), F.lit(0))
    name = F.when(name.startswith("after a loss") | name.startswith("lost"), "after a loss").otherwise(name)
    buy = ((F.col("o_totalprice") >= 100_000).cast("int") + (F.col("o_totalprice") >= 200_000).cast("int")).alias("buy")
    p = maps.buy_priors(o.select(name.alias("situation"), buy))
    return p.select("situation", *(F.round(F.col("p")[i], 6).alias(a) for i, a in enumerate(("eco", "force", "full_buy"))))


#: A hundred draws of fifty groups of vectors, all rows once, and all but each of four folds.
REFITS_SQL = """SELECT draw AS fit, vec_id, copies::DOUBLE AS w FROM (SELECT draw, ('0x' || md5('0|' || draw || '|' || j)[1:15])::BIGINT % n AS rank, count(*) AS copies
      FROM (SELECT count(DISTINCT vec_id % 50) AS n FROM p), range(100) t(draw), LATERAL (SELECT unnest(range(n)) AS j) GROUP BY ALL)
    JOIN (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS rank FROM (SELECT DISTINCT vec_id % 50 AS grp FROM p)) USING (rank) JOIN (SELECT DISTINCT vec_id FROM p) ON vec_id % 50 = grp
  UNION ALL SELECT -1, vec_id, 1.0 FROM (SELECT DISTINCT vec_id FROM p)
  UNION ALL SELECT 1000 + g, vec_id, (f <> g)::INTEGER::DOUBLE FROM (SELECT grp, (row_number() OVER (ORDER BY md5('0|' || grp), grp) - 1) % 4 AS f FROM (SELECT DISTINCT vec_id % 50 AS grp FROM p)) JOIN (SELECT DISTINCT vec_id FROM p) ON vec_id % 50 = grp, range(4) q(g)"""


@query(newton_sql(FORMULA_SQL, REFITS_SQL, 0.01, (0.0, 0.0), """, v AS (SELECT fit, i, CASE WHEN i = 0 THEN t0 ELSE t1 END AS v FROM t, range(2) q(i)),
  h AS (SELECT avg(-ln(p)) AS loss FROM (SELECT truth, i, exp(x0 * t0 + x1 * t1) / sum(exp(x0 * t0 + x1 * t1)) OVER (PARTITION BY f.vec_id, fit) AS p FROM f JOIN t USING (fit) JOIN x ON x.vec_id = f.vec_id WHERE fit >= 1000 AND w = 0) WHERE i = truth)
  SELECT i::INTEGER AS i, round(max(CASE WHEN fit < 0 THEN v END), 4) AS weight, round(quantile_cont(v, 0.025) FILTER (fit BETWEEN 0 AND 999), 4) AS lo, round(quantile_cont(v, 0.975) FILTER (fit BETWEEN 0 AND 999), 4) AS hi, round(any_value(loss), 4) AS held_out_loss FROM v, h GROUP BY i"""))
def formula_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the conditional logit's weights from refits on resampled groups of vectors, and its held-out loss."""
    x = _two_features(spark, sf_dir)
    theta = choices.fit_choices(x, 2, pull=0.01)[0]
    again = choices.refits(x, "grp", 2, pull=0.01, draws=100)
    held, _ = choices.cross_fitted(x.drop("p"), "grp", 2, pull=0.01, unscaled=(0, 1), folds=4, seeds=1)
    loss = held.agg(F.avg(maths.log_loss(F.get("p", F.col("truth")))).alias("x")).first()["x"]
    ends = [np.percentile(again[:, i], (2.5, 97.5)) for i in range(2)]
    rows = [(i, *(round(float(v), 4) for v in (theta[i], *ends[i], loss))) for i in range(2)] if loss is not None else []
    return spark.createDataFrame(rows, "i int, weight double, lo double, hi double, held_out_loss double")


#: Expected and actual numbers of a team of five users' hidden ones by region, at every step; contact: any was seen before.
MOMENTS_SQL = """, met AS (SELECT walker, step, bool_or(seen >= 0) OVER (PARTITION BY walker ORDER BY step) AS contact FROM s),
  a AS (SELECT model, walker // 5 AS team, step, i AS region, sum(p[i + 1]) AS expected, sum((region = i)::INT) AS actual, bool_or(contact) AS contact, count(*) AS hidden FROM g JOIN met USING (walker, step), range(10) t(i) GROUP BY ALL)"""


def _team_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = b.configurations()
    samples = b.score(_steps(spark, sf_dir), ["user_id"], chain_models(spark, sf_dir), [named["prior_neg"], named["hmm"]], unseen=_unseen)
    return reports.moments(samples.withColumn("team", F.expr("user_id div 5")), ["team"])


@query(recursion_sql(STEPS_SQL, ("prior_neg", "hmm"), f"{MOMENTS_SQL} SELECT model, team, step::INTEGER AS step, bool_or(contact) AS contact, max(hidden) AS hidden, round(sum((expected - actual) ** 2), 6) AS count_brier FROM a GROUP BY model, team, step"))
def team_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of expected hidden users by region, for every team and step."""
    t = reports.team_table(_team_moments(spark, sf_dir), ["team"])
    return t.select("model", "team", "step", "contact", "hidden", F.round("count_brier", 6).alias("count_brier"))


def _count_bin() -> str:
    return "CASE " + " ".join(f"WHEN expected < {e} THEN {i}" for i, e in enumerate(reports.COUNTS[1:-1])) + f" ELSE {len(reports.COUNTS) - 2} END"


@query(recursion_sql(STEPS_SQL, ("prior_neg", "hmm"), f"{MOMENTS_SQL} SELECT model, contact, {_count_bin()} AS bin, count(*) AS n, round(avg(expected), 6) AS expected, round(avg(actual), 6) AS actual FROM a GROUP BY model, contact, bin"))
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual counts of a region, by the expected one, before and after contact."""
    c = reports.count_table(_team_moments(spark, sf_dir))
    return c.select("model", "contact", F.col("bin").cast("int").alias("bin"), "n", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"))


@query(recursion_sql(STEPS_SQL, ("last_seen", "hmm"), """, q AS (SELECT *, last_value(CASE WHEN seen >= 0 THEN seen // 10 END IGNORE NULLS) OVER (PARTITION BY walker ORDER BY step) AS last FROM s),
  y AS (SELECT g.model, g.p[region + 1] AS own, g.p[last + 1] = list_max(g.p) AS first, len(list_filter(g.p, lambda x: x = list_max(g.p))) AS ties FROM g JOIN q USING (walker, step) WHERE last IS NOT NULL)
  SELECT model, count(*) AS n, round(avg(CASE WHEN first THEN 1.0 / ties ELSE 0 END), 6) AS picks_last, round(avg(-ln(greatest(own, 1e-9))), 6) AS log_loss FROM y GROUP BY model"""))
def picks_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a model's first choice is the region of the last sighting."""
    named = b.configurations()
    samples = b.score(_steps(spark, sf_dir), ["user_id"], chain_models(spark, sf_dir), [named["last_seen"], named["hmm"]], unseen=_unseen)
    rows = reports.with_metrics(samples).where("last_region >= 0")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("picks_last"), 6).alias("picks_last"), F.round(F.avg("log_loss"), 6).alias("log_loss"))
