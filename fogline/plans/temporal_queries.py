"""Queries over time: as-of joins, forward fills, islands, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal as t
from .common import DAY, E, sightings
from .registry import query


@query(f"""WITH {E} SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN cell END IGNORE NULLS) OVER w AS seen_cell,
  us - last_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER w AS since
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ffill_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, seen = sightings(spark, sf_dir), F.col("event_type") == "view"
    e = t.forward_fill(e, ["user_id"], ["us", "event_id"], F.col("cell"), seen, "seen_cell")
    e = t.forward_fill(e, ["user_id"], ["us", "event_id"], F.col("us"), seen, "seen_us")
    return e.select("event_id", "seen_cell", (F.col("us") - F.col("seen_us")).alias("since"))


@query(f"""WITH {E} SELECT event_id, us - last_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER w AS since,
  coalesce(max(CASE WHEN event_type = 'view' THEN 1 END) OVER w, 0) = 1 AS seen_before
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def strict_ffill_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.forward_fill(sightings(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("us"), F.col("event_type") == "view", "seen_us", strict=True)
    return e.select("event_id", (F.col("us") - F.col("seen_us")).alias("since"), F.col("seen_us").isNotNull().alias("seen_before"))


@query(f"""WITH {E} SELECT l.event_id, r.us AS purchase_us, r.value AS purchase_value
  FROM (SELECT * FROM e WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') r
  ON l.user_id = r.user_id AND l.us >= r.us""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir)
    right = e.where("event_type = 'purchase'").select("user_id", "us", F.col("value").alias("purchase_value"))
    left = e.where("event_type = 'click'").select("user_id", "us", "event_id")
    return t.asof_backward(left, right, ["user_id"], "us", ["purchase_value"], "event_id").select("event_id", F.col("right_us").alias("purchase_us"), "purchase_value")


@query(f"""WITH {E}, n AS (SELECT l.event_id, l.us, (SELECT min(r.us) FROM e r WHERE r.event_type = 'purchase' AND r.user_id = l.user_id AND r.us > l.us) AS nxt
  FROM e l WHERE event_type = 'click')
  SELECT event_id, CASE WHEN nxt - us < {20 * DAY} THEN nxt ELSE us + {5 * DAY} END AS end_us FROM n""")
def asof_forward_strict_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click lives until the user's next purchase if that comes within 20 days, else for 5."""
    e = sightings(spark, sf_dir)
    starts = e.where("event_type = 'click'").select("user_id", "us", "event_id")
    return t.lifetimes(starts, e.where("event_type = 'purchase'").select("user_id", "us"), ["user_id"], "us", "event_id", 20 * DAY, 5 * DAY).select("event_id", "end_us")


@query(f"""WITH {E}, c AS (SELECT event_id, CAST(floor(value / 50) AS BIGINT) AS v, user_id, us FROM e),
  d AS (SELECT event_id, v, coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY us, event_id), 0) AS b FROM c)
  SELECT event_id, v FROM d WHERE v > 0 AND v <> b""")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 50))
    return t.changes(e, ["user_id"], ["us", "event_id"], "v").select("event_id", "v")


@query(f"""WITH {E}, m AS (SELECT cell, lead(cell) OVER w AS next_cell, lead(us) OVER w - us AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
  SELECT cell, next_cell, count(*) AS n FROM m WHERE gap <= {10 * DAY} GROUP BY ALL HAVING count(*) >= 2""")
def lead_gap_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.counting import transitions

    return transitions(t.moves(sightings(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", "cell", most=10 * DAY), [], "cell", "next_cell", 2)


@query(f"""WITH {E}, d AS (SELECT DISTINCT user_id, us // {2 * DAY} AS step FROM e),
  r AS (SELECT user_id, step, step - row_number() OVER (PARTITION BY user_id ORDER BY step) AS run FROM d),
  i AS (SELECT user_id, min(step) AS first, max(step) AS last, count(*) AS n FROM r GROUP BY user_id, run),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS place FROM i)
  SELECT user_id, first, last, n, place FROM p WHERE place <= 3""")
def islands_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbroken stretches of two-day steps with events, newest first."""
    d = sightings(spark, sf_dir).select("user_id", F.floor(F.col("us") / (2 * DAY)).alias("step")).distinct()
    return t.islands(d, ["user_id"], "step", 3).select("user_id", "first", "last", "n", "place")


@query(f"""WITH {E} SELECT event_id, round(max(CASE WHEN event_type = 'purchase' THEN value END) OVER w, 6) AS best
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.running_best(sightings(spark, sf_dir), ["user_id"], ["us", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "best")
    return e.select("event_id", F.round("best", 6).alias("best"))


@query(f"""WITH {E}, k AS (SELECT event_id, user_id, CAST(ceil(us / {DAY}.0) AS BIGINT) * {DAY} AS applied FROM e WHERE event_type = 'error'),
  s AS (SELECT DISTINCT user_id, (us // {DAY}) * {DAY} AS applied FROM e)
  SELECT k.event_id, k.applied FROM k JOIN s ON k.user_id = s.user_id AND k.applied = s.applied""")
def step_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that are applied at the first day step after them, where the user has one."""
    e = sightings(spark, sf_dir)
    k = e.where("event_type = 'error'").select("event_id", "user_id", t.snap_up(F.col("us"), DAY).alias("applied"))
    s = e.select("user_id", (F.floor(F.col("us") / DAY) * DAY).alias("applied")).distinct()
    return k.join(s, ["user_id", "applied"]).select("event_id", "applied")


@query(f"""WITH {E} SELECT user_id, us // {7 * DAY} AS step, CAST(max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS INTEGER) AS seen,
  arg_max(CASE WHEN event_type = 'view' THEN cell END, CASE WHEN event_type = 'view' THEN us END) AS cell FROM e GROUP BY ALL""")
def sample_in_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir).withColumn("is_view", F.col("event_type") == "view")
    return t.seen_in_step(e, ["user_id"], "us", 7 * DAY, "is_view", "cell")


@query(f"""WITH {E} SELECT p.event_id, count(*) AS n, round(sum(s.value), 6) AS total FROM e p JOIN e s
  ON p.user_id = s.user_id AND p.event_type = 'click' AND s.event_type = 'view' AND p.us >= s.us AND p.us < s.us + {6 * DAY} GROUP BY p.event_id""")
def interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within six days after a view of the user."""
    e = sightings(spark, sf_dir)
    spans = e.where("event_type = 'view'").select("user_id", F.col("us").alias("start"), (F.col("us") + 6 * DAY).alias("stop"), F.col("value").alias("v"))
    points = e.where("event_type = 'click'").select("user_id", "us", "event_id")
    found = t.interval_join(points, spans, ["user_id"], "us", "start", "stop", 6 * DAY)
    return found.groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(f"""WITH {E} SELECT p.event_id FROM e p WHERE p.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM e s
  WHERE p.user_id = s.user_id AND s.event_type = 'error' AND p.us >= s.us AND p.us <= s.us + {3 * DAY})""")
def interval_closed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that lie in no closed three-day span after an error of the user."""
    e = sightings(spark, sf_dir)
    spans = e.where("event_type = 'error'").select("user_id", F.col("us").alias("start"), (F.col("us") + 3 * DAY).alias("stop"))
    points = e.where("event_type = 'click'").select("user_id", "us", "event_id")
    return t.interval_join(points, spans, ["user_id"], "us", "start", "stop", 3 * DAY, closed=True, how="left_anti").select("event_id")


@query(f"""WITH {E}, s AS (SELECT user_id, us // {DAY} AS step, max(cell) AS x, min(cell) AS y FROM e GROUP BY ALL)
  SELECT user_id, step, CASE WHEN step - lag(step) OVER w = 1 THEN x - lag(x) OVER w ELSE 0 END AS dx,
         CASE WHEN step - lag(step) OVER w = 1 THEN y - lag(y) OVER w ELSE 0 END AS dy FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step)""")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / DAY).alias("step")).agg(F.max("cell").alias("x"), F.min("cell").alias("y"))
    return t.displacement(s, ["user_id"], ["step"], "step", ["x", "y"], 1).select("user_id", "step", "dx", "dy")


@query(f"""WITH {E}, s AS (SELECT user_id, cell, us, event_id, lead(event_id) OVER w AS nxt, us - lag(us) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
  SELECT event_id, nxt AS next_id, gap IS NULL OR gap > {4 * DAY} AS starts FROM s""")
def linked_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linked list of each user's states, and where a trajectory begins."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    gap = F.col("us") - F.lag("us").over(w)
    return sightings(spark, sf_dir).select("event_id", F.lead("event_id").over(w).alias("next_id"), (gap.isNull() | (gap > 4 * DAY)).alias("starts"))

