"""Streams run to their end, against the same question over the finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import belief
from ..session import held, table
from ..streaming import online, runs
from . import model_queries
from .common import DAY, E, sightings
from .registry import query


@query(f"""WITH {E} SELECT us // 86400000000 AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.finished(runs.tumbling_counts(runs.event_stream(spark, sf_dir), "1 day"))
    r = runs.latest(rows, ["w", "event_type"])
    return r.select(F.floor(F.unix_micros("w.start") / 86400000000).alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {E}, g AS (SELECT user_id, us, coalesce(us - lag(us) OVER w >= {3 * 86400000000}, true) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
  s AS (SELECT user_id, us, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with gaps of three days, all of them after the last batch of a stream."""
    rows = runs.finished(runs.sessions(runs.event_stream(spark, sf_dir), "3 days"), "complete")
    last = rows.agg(F.max("batch").alias("batch"))  # one row
    return rows.join(F.broadcast(last), "batch", "left_semi").select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query(f"""WITH {E}, g AS (SELECT user_id, us, coalesce(us - lag(us) OVER w >= {3 * 86400000000}, true) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
  s AS (SELECT user_id, us, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g)
  SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, session HAVING (max(us) + {3 * 86400000000}) // 1000 <= ((SELECT max(us) FROM e) - 86400000000) // 1000""")
def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions only, in append mode behind a watermark of a day."""
    closed = runs.finished(runs.sessions(runs.event_stream(spark, sf_dir, "1 day"), "3 days"), "append")
    return closed.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query(f"""WITH {E} SELECT user_id, coalesce(max(CASE WHEN event_type = 'view' THEN us END), -1) AS seen_us, coalesce(arg_max(cell, CASE WHEN event_type = 'view' THEN us END), -1) AS cell, count(*) AS n FROM e GROUP BY 1""")
def stream_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest(runs.finished(runs.last_seen(runs.event_stream(spark, sf_dir))), ["user_id"])


#: Days of a round of the online filter.
ROUND = 10


@query(f"""WITH {E}, p AS (SELECT *, us // {6 * DAY} + (event_id % 10 = 0)::INT AS part FROM e),
  m AS (SELECT part, max(max(us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 86400000 AS mark FROM p GROUP BY part)
  SELECT us // {DAY} AS day, event_type, count(*) AS n FROM p JOIN m USING (part) WHERE mark IS NULL OR (us // {DAY} + 1) * 86400000 > mark GROUP BY ALL""")
def stream_dropped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of a stream that gets six days of events at a time, a tenth of them one delivery late: behind a
    watermark of a day most of those rows are dropped."""
    base = runs.new_base(spark)
    raw = table(spark, sf_dir, "events").withColumn("part", F.expr(f"unix_micros(cast(ts as timestamp)) div {6 * DAY} + cast(event_id % 10 = 0 as int)"))
    ends = raw.agg(F.min("part").alias("a"), F.max("part").alias("b")).first()
    rows = None
    for part in range(ends["a"], ends["b"] + 1) if ends["a"] is not None else ():
        raw.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/input/events.parquet")
        rows = runs.finished(runs.tumbling_counts(runs.event_stream(spark, f"{base}/input", "1 day"), "1 day"), "update", base)
    if rows is None:
        return spark.createDataFrame([], "day long, event_type string, n long")
    return runs.latest(rows, ["w", "event_type"]).select(F.floor(F.unix_micros("w.start") / DAY).alias("day"), "event_type", "n")


@query(model_queries.recursion_sql(
    f"SELECT user_id * 1000 + us // {ROUND * DAY} % 1000 AS walker, event_id, row_number() OVER (PARTITION BY user_id, us // {ROUND * DAY} ORDER BY us, event_id) - 1 AS step, CASE WHEN event_type = 'view' THEN cell ELSE -1 END AS seen, cell AS true_cell FROM e",
    ("hmm",),
    "SELECT event_id, step::INTEGER AS step, round(p[region + 1], 6) AS p_region FROM g",
))
def stream_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid filter on the event stream, in rounds of ten days, where the entity is hidden."""
    e = runs.event_stream(spark, sf_dir, "1 day")
    us = F.unix_micros("ts")
    seen = F.when(F.col("event_type") == "view", F.col("cell")).otherwise(-1)
    rows = e.select("ts", "user_id", F.expr(f"unix_micros(ts) div {ROUND * DAY}").alias("round"), us.alias("us"), "event_id", seen.alias("seen"), F.col("cell").alias("true"), (F.expr(f"unix_micros(ts) div {ROUND * DAY}") * (ROUND * DAY) + ROUND * DAY).alias("until"))
    cfg = belief.configurations()["hmm"].parts[0][1]
    with held(spark, online.PROVIDER):
        said = runs.finished(online.beliefs(rows, ["user_id", "round"], model_queries.chain_models(spark, sf_dir), cfg, model_queries._unseen, DAY), "append")
    hidden = said.join(e_hidden(spark, sf_dir), "event_id")
    return hidden.where("not late").select("event_id", "step", F.round("p_region", 6).alias("p_region"))


def e_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).where("event_type <> 'view'").select("event_id")
