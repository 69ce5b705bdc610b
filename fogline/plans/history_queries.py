"""Round histories: the orders of a customer stand for the rounds of a match, a price over 150,000 for a win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history as h
from ..session import table
from .common import DAY, E, sightings
from .registry import query

R = """r AS (SELECT o_custkey, o_orderkey, o_totalprice > 150000 AS won, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders),
  h AS (SELECT *, CAST(CASE WHEN number <= 24 THEN (number - 1) // 12 + 1 ELSE (number - 25) // 3 + 3 END AS INTEGER) AS half,
        CAST(CASE WHEN number <= 24 THEN (number - 1) % 12 + 1 ELSE (number - 25) % 3 + 1 END AS INTEGER) AS half_round FROM r)"""


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 150_000).alias("won"))
    o = o.withColumn("number", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    half, place = h.half_numbers(F.col("number"))
    return o.withColumn("half", half).withColumn("half_round", place)


@query(f"WITH {R} SELECT o_orderkey, half, half_round FROM h")
def half_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounds(spark, sf_dir).select("o_orderkey", "half", "half_round")


@query(f"""WITH RECURSIVE {R}, b AS (SELECT o_custkey, half, half_round, o_orderkey, won, 0 AS losses FROM h WHERE half_round = 1
  UNION ALL SELECT h.o_custkey, h.half, h.half_round, h.o_orderkey, h.won, CASE WHEN b.won THEN greatest(b.losses - 1, 0) ELSE least(b.losses + 1, 4) END
  FROM b JOIN h ON h.o_custkey = b.o_custkey AND h.half = b.half AND h.half_round = b.half_round + 1) SELECT o_orderkey, losses FROM b""")
def loss_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.loss_bonus(_rounds(spark, sf_dir), ["o_custkey", "half"], ["half_round"], F.col("won")).select("o_orderkey", "losses")


@query(f"WITH {R} SELECT o_orderkey, lag(won) OVER w AS won_last, CASE WHEN half_round > 1 THEN first_value(won) OVER w END AS won_first FROM h WINDOW w AS (PARTITION BY o_custkey, half ORDER BY half_round)")
def earlier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.earlier_results(_rounds(spark, sf_dir), ["o_custkey", "half"], ["half_round"], "won").select("o_orderkey", "won_last", "won_first")


@query(f"""WITH {R}, t AS (SELECT o_custkey, won, row_number() OVER (PARTITION BY o_custkey ORDER BY number DESC) AS place FROM r)
  SELECT o_custkey, string_agg(CASE WHEN won THEN 'W' ELSE 'L' END, '' ORDER BY place) AS results FROM t WHERE place <= 5 GROUP BY 1""")
def last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rounds(spark, sf_dir).withColumn("x", F.when(F.col("won"), "W").otherwise("L"))
    return h.last_results(r, ["o_custkey"], ["number"], "x", 5).select("o_custkey", F.array_join("results", "").alias("results"))


@query(f"""WITH {E} SELECT user_id, us // {7 * DAY} AS week, arg_min(event_type, us) AS event_type, arg_min(cell, us) AS cell FROM e GROUP BY ALL""")
def opening_duel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir).withColumn("week", F.floor(F.col("us") / (7 * DAY)))
    return h.opening(e, ["user_id", "week"], ["us", "event_id"], ["event_type", "cell"])


@query(f"""WITH {E}, k AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL)
  SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS place FROM k QUALIFY place = 1""")
def mode_weapon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.most_frequent(sightings(spark, sf_dir), ["user_id"], "event_type").select("user_id", "event_type", "n", "place")


@query(f"""WITH {E}, k AS (SELECT user_id, cell, count(*) AS n FROM e GROUP BY ALL)
  SELECT user_id, cell, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, cell) AS place FROM k QUALIFY place <= 6""")
def habits_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.most_frequent(sightings(spark, sf_dir), ["user_id"], "cell", 6).select("user_id", "cell", "n", "place")


@query(f"""WITH {E}, l AS (SELECT event_id AS id, user_id, us FROM e WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, us FROM e WHERE event_type = 'view'),
  d AS (SELECT l.id, c.event_id, abs(c.us - l.us) AS d FROM l JOIN c ON l.user_id = c.user_id AND abs(c.us - l.us) <= {5 * DAY})
  SELECT id, event_id, row_number() OVER (PARTITION BY id ORDER BY d, event_id) AS place FROM d QUALIFY place <= 3""")
def clock_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three views of a user nearest in time to each purchase, within five days."""
    e = sightings(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "us")
    return h.nearest_in_time(left, e.where("event_type = 'view'").select("user_id", "us", "event_id"), ["user_id"], "us", 5 * DAY, 3, "event_id").select("id", "event_id", "place")


@query(f"""WITH {E}, s AS (SELECT user_id, us // {30 * DAY} AS month, list_sort(list(cell))[1:5] AS places FROM e GROUP BY ALL)
  SELECT user_id, month, list_aggregate(places, 'string_agg', ',') AS places FROM s""")
def snapshot_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five lowest cells of a user and month, sorted: how team snapshots are kept."""
    e = sightings(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / (30 * DAY)).alias("month")).agg(F.slice(F.array_sort(F.collect_list("cell")), 1, 5).alias("places"))
    return e.select("user_id", "month", F.array_join("places", ",").alias("places"))


@query(f"""WITH {E}, f AS (SELECT user_id, event_id, us, cell, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS number FROM e)
  SELECT a.event_id, count(b.event_id) AS before, CAST(sum((b.cell >= 50)::INT) AS BIGINT) AS high FROM f a LEFT JOIN f b ON a.user_id = b.user_id AND b.number < a.number GROUP BY 1""")
def history_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of a user before each event: a running window, not a self-join."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return sightings(spark, sf_dir).select("event_id", F.count("event_id").over(w).alias("before"), F.sum((F.col("cell") >= 50).cast("long")).over(w).alias("high"))
