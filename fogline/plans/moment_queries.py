"""Documents, requests and picture tables over the event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import describe as d
from ..operators import documents
from ..session import stored, table
from ..streaming import runs
from .common import DAY, E, sightings
from .registry import query


@query("""WITH x AS (SELECT o_orderpriority AS moment, l_returnflag AS region, l_quantity AS w, l_discount AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
  SELECT moment, region, round(sum(w * (1 - c)) / sum(w), 6) AS watched FROM x GROUP BY ALL""")
def watched_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("region"), F.col("l_quantity").alias("w"), F.col("l_discount").alias("c"))  # noqa: E741
    x = l.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("moment")), "o_orderkey")
    return d.watched_share(x, ["moment"], "region", "w", "c").withColumn("watched", F.round("watched", 6))


STRETCH = f"""s AS (SELECT user_id, us // {2 * DAY} AS step, max(cell) AS cell FROM e GROUP BY ALL), r AS (SELECT *, step - row_number() OVER (PARTITION BY user_id ORDER BY step) AS run, max(step) OVER (PARTITION BY user_id) AS now FROM s),
  i AS (SELECT user_id, max(step) AS last, min(step) AS first, arg_max(cell, step) AS cell, max(now) AS now FROM r GROUP BY user_id, run),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS place FROM i)"""


@query(f"""WITH {E}, {STRETCH} SELECT user_id, to_json(list(struct_pack(at := cell, seconds_ago := (now - last) * 2, seen_for_s := (last - first + 1) * 2) ORDER BY place)) AS history FROM p WHERE place <= 3 GROUP BY 1""")
def radar_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three stretches of two-day steps, as JSON."""
    s = sightings(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / (2 * DAY)).alias("step")).agg(F.max("cell").alias("cell"))
    return d.stretches(s, ["user_id"], "step", "cell", 2.0).select("user_id", F.to_json("history").alias("history"))


@query("""SELECT conv_id || '' AS key, count(*) AS questions, list_aggregate(list_sort(list('T' || turn || ':' || role)), 'string_agg', ',') AS asked FROM conversations WHERE role <> 'system' GROUP BY 1""")
def moment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a moment: a question for each turn, the choices being one list."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("label", F.concat(F.lit("T"), "turn", F.lit(":"), "role"))
    r = d.moment_requests(c, ["conv_id"], "label", F.array("role"), F.col("text"))
    return r.select("key", F.size("questions").cast("long").alias("questions"), F.array_join(F.array_sort(F.map_keys("questions")), ",").alias("asked"))


@query("""SELECT conv_id, CAST(sum((role = 'assistant')::INT) AS INTEGER) AS kept FROM conversations GROUP BY 1""")
def focused_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("label"), "turn")).alias("entities"))
    return c.select("conv_id", F.size(d.focused(F.col("entities"), F.lit("assistant"))).alias("kept"))


@query(f"""WITH {E}, f AS (SELECT user_id, 'R' || (cell // 25) AS region, count(*) AS visits FROM e GROUP BY ALL), m AS (SELECT DISTINCT user_id FROM e), r AS (SELECT DISTINCT region FROM f)
  SELECT user_id, region, coalesce(visits, 0) AS visits, round(CASE WHEN user_id % 3 <> 0 THEN coalesce(visits, 0) * 0.5 END, 6) AS answered FROM m CROSS JOIN r LEFT JOIN f USING (user_id, region)""")
def place_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every user and region, and an answer times a fact where there is an answer."""
    e = sightings(spark, sf_dir).withColumn("region", F.concat(F.lit("R"), F.floor(F.col("cell") / 25)))
    facts = e.groupBy("user_id", "region").agg(F.count("*").alias("visits"))
    f = d.place_features(e.select("user_id").distinct(), e.select("region"), facts, "user_id", "region", ["visits"])
    return f.withColumn("answered", F.round(d.answer_features(F.when(F.col("user_id") % 3 != 0, 0.5), F.col("visits")), 6)).select("user_id", "region", "visits", "answered")


@query(f"""WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS number FROM e),
  w AS (SELECT a.event_id, b.event_type AS t, count(*) AS c FROM n a JOIN n b ON a.user_id = b.user_id AND b.number < a.number GROUP BY ALL), m AS (SELECT event_id, t FROM w QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY c DESC, t) = 1),
  l AS (SELECT a.event_id, string_agg(CASE WHEN b.value > 50 THEN 'W' ELSE 'L' END, '' ORDER BY b.number DESC) AS r FROM n a JOIN n b ON a.user_id = b.user_id AND b.number < a.number AND b.number >= a.number - 5 GROUP BY 1),
  k AS (SELECT a.event_id, CAST(sum((b.cell >= 50)::INT) AS BIGINT) AS kb, CAST(sum((b.cell < 20)::INT) AS BIGINT) AS db FROM n a JOIN n b ON a.user_id = b.user_id AND b.number < a.number GROUP BY 1)
  SELECT n.user_id, n.number, coalesce(kb, 0) AS kills_before, coalesce(db, 0) AS deaths_before, coalesce(r, '') AS last_five, m.t AS main_weapon FROM n LEFT JOIN k USING (event_id) LEFT JOIN l USING (event_id) LEFT JOIN m USING (event_id)""")
def player_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    n = sightings(spark, sf_dir).select("user_id", F.row_number().over(w).alias("number"), (F.col("cell") >= 50).cast("long").alias("kills"), (F.col("cell") < 20).cast("long").alias("deaths"), (F.col("value") > 50).alias("won"), "event_type")
    return d.player_context(n, ["user_id"], "number", "kills", "deaths", "won", "event_type")


@query(f"""WITH {E} SELECT user_id % 10 AS grp, us // {30 * DAY} AS month, cell // 10 AS region, round(sum(value) / 100, 4) AS expected FROM e GROUP BY ALL""")
def expected_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir).select((F.col("user_id") % 10).alias("grp"), F.floor(F.col("us") / (30 * DAY)).alias("month"), F.floor(F.col("cell") / 10).alias("region"), (F.col("value") / 100).alias("m"))
    return d.expected_heat(e, ["grp", "month"], "region", "m").withColumn("expected", F.round("expected", 4))


@query(f"""WITH {E} SELECT user_id, us // {30 * DAY} AS month, max(us) - min(us) AS duration, CAST(sum((event_type = 'view')::INT) AS BIGINT) AS sightings, min(CASE WHEN cell % 5 = 1 THEN us END) AS clutch FROM e GROUP BY ALL""")
def round_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir).withColumn("month", F.floor(F.col("us") / (30 * DAY)))
    return d.round_list(e, ["user_id", "month"], "us", F.col("event_type") == "view", F.col("cell") % 5)


@query(f"""WITH {E}, f AS (SELECT user_id, us // {7 * DAY} AS week, us, event_type, cell FROM e), w AS (SELECT user_id, week, max(us) AS at FROM f GROUP BY ALL)
  SELECT w.user_id, w.week, s.cell AS ring, CAST(w.at - s.us AS BIGINT) AS age FROM w ASOF LEFT JOIN (SELECT user_id, us, cell FROM f WHERE event_type = 'view') s ON w.user_id = s.user_id AND w.at >= s.us""")
def last_seen_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At every week's end of a user, where it was last seen and how long ago."""
    from ..operators.temporal import asof_backward

    e = sightings(spark, sf_dir).withColumn("week", F.floor(F.col("us") / (7 * DAY)))
    ends = e.groupBy("user_id", "week").agg(F.max("us").alias("us"))
    seen = e.where("event_type = 'view'").select("user_id", "us", F.col("cell").alias("ring"))
    found = asof_backward(ends, seen, ["user_id"], "us", ["ring"], "week")
    return found.select("user_id", "week", "ring", (F.col("us") - F.col("right_us")).alias("age"))


@query(f"""WITH {E} SELECT c.event_id, count(*) AS n FROM e c JOIN e v ON c.user_id = v.user_id AND c.event_type = 'click' AND v.event_type = 'view' AND c.us >= v.us + {DAY // 2} AND c.us < v.us + {3 * DAY} GROUP BY 1""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks while an earlier view of the user is in force, from half a day after it to three days: two streams joined
    by key and event time, each with a watermark."""
    v = runs.event_stream(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("ts").alias("seen"))
    c = runs.event_stream(spark, sf_dir).where("event_type = 'click'").select("event_id", "user_id", "ts")
    on = F.expr("user_id = u and ts >= seen + interval 12 hours and ts < seen + interval 3 days")
    joined = runs.finished(c.join(v, on).select("event_id", "seen"), "append")
    return joined.groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, s AS (SELECT user_id // 10 AS demo, user_id AS steamid, CASE user_id % 2 WHEN 0 THEN 't' ELSE 'ct' END AS side, us // {DAY} * 16 AS tick, arg_max(cell, ROW(us, event_id)) AS cell, arg_max(event_type, ROW(us, event_id)) = 'view' AS spotted FROM e GROUP BY ALL),
  l AS (SELECT *, lag(CASE WHEN spotted THEN ROW(tick, cell) END) OVER w AS before FROM s WINDOW w AS (PARTITION BY steamid ORDER BY tick)),
  h AS (SELECT *, last_value(CASE WHEN spotted THEN {{'tick': tick, 'cell': cell, 'v': CASE WHEN before[1] = tick - 16 THEN 10 * (cell - before[2]) END}} END IGNORE NULLS) OVER (PARTITION BY steamid ORDER BY tick) AS last FROM l),
  r AS (SELECT DISTINCT demo, side, steamid FROM s), n AS (SELECT *, upper(side) || row_number() OVER (PARTITION BY demo, side ORDER BY steamid) AS id FROM r),
  m AS (SELECT DISTINCT demo, tick, f AS friendly FROM s, (VALUES ('t'), ('ct')) v(f)),
  x AS (SELECT m.demo, m.friendly, m.tick, n.id, h.spotted, h.cell, last, CASE WHEN last.v IS NOT NULL THEN 'R' || greatest(least(10 * last.cell + 400 * sign(last.v), 990), 0)::INTEGER // 100 END AS toward FROM m JOIN n ON n.demo = m.demo AND n.side <> m.friendly LEFT JOIN h ON h.steamid = n.steamid AND h.tick = m.tick),
  y AS (SELECT *, CASE WHEN spotted IS NULL THEN 'dead' WHEN spotted THEN 'on your radar now' WHEN last IS NULL THEN 'not seen yet this round' ELSE 'off your radar' END AS status, 'R' || last.cell // 10 AS was FROM x)
  SELECT demo::VARCHAR AS demo_id, friendly, tick::INTEGER AS tick, id, status, CASE WHEN spotted THEN 'R' || cell // 10 END AS "at", CASE WHEN status LIKE 'off%' THEN was END AS last_seen_at, CASE WHEN status LIKE 'off%' THEN round_even((tick - last.tick) / 64, 0)::BIGINT END AS seconds_since_seen,
    CASE WHEN status LIKE 'off%' THEN CASE WHEN abs(last.v) * 4 < 60 THEN 'holding still' WHEN toward <> was THEN 'moving toward ' || toward WHEN last.v IS NOT NULL THEN 'moving within ' || was END END AS when_last_seen FROM y""")
def enemy_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ten users' two sides know of each other day by day, a day being a step and a user's last event the state."""
    e = sightings(spark, sf_dir)
    day, at = F.expr(f"us div {DAY}"), F.struct("us", "event_id")
    last = e.groupBy("user_id", (day * 16).cast("int").alias("tick")).agg(F.max_by(F.struct("cell", "event_type"), at).alias("x"))
    region = lambda x: F.concat(F.lit("R"), F.floor(x / 100).cast("string"))
    x = (F.col("x.cell") * 10).cast("double")
    states = last.select(
        F.expr("cast(user_id div 10 as string)").alias("demo_id"), F.lit(1).alias("round_num"), F.col("user_id").alias("steamid"), F.when(F.col("user_id") % 2 == 0, "t").otherwise("ct").alias("side"), "tick",
        x.alias("X"), F.lit(0.0).alias("Y"), F.lit(0.0).alias("Z"), region(x).alias("region"), (F.col("x.event_type") == "view").alias("spotted"),
    )
    states = stored(states, "states")
    moments = states.select("demo_id", "round_num", "tick").distinct().withColumn("friendly", F.explode(F.array(F.lit("t"), F.lit("ct"))))
    known = documents.enemy_entries(moments, states, lambda p: p.withColumn("region", region(F.greatest(F.least("X", F.lit(990.0)), F.lit(0.0)))))
    return known.select("demo_id", "friendly", "tick", F.explode("enemies").alias("e")).select("demo_id", "friendly", "tick", "e.*")
