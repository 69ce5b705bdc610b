"""Storage, reports and look-ups over the event, star and text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import maps, reports
from ..session import shared_dir, stored, table
from ..sources import recordings as rec
from ..sources import refresh, store
from .common import DAY, E, sightings
from .registry import query


def _folder(spark: SparkSession) -> str:
    """A folder of the shared one that goes with the driver."""
    path = f"{shared_dir(spark).rstrip('/')}/fogline-records-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir)
    return e.select(F.floor(F.col("us") / 1_000_000).cast("int").alias("tick"), F.col("user_id").alias("steamid"), F.col("value").cast("float").alias("X"), F.col("cell").cast("int").alias("round_num"), F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))).alias("source"), F.concat(F.lit("d"), F.pmod("user_id", F.lit(7))).alias("demo_id"), F.lit(1).alias("other"))


@query(f"""WITH {E} SELECT 's' || (user_id % 3) AS source, 'd' || (user_id % 7) AS demo_id, count(*) AS n, count(DISTINCT user_id) AS who, max(us // 1000000)::INT AS latest, 0::BIGINT AS bombs
  FROM e WHERE user_id % 3 < 2 AND user_id % 7 IN (1, 2, 3) GROUP BY ALL""")
def match_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by match, one match refreshed, read by source, match and column; a table that was never written is empty."""
    s, rows = store.MatchStore(spark, _folder(spark)), _steps(spark, sf_dir)
    s.write("footsteps", rows.unionAll(rows.where("demo_id = 'd2'")))
    s.write("footsteps", rows.where("demo_id = 'd2'"))  # replaces that match alone
    demos = rows.where("demo_id in ('d1', 'd2', 'd3')").select("demo_id").distinct()
    read = s.read("footsteps", ["s0", "s1"], demos, ["tick", "steamid"])
    counted = read.groupBy("source", "demo_id").agg(F.count("*").alias("n"), F.countDistinct("steamid").alias("who"), F.max("tick").alias("latest"))
    return counted.withColumn("bombs", F.lit(s.read("bomb").count()).cast("long"))


@query("""SELECT DISTINCT 's' || (user_id % 3) AS source, 'd' || user_id AS demo_id FROM events WHERE user_id % 4 <> 1""")
def catalog_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no meta row yet."""
    s = store.MatchStore(spark, _folder(spark))
    found = sightings(spark, sf_dir).select(F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))).alias("source"), F.concat(F.lit("d"), "user_id").alias("demo_id"), "user_id").distinct()
    s.write_meta(found.where("user_id % 4 = 1").select("source", "demo_id", F.lit(1).alias("n_rounds")))
    return s.todo(found.select("source", "demo_id"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS demo_id, CASE c_custkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM customer""")
def csv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + "/splits"
    c = table(spark, sf_dir, "customer")
    part = F.pmod("c_custkey", F.lit(3))
    store.write_csv(c.select(F.col("c_custkey").cast("string").alias("demo_id"), F.when(part == 0, "test").when(part == 1, "val").otherwise("train").alias("split"), F.lit(0).alias("unused")), path)
    return store.read_splits(spark, path)


@query("""SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT -1, count(*) FROM region""")
def model_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a model saved and read; one that was never fitted is None."""
    s = store.MatchStore(spark, _folder(spark))
    s.save_model("m", {"nation": table(spark, sf_dir, "nation"), "region": table(spark, sf_dir, "region")})
    if s.load_part("m", "other") is not None:
        raise AssertionError("a part that was never fitted is None")
    a, b = s.load_part("m", "nation"), s.load_part("m", "region")
    return a.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n")).unionAll(b.agg(F.lit(-1), F.count("*")))


@query("""SELECT conv_id AS key, max(turn) FILTER (WHERE role <> 'system') AS written, arg_max(length(text), turn) FILTER (WHERE role <> 'system') AS answers FROM conversations
  GROUP BY 1 HAVING count(*) FILTER (WHERE role <> 'system') > 0""")
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended in two goes; the last answered one of each key counts."""
    path = _folder(spark) + "/answers"
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").cast("long").alias("written"), F.when(F.col("role") != "system", F.length("text").cast("long")).alias("answers"))
    store.append_answers(c.where("written % 2 = 0"), path)
    store.append_answers(c.where("written % 2 = 1"), path)
    return store.read_answers(spark, path, "key long, written long, answers long")


@query(f"""WITH {E}, s AS (SELECT c.c, f.f, c.c * 10 + f.f AS node, 100.0 * f.f + c.c AS z FROM range(9) c(c), range(3) f(f) WHERE f.f <= c.c % 3),
  p AS (SELECT event_id, cell // 10 AS cx, value AS zz FROM e WHERE event_type = 'view')
  SELECT event_id, coalesce(max_by(node, z) FILTER (WHERE z <= zz + 32), min_by(node, z), -1) AS node FROM p LEFT JOIN s ON p.cx = s.c GROUP BY event_id""")
def located_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest floor of a column that lies under a position, else its lowest; -1 beside the columns."""
    c = spark.range(9).select(F.col("id").alias("cx"), F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("id", F.lit(3)))).alias("f"))
    cells = c.select("cx", F.lit(0).cast("long").alias("cy"), (F.col("cx") * 10 + F.col("f")).alias("node"), (100.0 * F.col("f") + F.col("cx")).alias("z"))
    p = sightings(spark, sf_dir).where("event_type = 'view'").select("event_id", F.floor(F.col("cell") / 10).alias("cx"), F.lit(0).cast("long").alias("cy"), F.col("value").alias("Z"))
    return maps.locate(p, cells).select("event_id", F.coalesce("node", F.lit(-1).cast("long")).alias("node"))


@query(f"""WITH {E}, s AS (SELECT n AS node, (n * 37) % 100 AS x, (n * 53) % 100 AS y, (n % 3) * 40 AS z FROM range(40) t(n)),
  p AS (SELECT event_id, cell AS px, value / 5 AS py, (event_id % 90) AS pz FROM e WHERE event_type = 'purchase')
  SELECT event_id, arg_min(node, (x - px) ** 2 + (y - py) ** 2 + 4 * (z - pz) ** 2) AS node FROM p, s GROUP BY event_id""")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cell for positions beside the grid, heights counting double."""
    n = F.col("id")
    cells = spark.range(40).select(n.alias("node"), ((n * 37) % 100).cast("double").alias("x"), ((n * 53) % 100).cast("double").alias("y"), ((n % 3) * 40).cast("double").alias("z"))
    p = sightings(spark, sf_dir).where("event_type = 'purchase'").select("event_id", F.col("cell").cast("double").alias("X"), (F.col("value") / 5).alias("Y"), (F.col("event_id") % 90).cast("double").alias("Z"))
    return maps.nearest_cells(p, maps.Grid(cells, cells, 0.0, 0.0)).select("event_id", "node")


@query(f"""WITH {E}, f AS (SELECT *, min(us) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id) AS first FROM e)
  SELECT event_type AS model, coalesce(us >= first, false) AS after, count(*) AS n, round(avg((cell % 5 < 1)::INT), 9) AS top1, round(avg(-ln(greatest(cell / 100.0, 1e-9))), 9) AS log_loss FROM f GROUP BY ALL""")
def contact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores before and after a user's first view."""
    first = F.min(F.when(F.col("event_type") == "view", F.col("us"))).over(Window.partitionBy("user_id"))
    e = sightings(spark, sf_dir).withColumn("first", first)
    out = reports.around_contact(e.withColumnRenamed("event_type", "model"), "model", F.coalesce(F.col("us") >= F.col("first"), F.lit(False)), F.pmod("cell", F.lit(5)), F.col("cell") / 100)
    return out.select("model", "after", "n", F.round("top1", 9).alias("top1"), F.round("log_loss", 9).alias("log_loss"))


@query(f"""WITH {E}, q AS (SELECT event_type AS model, user_id, [1 + cell % 4, 1 + cell % 3, 1 + cell % 2]::DOUBLE[] AS w, (cell % 3)::INT AS truth, (user_id % 3)::INT AS last FROM e),
  r AS (SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS p FROM q),
  s AS (SELECT model, user_id, -ln(greatest(p[truth + 1], 1e-9)) AS l, (p[truth + 1] = list_max(p))::INT * 1.0 / len(list_filter(p, lambda x: x = list_max(p))) AS c,
    (p[last + 1] = list_max(p))::INT * 1.0 / len(list_filter(p, lambda x: x = list_max(p))) AS k FROM r),
  g AS (SELECT model, user_id, count(*) AS n, sum(l) AS l, sum(c) AS c, sum(k) AS k FROM s GROUP BY ALL),
  t AS (SELECT model, sum(n) AS n, sum(l) / sum(n) AS mean, sum(c) / sum(n) AS top1, sum(k) / sum(n) AS picks, count(*) AS m FROM g GROUP BY 1),
  v AS (SELECT t.model, sum((g.l - t.mean * g.n) ** 2) AS s FROM g JOIN t USING (model) GROUP BY 1)
  SELECT t.model, t.n::BIGINT AS n, round(top1, 8) AS top1, round(mean, 8) AS log_loss, round(mean - 1.96 * sqrt(s * m / greatest(m - 1, 1)) / t.n, 6) AS lo, round(mean + 1.96 * sqrt(s * m / greatest(m - 1, 1)) / t.n, 6) AS hi, round(picks, 8) AS picks_last
  FROM t JOIN v USING (model)""")
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cell")
    w = F.array(*((1 + F.pmod(c, F.lit(k))).cast("double") for k in (4, 3, 2)))
    e = sightings(spark, sf_dir).select(F.col("event_type").alias("model"), "user_id", w.alias("w"), F.pmod("cell", F.lit(3)).cast("int").alias("truth"), F.pmod("user_id", F.lit(3)).cast("int").alias("last"))
    e = e.withColumn("p", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, y: a + y)))
    out = reports.score_table(e, "model", "user_id", F.col("p"), F.col("truth"), F.col("last"))
    return out.select("model", "n", *(F.round(x, d).alias(x) for x, d in (("top1", 8), ("log_loss", 8), ("lo", 6), ("hi", 6), ("picks_last", 8))))


@query(f"""WITH {E}, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / {DAY}.0 AS since FROM e),
  r AS (SELECT event_type AS model, (since >= 0.5)::INT + (since >= 2)::INT + (since >= 8)::INT AS horizon, count(*) AS n, avg((cell < 30)::INT) AS rate FROM g WHERE since IS NOT NULL GROUP BY ALL)
  SELECT model, horizon, n, round(rate, 8) AS rate, round(((rate + 3.8416 / (2 * n)) - 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 8) AS lo,
    round(((rate + 3.8416 / (2 * n)) + 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 8) AS hi FROM r""")
def horizon_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = (F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))) / DAY
    e = sightings(spark, sf_dir).withColumn("since", since).where("since is not null").withColumnRenamed("event_type", "model")
    out = reports.horizon_curve(e, "model", F.col("since"), (0.5, 2, 8), F.col("cell") < 30)
    return out.select("model", F.col("horizon").cast("int").alias("horizon"), "n", *(F.round(x, 8).alias(x) for x in ("rate", "lo", "hi")))


@query("""SELECT role, count(*) AS n, round(avg(length(text)), 8) AS mean, quantile_cont(length(text), 0.5) AS median, round(quantile_cont(length(text), 0.9), 6) AS p90, max(length(text)) AS most FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("s"))
    out = reports.latency_summary(c, ["role"], "s")
    return out.select("role", "n", F.round("mean", 8).alias("mean"), "median", F.round("p90", 6).alias("p90"), "most")


@query("""WITH m AS (SELECT o_orderpriority AS model, unnest(['mean', 'spread']) AS metric, unnest([avg(o_totalprice), stddev_samp(o_totalprice)]) AS v FROM orders GROUP BY 1)
  SELECT model, metric, rank() OVER (PARTITION BY metric ORDER BY CASE metric WHEN 'spread' THEN v ELSE -v END) AS place FROM m""")
def sense_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by mean, highest first, and by spread, least first."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("spread"))
    long = o.select("model", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in ("mean", "spread")))).alias("r")).select("model", "r.*")
    return reports.by_sense(long, "metric", "v", ["spread"]).select("model", "metric", F.col("place").cast("long").alias("place"))


@query("""WITH a AS (SELECT l_returnflag AS a, l_shipdate::DATE AS b, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS k FROM lineitem GROUP BY ALL),
  c AS (SELECT a, sum(k) / sum(n) AS r FROM a GROUP BY 1 HAVING sum(n) >= 3), d AS (SELECT sum(k) / sum(n) AS r FROM a)
  SELECT l.l_orderkey, l.l_linenumber, round(coalesce(x.k / x.n, c.r, d.r), 9) AS rate FROM lineitem l LEFT JOIN a x ON x.a = l_returnflag AND x.b = l_shipdate::DATE AND x.n >= 3
  LEFT JOIN c ON c.a = l_returnflag CROSS JOIN d WHERE l_linenumber = 1""")
def rates_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of a row's flag and day, of its flag where there are too few rows, else of all."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("a"), F.to_date("l_shipdate").alias("b"), (F.col("l_linestatus") == "F").cast("long").alias("f"))  # noqa: E741
    rates = stored(l.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("f").alias("k")), "rates")
    out = reports.with_rates(l.where("l_linenumber = 1"), rates, ["a", "b"], "rate", 3)
    return out.select("l_orderkey", "l_linenumber", F.round("rate", 9).alias("rate"))


@query(f"""WITH {E}, c AS (SELECT cell % 10 AS x, cell // 10 AS y, min(event_type) AS region FROM e WHERE value > 100 GROUP BY ALL)
  SELECT a.x::BIGINT AS x, a.y::BIGINT AS y, o.side::INT AS side FROM c a, (VALUES (1, 0, 0), (0, 1, 1)) o(i, j, side) JOIN c b ON b.x = a.x + o.i AND b.y = a.y + o.j WHERE a.region <> b.region""")
def region_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir).where("value > 100")
    cells = e.groupBy(F.pmod("cell", F.lit(10)).cast("long").alias("x"), F.floor(F.col("cell") / 10).alias("y")).agg(F.min("event_type").alias("region"))
    return reports.borders(stored(cells, "cells"), "x", "y", "region")


@query("""SELECT r_regionkey, '{"type":"object","properties":{' || string_agg('"' || n_name || '":{"type":"number","minimum":0,"maximum":1}', ',' ORDER BY n_name) || '},"required":[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || '],"additionalProperties":false}' AS schema
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def answer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON schema of an answer about a region's nations."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("names"))
    return n.select("r_regionkey", reports.answer_schema(F.col("names")).alias("schema"))


@query("""SELECT event_id, CAST(event_id % 900 - event_id % 50 AS BIGINT) AS fresh, CAST(event_id % 50 AS BIGINT) AS cached, CAST(length(event_type) AS BIGINT) AS output, event_type = 'error' AS refused FROM events""")
def answer_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and refusals out of raw answers."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.struct((F.col("event_id") % 900).alias("input"), (F.col("event_id") % 50).alias("cached"), F.length("event_type").alias("output")).alias("usage"), F.when(F.col("event_type") == "error", "refusal").alias("stop"))).alias("raw"))
    return e.select("event_id", reports.usage(F.col("raw")).alias("u")).select("event_id", "u.*")


@query("""SELECT event_id, user_id, CASE user_id % 2 WHEN 0 THEN 't' ELSE 'ct' END AS side, CASE user_id % 2 WHEN 0 THEN 'ct' ELSE 't' END AS enemy FROM events""")
def side_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("user_id") % 2 == 0, "t").otherwise("ct").alias("side"))
    return e.withColumn("enemy", F.when(F.col("side") == "t", "ct").otherwise("t"))


@query(f"""WITH {E}, r AS (SELECT 's' || (user_id % 3) AS source, 'd' || (user_id % 7) AS demo_id, event_id::INTEGER AS tick, user_id AS steamid, round(value, 2) AS x FROM e)
  SELECT source, demo_id, tick, steamid, x, CAST(NULL AS VARCHAR) AS reason FROM r WHERE source IN ('s0', 's1') AND demo_id <> 'd3'
  UNION ALL SELECT DISTINCT source, demo_id, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), 'ValueError: truncated' FROM r WHERE demo_id = 'd3'""")
def ingest_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by source and match, some of which broke off: the rows of two sources that could be read, and the reasons
    why others could not. A second call finds nothing but the broken ones to do."""
    root, s = _folder(spark), store.MatchStore(spark, _folder(spark))
    e = sightings(spark, sf_dir)
    keys = [F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))).alias("source"), F.concat(F.lit("d"), F.pmod("user_id", F.lit(7))).alias("demo_id")]
    rows = e.select(*keys, F.lit(0).alias("o"), F.to_json(F.struct(F.lit("footsteps").alias("table"), F.col("event_id").alias("tick"), F.col("user_id").alias("steamid"), F.round("value", 2).alias("X"))).alias("value"))
    matches = rows.select("source", "demo_id").distinct()
    meta = matches.select("source", "demo_id", F.lit(1).alias("o"), F.lit('{"table": "meta", "map_name": "x", "n_rounds": 1}').alias("value"))
    ends = matches.where("demo_id <> 'd3'").select("source", "demo_id", F.lit(2).alias("o"), F.lit('{"table": "end"}').alias("value"))
    lines = rows.unionAll(meta).unionAll(ends).repartition("source", "demo_id").sortWithinPartitions("source", "demo_id", "o")
    lines.select("source", "demo_id", "value").write.partitionBy("source", "demo_id").text(root)
    for _ in range(2):
        _, failed = rec.ingest(s, root)
    read = s.read("footsteps", sources=["s0", "s1"], columns=["tick", "steamid", "X"])
    told = read.select("source", "demo_id", "tick", "steamid", F.round(F.col("X").cast("double"), 2).alias("x"), F.lit(None).cast("string").alias("reason"))
    return told.unionByName(failed.select("source", "demo_id", "reason"), allowMissingColumns=True)


@query("""WITH n AS (SELECT n_regionkey AS r_regionkey, string_agg('"' || n_name || '":{"type":"number","minimum":0,"maximum":1}', ',' ORDER BY n_name) AS p, string_agg('"' || n_name || '"', ',' ORDER BY n_name) AS r FROM nation GROUP BY 1)
  SELECT r_regionkey, '{"type":"object","properties":{"stay":{"type":"number","description":"Probability that the answer is yes: 0 means no, 1 means yes."},"where":{"type":"object","properties":{' || p || '},"required":[' || r || '],"additionalProperties":false}},"required":["stay","where"],"additionalProperties":false}' AS schema FROM n""")
def two_stage_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON schema of an answer in two stages about a region's nations."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("names"))
    return n.select("r_regionkey", reports.two_stage_schema(F.col("names")).alias("schema"))


@query(f"""WITH {E}, d AS (SELECT DISTINCT 's' || (user_id % 3) AS source, 'm' || (user_id % 40) AS demo_id FROM e),
  h AS (SELECT *, sha1(demo_id) AS h FROM d), u AS (SELECT *, (('0x' || h[1:10])::BIGINT % 10000 * 4576 + ('0x' || h[11:25])::BIGINT % 10000 * 6976 + ('0x' || h[26:40])::BIGINT % 10000) % 10000 / 10000.0 AS u FROM h),
  s AS (SELECT source, demo_id, CASE WHEN demo_id IN ('m1', 'm2') THEN 'test' WHEN demo_id = 'm3' THEN 'val' WHEN u < 0.2 THEN 'test' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split FROM u)
  SELECT source, demo_id, split FROM s WHERE split IN ('test', 'val') AND source IN ('s0', 's2')""")
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's matches of two splits and sources; lists override the split by hash, the last one that names a match."""
    s, e = store.MatchStore(spark, _folder(spark)), sightings(spark, sf_dir)
    named = e.select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(40))).alias("demo_id"), F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))).alias("source"))
    s.write_meta(named.distinct())
    lists = [spark.createDataFrame(rows, "demo_id string, split string") for rows in ([("m1", "train"), ("m2", "test")], [("m1", "test"), ("m3", "val")])]
    return s.demos(["test", "val"], ["s0", "s2"], lists).select("source", "demo_id", "split")


@query(f"""WITH {E}, x AS (SELECT 'd' || (user_id % 7) AS demo_id, user_id AS entity_id, (us // 36000000 % 1000000)::INTEGER AS tick, event_type FROM e),
  s AS (SELECT demo_id, entity_id, tick AS start_tick FROM x WHERE event_type = 'view'), c AS (SELECT demo_id, entity_id, tick FROM x WHERE event_type = 'click'),
  n AS (SELECT s.demo_id, s.entity_id, s.start_tick, (SELECT min(c.tick) FROM c WHERE c.demo_id = s.demo_id AND c.entity_id = s.entity_id AND c.tick > s.start_tick) AS later FROM s)
  SELECT demo_id, entity_id::INTEGER AS entity_id, start_tick, CASE WHEN demo_id IN ('d1', 'd2', 'd3') THEN CASE WHEN later - start_tick < 2304 THEN later ELSE start_tick + 1152 END ELSE -1 END AS end_tick FROM n""")
def refreshed_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smokes whose ends are made anew for three matches and left as they were for the others."""
    s, e = store.MatchStore(spark, _folder(spark)), sightings(spark, sf_dir)
    x = e.select(F.lit("a").alias("source"), F.concat(F.lit("d"), F.pmod("user_id", F.lit(7))).alias("demo_id"), F.col("user_id").cast("int").alias("entity_id"), F.expr("us div 36000000 % 1000000").cast("int").alias("tick"), "event_type")
    s.write("smokes", x.where("event_type = 'view'").select("source", "demo_id", "entity_id", F.col("tick").alias("start_tick"), F.lit(-1).alias("end_tick")))
    some = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "demo_id string")
    refresh.refresh_grenade_ends(s, x.where("event_type = 'click'").select(F.lit("smokes").alias("table"), "demo_id", "entity_id", "tick"), some)
    return s.read("smokes", columns=["entity_id", "start_tick", "end_tick"]).drop("source")
