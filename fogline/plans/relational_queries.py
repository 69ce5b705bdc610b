"""Joins, predicates and bins over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bins
from ..session import stored, table
from .common import DAY, E, sightings
from .registry import query


@query("""SELECT o.o_orderpriority AS priority, count(*) AS n, round(sum(l.l_quantity), 6) AS quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 60 DAY GROUP BY ALL""")
def dim_join_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderdate")
    inside = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return l.join(o, "l_orderkey").where(inside).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("""WITH s AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT l.l_orderkey, l.l_linenumber, coalesce(r.n, 0) AS returned FROM lineitem l
  LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) r USING (l_partkey, l_suppkey)""")
def left_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")  # noqa: E741
    r = l.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return l.join(r, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", F.coalesce("n", F.lit(0)).alias("returned"))


@query(f"""WITH {E}, d AS (SELECT user_id, us // {DAY} AS day, arg_min(event_id, us) AS first_id FROM e WHERE event_type = 'purchase' GROUP BY ALL)
  SELECT e.event_id, d.first_id FROM e LEFT JOIN d ON e.user_id = d.user_id AND e.us // {DAY} = d.day WHERE e.event_type = 'click'""")
def dedupe_then_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the user's first purchase of the day."""
    e = sightings(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    first = e.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.min_by("event_id", "us").alias("first_id"))
    return e.where("event_type = 'click'").join(first, ["user_id", "day"], "left").select("event_id", "first_id")


@query(f"""WITH {E} SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM e a JOIN e b
  ON a.user_id = b.user_id AND a.us // {7 * DAY} = b.us // {7 * DAY} AND a.event_type <> b.event_type GROUP BY ALL""")
def self_pairs_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different event types of a user in the same week."""
    e = sightings(spark, sf_dir).select("user_id", F.floor(F.col("us") / (7 * DAY)).alias("week"), "event_type")
    pairs = e.withColumnRenamed("event_type", "a").join(e.withColumnRenamed("event_type", "b"), ["user_id", "week"]).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("""WITH c AS (SELECT l_returnflag AS f, avg(l_quantity) AS cx, avg(l_discount * 100) AS cy FROM lineitem GROUP BY 1),
  l AS (SELECT row_number() OVER () AS id, l_quantity, l_discount FROM lineitem),
  d AS (SELECT id, f, round((l_quantity - round(cx, 6)) ** 2 + (l_discount * 100 - round(cy, 6)) ** 2, 6) AS d FROM l CROSS JOIN c),
  b AS (SELECT id, arg_min(f, struct_pack(d, f)) AS nearest FROM d GROUP BY ALL)
  SELECT nearest, count(*) AS n FROM b GROUP BY 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the nearest of three group centres, the centres being one row of an array."""
    l = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_returnflag")  # noqa: E741
    centres = l.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("cx"), F.round(F.avg(F.col("l_discount") * 100), 6).alias("cy")).orderBy("l_returnflag").collect()
    if not centres:
        return l.select(F.col("l_returnflag").alias("nearest"), F.lit(0).cast("long").alias("n"))
    marks = [F.struct(F.round(F.pow(F.col("l_quantity") - r["cx"], 2) + F.pow(F.col("l_discount") * 100 - r["cy"], 2), 6).alias("d"), F.lit(r["l_returnflag"]).alias("f")) for r in centres]
    return l.groupBy(F.least(*marks)["f"].alias("nearest") if len(marks) > 1 else marks[0]["f"].alias("nearest")).agg(F.count("*").alias("n"))


@query("""SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 4 END AS class, count(*) AS n FROM events GROUP BY 1""")
def recode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(bins.recode(F.col("event_type"), {"click": 0, "view": 1, "purchase": 2}, 4).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN o_totalprice < 50000 THEN '0-50k' WHEN o_totalprice < 100000 THEN '50-100k' WHEN o_totalprice < 200000 THEN '100-200k' ELSE '200k+' END AS label,
  count(*) AS n FROM orders GROUP BY 1""")
def cut_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = bins.label_bins(F.col("o_totalprice"), (50_000, 100_000, 200_000), ("0-50k", "50-100k", "100-200k", "200k+"))
    return table(spark, sf_dir, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT AS at_or_above,
  (l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 40)::INT AS above,
  CAST(greatest(0, least(floor(l_extendedprice / 5000), 9)) AS INTEGER) AS fixed, count(*) AS n FROM lineitem GROUP BY ALL""")
def searchsorted_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, edges = F.col("l_quantity"), (10, 20, 40)
    keys = [bins.bin_right(q, edges).alias("at_or_above"), bins.bin_left(q, edges).alias("above"), bins.fixed_bin(F.col("l_extendedprice"), 5000, 10).alias("fixed")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT c_custkey, sha1(CAST(c_custkey AS VARCHAR)) AS h FROM customer),
  s AS (SELECT c_custkey, (('0x' || h[1:10])::BIGINT % 10000 * 4576 + ('0x' || h[11:25])::BIGINT % 10000 * 6976 + ('0x' || h[26:40])::BIGINT % 10000) % 10000 / 10000.0 AS u FROM h)
  SELECT CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM s GROUP BY 1""")
def stable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(bins.split_of(F.col("c_custkey").cast("string")).alias("split")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT c_custkey, CAST('0x' || md5('7|' || c_custkey)[1:13] AS BIGINT) / 4503599627370496.0 AS u FROM customer)
  SELECT c_custkey FROM u ORDER BY u, c_custkey LIMIT 100""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample without replacement: the least hashes; a filter that surely keeps them comes first."""
    c = table(spark, sf_dir, "customer").select("c_custkey").withColumn("u", bins.hash_uniform(F.col("c_custkey"), seed="7"))
    return c.orderBy("u", "c_custkey").limit(100).select("c_custkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 16 = 0 AND l_shipdate IS NOT NULL AND l_returnflag IN ('A', 'R')""")
def modulo_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.where((F.pmod("l_orderkey", F.lit(16)) == 0) & F.col("l_shipdate").isNotNull() & F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber")


@query("""WITH u AS (SELECT o_orderkey AS id, o_custkey AS who, 'o' AS kind FROM orders UNION ALL SELECT l_orderkey, l_suppkey, 'l' FROM lineitem)
  SELECT kind, format('{}v{}', count(DISTINCT id), count(DISTINCT who)) AS label FROM u GROUP BY 1""")
def union_format_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.lit("o").alias("kind"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("who"), F.lit("l").alias("kind"))  # noqa: E741
    return o.unionByName(l).groupBy("kind").agg(F.format_string("%dv%d", F.countDistinct("id"), F.countDistinct("who")).alias("label"))


@query("""WITH x AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i, o_orderkey, (SELECT count(*) FROM orders) AS n FROM orders)
  SELECT o_orderkey, i FROM x WHERE i IN (SELECT CAST(round(k * (n - 1) / 19.0) AS BIGINT) FROM range(0, 20) AS t(k), (SELECT count(*) AS n FROM orders))""")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows at equal steps of a ranking. Ranks come from counts of range partitions, so no task sorts all rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey").alias("k"))
    parts = stored(o.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("part").orderBy("k")
    local = parts.withColumn("i", F.row_number().over(w) - 1)
    sizes = sorted((r["part"], r["n"]) for r in local.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part, n in sizes:
        before[part], total = total, total + n
    if not total:
        return o.select("o_orderkey", F.lit(0).cast("long").alias("i"))
    wanted = sorted({int(k * (total - 1) / 19 + 0.5) for k in range(20)})
    offset = F.element_at(F.create_map(*(F.lit(v) for kv in before.items() for v in kv)), F.col("part"))
    return local.withColumn("i", (F.col("i") + offset).cast("long")).where(F.col("i").isin(wanted)).select("o_orderkey", "i")
