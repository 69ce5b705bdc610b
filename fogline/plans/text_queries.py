"""Documents, answers and requests as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as w
from ..session import table
from .common import E, sightings
from .registry import query


@query("""SELECT place, count(*) AS n FROM (SELECT regexp_replace(upper(lang[1:1]) || lang[2:] || upper(source[1:1]) || source[2:], '([a-z])([A-Z])', '\\1 \\2', 'g') AS place FROM documents) GROUP BY 1""")
def callout_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    camel = F.concat(F.initcap("lang"), F.initcap("source"))
    return table(spark, sf_dir, "documents").groupBy(w.callout_name(camel).alias("place")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, to_json(struct_pack(turns := count(*), speakers := list_sort(list(DISTINCT role)), first := min(CASE WHEN turn = 0 THEN left(text, 20) END), chars := sum(length(text))::BIGINT)) AS doc
  FROM conversations GROUP BY 1""")
def describe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    doc = F.struct(F.count("*").alias("turns"), F.array_sort(F.collect_set("role")).alias("speakers"), F.min(F.when(F.col("turn") == 0, F.substring("text", 1, 20))).alias("first"), F.sum(F.length("text")).alias("chars"))
    return c.groupBy("conv_id").agg(F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


@query(f"""WITH {E}, a AS (SELECT event_id, cell % 7 - 2 AS x, cell % 5 AS y, cell % 3 AS z FROM e), p AS (SELECT event_id, greatest(x, 0) AS x, y, z FROM a)
  SELECT event_id, round(CASE WHEN x + y + z > 0 THEN x / (x + y + z) ELSE 1 / 3 END, 6) AS a, round(CASE WHEN x + y + z > 0 THEN y / (x + y + z) ELSE 1 / 3 END, 6) AS b, x + y + z > 0 AS answered FROM p""")
def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers to probabilities; without a positive total they are uniform and flagged."""
    k = F.col("cell")
    e = sightings(spark, sf_dir).select("event_id", F.to_json(F.struct((k % 7 - 2).alias("A"), (k % 5).alias("B"), (k % 3).alias("C"))).alias("answer"))
    p = w.clean_answer(F.from_json("answer", "map<string, double>"), ["A", "B", "C"])
    q = w.or_uniform(F.col("p"), 3)
    return e.select("event_id", p.alias("p")).select("event_id", F.round(q[0], 6).alias("a"), F.round(q[1], 6).alias("b"), F.col("p").isNotNull().alias("answered"))


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY 1")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answered row of each key of an append-only cache."""
    c = table(spark, sf_dir, "conversations").where("text is not null and text <> ''")
    return c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def requests_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without a cached answer."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT lang, round(sum(length(text) / 4), 4) AS tokens, round(0.5 * sum(length(text) / 4 * 0.7 * 0.1 + length(text) / 4 * 0.2 * 0.01 + length(text) / 4 * 0.1 * 0.125 + 50 * 0.5) / 1e6, 6) AS cost,
  round(quantile_cont(length(text) / 4, 0.9), 4) AS p90, round(avg(length(text) / 4), 4) AS mean FROM documents GROUP BY 1""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = w.tokens(F.col("text"))
    cost = w.price(t * 0.7, t * 0.2, t * 0.1, F.lit(50), (0.1, 0.01, 0.125, 0.5), 0.5)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.sum(t), 4).alias("tokens"), F.round(F.sum(cost), 6).alias("cost"), F.round(F.percentile(t, F.lit(0.9)), 4).alias("p90"), F.round(F.avg(t), 4).alias("mean"))


@query("SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS number FROM pages WHERE regexp_matches(url, '/(en|de)/[0-9]+')")
def regex_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").rlike("/(en|de)/[0-9]+")).select("page_id", F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", 2).alias("number"))


@query(f"""WITH {E}, s AS (SELECT user_id, list_sort(list(DISTINCT 'C' || lpad(CAST(cell AS VARCHAR), 2, '0'))) AS v FROM e WHERE event_type = 'error' GROUP BY 1)
  SELECT user_id, list_aggregate(v[1:12], 'string_agg', ', ') || CASE WHEN len(v) > 12 THEN ', and ' || (len(v) - 12) || ' more' ELSE '' END AS reachable FROM s""")
def reachable_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir).where("event_type = 'error'").groupBy("user_id").agg(F.collect_set(F.format_string("C%02d", "cell")).alias("v"))
    return e.select("user_id", F.array_join(w.first_and_more(F.col("v")), ", ").alias("reachable"))


@query(f"""WITH {E}, k AS (SELECT user_id, event_type, count(*) AS n, CAST(floor(max(value)) AS BIGINT) AS top FROM e GROUP BY ALL)
  SELECT user_id, coalesce(max(CASE WHEN event_type = 'view' THEN n END), 0) AS views, coalesce(max(CASE WHEN event_type = 'click' THEN top END), 0) AS clicks FROM k GROUP BY 1""")
def map_union_right_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps by event type; where both have a key the right one wins (an explicit merge, free of session settings)."""
    k = sightings(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").cast("long").alias("top"))
    maps = k.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("l"), F.map_from_entries(F.collect_list(F.when(F.col("event_type") == "click", F.struct("event_type", "top")))).alias("r"))
    merged = F.map_concat(F.map_filter("l", lambda key, v: ~F.map_contains_key("r", key)), F.col("r"))
    m = maps.select("user_id", merged.alias("m"))
    return m.select("user_id", F.coalesce(F.element_at("m", F.lit("view")), F.lit(0)).alias("views"), F.coalesce(F.element_at("m", F.lit("click")), F.lit(0)).alias("clicks"))


@query("""SELECT conv_id, CASE WHEN avg(length(text)) >= 400 THEN 'yes' WHEN avg(length(text)) >= 200 THEN 'partly' ELSE 'no' END AS long,
  CASE WHEN max(turn) <= 3 THEN 'walking' WHEN max(turn) / 2 <= 3 THEN 'running' ELSE 'too far' END AS reach FROM conversations GROUP BY 1""")
def threshold_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.avg(F.length("text")).alias("a"), F.max("turn").alias("t"))
    return c.select("conv_id", w.threshold_fact(F.col("a"), 400, 200).alias("long"), w.reach_fact(F.col("t"), F.col("t") / 2, F.lit(2.0)).alias("reach"))


@query("""WITH p AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: round(CAST(x AS DOUBLE) * x + 0.01, 2)) AS v FROM embeddings), q AS (SELECT vec_id, label % 4 AS l, list_transform(v, lambda x: x / list_sum(v)) AS p FROM p),
  t AS (SELECT vec_id, l, p, list_max(p) AS m FROM q)
  SELECT vec_id, round(CASE WHEN l = 0 THEN 0.4 ELSE 0 END + 0.6 * p[1], 6) AS first, round(CASE WHEN p[1] = m THEN 1.0 / len(list_filter(p, lambda x: x = m)) ELSE 0 END, 6) AS pick FROM t""")
def two_stage_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.maths import normalise

    v = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double") * x + 0.01, 2))
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4).alias("l"), v.alias("v")).select("vec_id", "l", normalise(F.col("v")).alias("p"))
    return e.select("vec_id", F.round(w.two_stage(F.lit(0.4), F.col("p"), F.col("l"))[0], 6).alias("first"), F.round(w.pick_features(F.col("p"))[0], 6).alias("pick"))
