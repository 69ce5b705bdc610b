"""Scores of probability tables. The embeddings' squared parts are the probabilities, their label the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths
from ..operators import scoring as s
from ..session import table
from .registry import query

#: Ten probabilities of each vector from its first ten components, rounded so that both engines agree on ties.
P = """v AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: round(CAST(x AS DOUBLE) * x + 0.001, 3)) AS w FROM embeddings),
  p AS (SELECT vec_id, label, list_transform(w, lambda x: x / list_sum(w)) AS p FROM v)"""


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: F.round(x.cast("double") * x + 0.001, 3)).alias("w"))
    return v.select("vec_id", F.col("label").cast("int").alias("label"), maths.normalise(F.col("w")).alias("p"))


@query(f"""WITH {P} SELECT vec_id, CAST(len(list_filter(p, lambda x: x >= p[label + 1])) - 1 AS INTEGER) AS rank, list_position(p, list_max(p)) - 1 AS pick FROM p""")
def rank_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probs(spark, sf_dir).select("vec_id", maths.rank_against(F.col("p"), F.col("label")).alias("rank"), maths.first_argmax(F.col("p")).alias("pick"))


@query(f"""WITH {P}, c AS (SELECT vec_id, len(list_filter(p, lambda x: x > p[label + 1])) AS above, len(list_filter(p, lambda x: x = p[label + 1])) AS tied FROM p)
  SELECT vec_id, round(greatest(0, least(1 - above, tied)) / tied, 6) AS top1, round(greatest(0, least(3 - above, tied)) / tied, 6) AS top3 FROM c""")
def split_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probs(spark, sf_dir)
    return p.select("vec_id", *(F.round(maths.split_credit(F.col("p"), F.col("label"), k), 6).alias(f"top{k}") for k in (1, 3)))


EDGES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)
_BIN = "greatest(0, least(" + " + ".join(f"(x >= {e})::INT" for e in EDGES) + f" - 1, {len(EDGES) - 2}))"


@query(f"""WITH {P}, x AS (SELECT label, unnest(p) AS x, unnest(range(0, 10)) AS i FROM p), b AS (SELECT CAST({_BIN} AS INTEGER) AS bin, x, (i = label)::INT AS hit FROM x)
  SELECT bin, count(*) AS n, round(avg(x), 6) AS said, round(avg(hit), 6) AS there FROM b GROUP BY 1""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = s.reliability(_probs(spark, sf_dir), "p", "label", EDGES)
    return r.select("bin", "n", F.round("said", 6).alias("said"), F.round("there", 6).alias("there"))


@query(f"""WITH {P}, x AS (SELECT label, unnest(p) AS x, unnest(range(0, 10)) AS i FROM p), b AS (SELECT {_BIN} AS bin, x, (i = label)::INT AS hit FROM x),
  r AS (SELECT bin, count(*) AS n, avg(x) AS said, avg(hit) AS there FROM b GROUP BY 1) SELECT round(sum(n * abs(said - there)) / sum(n), 6) AS ece FROM r""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.calibration_error(s.reliability(_probs(spark, sf_dir), "p", "label", EDGES)).select(F.round("ece", 6).alias("ece"))


@query(f"""WITH {P}, x AS (SELECT vec_id % 3 AS model, vec_id % 4 AS since, label, len(list_filter(p, lambda x: x >= p[label + 1])) - 1 AS rank, p[label + 1] AS pt FROM p)
  SELECT CAST(grouping(model, since) AS BIGINT) AS slice, model, since, count(*) AS n, round(avg((rank < 1)::INT), 6) AS top1, round(avg((rank < 3)::INT), 6) AS top3,
    round(avg(-ln(greatest(1e-9, least(1, pt)))), 6) AS log_loss FROM x GROUP BY GROUPING SETS ((model), (model, since), ())""")
def summary_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by model, by model and age, and overall, in one pass."""
    p = _probs(spark, sf_dir)
    x = p.select((F.col("vec_id") % 3).alias("model"), (F.col("vec_id") % 4).alias("since"), maths.rank_against(F.col("p"), F.col("label")).alias("rank"), F.element_at("p", F.col("label") + 1).alias("p_true"))
    r = s.summary(x, [["model"], ["model", "since"], []])
    return r.select("slice", "model", "since", "n", *(F.round(c, 6).alias(c) for c in ("top1", "top3", "log_loss")))


@query("""WITH a AS (SELECT l_suppkey, l_linenumber AS i, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_suppkey, sum(n) AS total FROM a GROUP BY 1),
  o AS (SELECT i, sum(n) / (SELECT count(*) FROM lineitem) AS share FROM a GROUP BY 1)
  SELECT t.l_suppkey, round(sum((o.share * t.total - coalesce(a.n, 0)) ** 2), 6) AS brier FROM t CROSS JOIN o LEFT JOIN a ON a.l_suppkey = t.l_suppkey AND a.i = o.i GROUP BY 1""")
def count_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual counts of line numbers by supplier."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber")  # noqa: E741
    places = [r["l_linenumber"] for r in l.groupBy("l_linenumber").agg(F.count("*").alias("n")).orderBy("l_linenumber").collect()]
    counts = [F.count(F.when(F.col("l_linenumber") == i, 1)).cast("double") for i in places]
    share = l.agg(*(c.alias(f"s{i}") for i, c in enumerate(counts)), F.count("*").alias("n")).first()
    of = l.groupBy("l_suppkey").agg(F.array(*counts).alias("actual"), F.count("*").alias("total"))
    expected = F.array(*(F.col("total") * F.lit(share[f"s{i}"] / share["n"]) for i in range(len(places))))
    return of.select("l_suppkey", F.round(s.count_brier(expected, F.col("actual")), 6).alias("brier"))


@query("""WITH x AS (SELECT l_suppkey, avg(l_quantity) / 50 AS x, avg((l_returnflag = 'R')::INT) AS a FROM lineitem GROUP BY 1),
  b AS (SELECT CAST(greatest(0, least((x >= 0)::INT + (x >= 0.5)::INT + (x >= 0.51)::INT + (x >= 1)::INT - 1, 2)) AS INTEGER) AS bin, x, a FROM x)
  SELECT bin, count(*) AS n, round(sum(x) / count(*), 6) AS expected, round(sum(a) / count(*), 6) AS actual FROM b GROUP BY 1""")
def count_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") / 50).alias("x"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("a"))
    r = s.count_calibration(x, "x", "a", (0.0, 0.5, 0.51, 1.0))
    return r.select("bin", "n", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"))


@query("""WITH m AS (SELECT l_suppkey, l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS mass FROM lineitem GROUP BY ALL),
  b AS (SELECT *, coalesce(sum(mass) OVER (PARTITION BY l_suppkey ORDER BY mass DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.8 * sum(mass) OVER (PARTITION BY l_suppkey) AS need FROM m),
  k AS (SELECT *, min(CASE WHEN need THEN mass END) OVER (PARTITION BY l_suppkey) AS least_mass FROM b) SELECT l_suppkey, l_partkey, mass FROM k WHERE mass >= least_mass""")
def hdr80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that hold 80 % of a supplier's quantity."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("double").alias("mass"))
    return s.highest_density(m, ["l_suppkey"], "mass", 0.8, "l_partkey").select("l_suppkey", "l_partkey", "mass")


@query(f"""WITH {P}, c AS (SELECT vec_id, list_transform(p, lambda x: greatest(1e-6, least(1 - 1e-6, x))) AS q, p FROM p),
  a AS (SELECT vec_id, list_transform(p, lambda x: pow(greatest(x, 1e-6), 1.4)) AS a, list_transform(q, lambda x: 1 / (1 + exp(-(1.2 * ln(x / (1 - x)) + 0.3)))) AS b,
    list_transform(p, lambda x: 1e-6 + 0.5 * greatest(0, least(x, 0.02)) + 1.0 * greatest(0, least(x, 0.2) - 0.02) + 1.2 * greatest(0, least(x, 0.6) - 0.2) + 0.8 * greatest(0, least(x, 1.0) - 0.6)) AS c FROM c)
  SELECT vec_id, round(a[1] / list_sum(a), 6) AS power, round(b[1] / list_sum(b), 6) AS platt, round(c[1] / list_sum(c), 6) AS piecewise FROM a""")
def calibration_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _probs(spark, sf_dir)
    maps = {"power": maths.power_map(F.col("p"), 1.4), "platt": maths.platt_map(F.col("p"), 1.2, 0.3), "piecewise": maths.piecewise_map(F.col("p"), (0.5, 1.0, 1.2, 0.8))}
    return p.select("vec_id", *(F.round(m[0], 6).alias(k) for k, m in maps.items()))


@query(f"""WITH {P}, w AS (SELECT CAST(i AS INTEGER) AS i, i / 20.0 AS w FROM range(0, 21) AS t(i)),
  l AS (SELECT i, avg(-ln(greatest(1e-9, w * p[label + 1] + (1 - w) * 0.1))) AS loss FROM p CROSS JOIN w GROUP BY i)
  SELECT i, round(loss, 6) AS loss FROM l ORDER BY round(loss, 9), i LIMIT 1""")
def blend_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 21 weights for a blend with equal odds; all weights are scored in one aggregate."""
    own = F.element_at("p", F.col("label") + 1)
    losses = _probs(spark, sf_dir).agg(*(F.avg(maths.log_loss(own * (i / 20) + 0.1 * (1 - i / 20))).alias(f"w{i}") for i in range(21)))
    each = losses.select(F.explode(F.array(*(F.struct(F.round(f"w{i}", 9).alias("r"), F.lit(i).alias("i"), F.col(f"w{i}").alias("loss")) for i in range(21)))).alias("x"))
    best = each.agg(F.min("x").alias("x"))
    return best.select("x.i", F.round("x.loss", 6).alias("loss"))


@query("SELECT l_suppkey, round(sum(l_quantity) ** 2 / sum(l_quantity * l_quantity), 6) AS ess FROM lineitem GROUP BY 1")
def effective_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.pow(F.sum(q), F.lit(2)) / F.sum(q * q), 6).alias("ess"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem)
  SELECT l_suppkey, round(avg(exp(-0.5 * pow((q - 25) / 15, 2))), 6) AS clock,
    round(avg(CASE WHEN q < 5 THEN 0.05 ELSE exp(-0.5 * pow((ln(1 + q) - ln(26)) / 0.5, 2)) END), 6) AS age,
    round(avg(CASE WHEN sqrt(q*q + d*100*d*100) > 20 THEN exp(3 * ((q * 30) / greatest(sqrt(q*q + d*100*d*100) * 30, 1e-9) - 1)) * 1.0 ELSE exp(-30 / 15.0) END), 6) AS heading FROM k GROUP BY 1""")
def kernel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")  # noqa: E741
    age = F.when(q >= 5, q)
    cols = [
        maths.gaussian(q - 25, 15).alias("clock"),
        maths.log_time_kernel(age, F.lit(25.0)).alias("age"),
        maths.heading_kernel(q, F.col("l_discount") * 100, F.lit(30.0), F.lit(0.0)).alias("heading"),
    ]
    k = l.select("l_suppkey", *cols)
    return k.groupBy("l_suppkey").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("clock", "age", "heading")))


@query("""WITH x AS (SELECT l_orderkey % 1000 AS yaw, l_quantity - 25 AS dx, l_discount * 100 - 5 AS dy, l_tax * 100 AS px, l_linenumber AS py, l_suppkey FROM lineitem)
  SELECT l_suppkey, round(avg(abs((degrees(atan2(dy, dx)) - yaw + 180) - 360 * floor((degrees(atan2(dy, dx)) - yaw + 180) / 360) - 180)), 4) AS off,
    round(avg(sqrt(pow(px - greatest(0, least(1, CASE WHEN dx * dx + dy * dy > 0 THEN (px * dx + py * dy) / (dx * dx + dy * dy) ELSE 0 END)) * dx, 2) + pow(py - greatest(0, least(1, CASE WHEN dx * dx + dy * dy > 0 THEN (px * dx + py * dy) / (dx * dx + dy * dy) ELSE 0 END)) * dy, 2))), 4) AS dist FROM x GROUP BY 1""")
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles off a viewing direction and distances to a sight line."""
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", F.pmod("l_orderkey", F.lit(1000)).cast("double").alias("yaw"), (F.col("l_quantity") - 25).alias("dx"), (F.col("l_discount") * 100 - 5).alias("dy"), (F.col("l_tax") * 100).alias("px"), F.col("l_linenumber").cast("double").alias("py"))
    off = maths.off_axis(F.col("yaw"), F.col("dx"), F.col("dy"))
    dist = maths.segment_distance(F.col("px"), F.col("py"), F.lit(0.0), F.lit(0.0), F.col("dx"), F.col("dy"))
    return x.groupBy("l_suppkey").agg(F.round(F.avg(off), 4).alias("off"), F.round(F.avg(dist), 4).alias("dist"))


@query("""WITH b AS (SELECT l_suppkey, least(floor(l_quantity / 10), 4) AS d, least(floor(l_discount * 100 / 4), 2) AS a FROM lineitem)
  SELECT l_suppkey, round(exp(sum(ln(1 - least(0.9, 1 / (1 + exp(-(list_extract([1.0, 0.2, -0.5, -1.5, -3.0], CAST(d + 1 AS INTEGER)) + list_extract([0.5, 0.0, -1.0], CAST(a + 1 AS INTEGER)))))))) / 100), 6) AS unseen FROM b GROUP BY 1""")
def negative_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned spotting probabilities and the (tempered) chance that none of many looks sees anything."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    d, a = F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int"), F.least(F.floor(F.col("l_discount") * 100 / 4), F.lit(2)).cast("int")
    p = F.least(F.lit(0.9), maths.additive_logit([(1.0, 0.2, -0.5, -1.5, -3.0), (0.5, 0.0, -1.0)], [d, a]))
    return l.groupBy("l_suppkey").agg(F.round(F.exp(F.sum(F.log1p(-p)) / 100), 6).alias("unseen"))


def _draws_sql(rows: str, draws: int) -> str:
    """Common table expressions of scoring.cluster_draws: rows has model, cluster and the metrics."""
    return f"""x AS ({rows}), r AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS rank FROM (SELECT DISTINCT cluster FROM x)), n AS (SELECT count(*) AS n FROM r),
  k AS (SELECT draw, ('0x' || md5('0|' || draw || '|' || j)[1:15])::BIGINT % n AS rank, count(*) AS copies FROM n, range({draws}) t(draw), LATERAL (SELECT unnest(range(n)) AS j) GROUP BY ALL)"""


@query(f"""WITH {_draws_sql("SELECT l_returnflag AS model, l_orderkey AS cluster, l_quantity AS v FROM lineitem", 200)},
  s AS (SELECT model, cluster, sum(v) AS s, count(v) AS n FROM x GROUP BY ALL),
  d AS (SELECT model, draw, sum(copies * s.s) / sum(copies * s.n) AS mean FROM s JOIN r USING (cluster) JOIN k USING (rank) GROUP BY ALL),
  m AS (SELECT model, avg(v) AS mean FROM x GROUP BY 1),
  p AS (SELECT * FROM d UNION ALL SELECT 'R - A', a.draw, a.mean - b.mean FROM d a JOIN d b USING (draw) WHERE a.model = 'R' AND b.model = 'A'),
  q AS (SELECT * FROM m UNION ALL SELECT 'R - A', (SELECT mean FROM m WHERE model = 'R') - (SELECT mean FROM m WHERE model = 'A'))
  SELECT model, round(any_value(q.mean), 6) AS mean, round(quantile_cont(p.mean, 0.025), 6) AS lo, round(quantile_cont(p.mean, 0.975), 6) AS hi FROM p JOIN q USING (model) GROUP BY model""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the mean quantity by return flag with orders as clusters, and of a paired difference."""
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity")  # noqa: E741
    r = s.bootstrap(l, "l_returnflag", "l_orderkey", "l_quantity", draws=200, pairs=[("R", "A")])
    return r.select("model", *(F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")))


@query(f"""WITH {_draws_sql("SELECT c_mktsegment AS model, o_custkey AS cluster, o_totalprice AS price, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS urgent FROM orders JOIN customer ON c_custkey = o_custkey", 100)},
  s AS (SELECT model, cluster, metric, sum(v) AS s, count(v) AS n FROM (SELECT model, cluster, 'price' AS metric, price AS v FROM x UNION ALL SELECT model, cluster, 'urgent', urgent FROM x) GROUP BY ALL),
  d AS (SELECT model, metric, draw, sum(copies * s.s) / sum(copies * s.n) AS mean FROM s JOIN r USING (cluster) JOIN k USING (rank) GROUP BY ALL),
  m AS (SELECT model, metric, sum(s) / sum(n) AS mean, sum(n)::BIGINT AS n FROM s GROUP BY ALL),
  e AS (SELECT a.model, a.metric, quantile_cont(a.mean, 0.025) AS lo, quantile_cont(a.mean, 0.975) AS hi, quantile_cont(a.mean - b.mean, 0.025) AS diff_lo, quantile_cont(a.mean - b.mean, 0.975) AS diff_hi
    FROM d a LEFT JOIN d b ON b.draw = a.draw AND b.metric = a.metric AND b.model = 'BUILDING' AND a.model <> 'BUILDING' GROUP BY ALL)
  SELECT m.model, m.metric, m.n, round(m.mean, 4) AS mean, round(lo, 4) AS lo, round(hi, 4) AS hi, round(CASE WHEN m.model <> 'BUILDING' THEN m.mean - b.mean END, 4) AS diff, round(diff_lo, 4) AS diff_lo, round(diff_hi, 4) AS diff_hi
  FROM m JOIN e USING (model, metric) JOIN m b ON b.metric = m.metric AND b.model = 'BUILDING'""")
def paired_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics of every market segment with intervals over customers, and paired differences to one of them."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    x = o.select(F.col("c_mktsegment").alias("model"), F.col("o_custkey").alias("cluster"), F.col("o_totalprice").alias("price"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"))
    r = s.intervals(x, "model", "cluster", ["price", "urgent"], "BUILDING", draws=100)
    return r.select("model", "metric", "n", *(F.round(c, 4).alias(c) for c in ("mean", "lo", "hi", "diff", "diff_lo", "diff_hi")))


@query("""WITH f AS (SELECT o_custkey, (row_number() OVER (ORDER BY md5('0|' || o_custkey), o_custkey) - 1) % 4 AS fold FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL))
  SELECT fold::INTEGER AS fold, count(DISTINCT o_custkey) AS clusters, count(*) AS n FROM orders JOIN f USING (o_custkey) GROUP BY 1""")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole customers dealt to four folds."""
    o = s.folds(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 4)
    return o.groupBy("fold").agg(F.countDistinct("o_custkey").alias("clusters"), F.count("*").alias("n"))
