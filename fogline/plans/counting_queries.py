"""Counting, priors, graph and region queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counting as c
from ..operators import graph as g
from ..operators import temporal as t
from ..session import table
from .common import DAY, E, sightings
from .registry import query

#: Moves between cells of a user within ten days, cells in tens (0-9), with the hour of the day as context.
M = f"""{E}, m AS (SELECT user_id, cell // 10 AS cell, lead(cell) OVER w // 10 AS next_cell, lead(us) OVER w - us AS gap, us // {DAY // 4} % 4 AS phase
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), n AS (SELECT * FROM m WHERE gap <= {10 * DAY})"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = t.moves(sightings(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", "cell", most=10 * DAY)
    phase = F.pmod(F.floor(F.col("us") / (DAY // 4)), F.lit(4))
    return moved.select("user_id", F.floor(F.col("cell") / 10).alias("cell"), F.floor(F.col("next_cell") / 10).alias("next_cell"), phase.alias("phase"))


@query(f"WITH {M} SELECT cell, next_cell, phase, count(*) AS n FROM n GROUP BY ALL HAVING count(*) >= 2")
def markov_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.transitions(_moves(spark, sf_dir), ["phase"], "cell", "next_cell", 2)


@query(f"""WITH {M}, a AS (SELECT cell, next_cell, count(*) AS n FROM n GROUP BY ALL), pa AS (SELECT cell, next_cell, n / sum(n) OVER (PARTITION BY cell) AS prior FROM a),
  k AS (SELECT phase, cell, next_cell, count(*) AS n FROM n GROUP BY ALL), r AS (SELECT DISTINCT phase, cell FROM k),
  b AS (SELECT r.phase, r.cell, pa.next_cell, coalesce(k.n, 0) + 4 * pa.prior AS mass FROM r JOIN pa USING (cell) LEFT JOIN k ON k.phase = r.phase AND k.cell = r.cell AND k.next_cell = pa.next_cell)
  SELECT phase, cell, next_cell, round(mass / sum(mass) OVER (PARTITION BY phase, cell), 6) AS p FROM b""")
def markov_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains by phase, drawn to the chain of all phases with the weight of four moves."""
    m = _moves(spark, sf_dir)
    parent = c.row_share(c.transitions(m, [], "cell", "next_cell"), ["cell"], "n")
    return c.shrunk(c.transitions(m, ["phase"], "cell", "next_cell"), parent, ["phase"], "cell", "next_cell", 4.0).withColumn("p", F.round("p", 6))


@query(f"""WITH {M}, k AS (SELECT phase, cell, count(*) AS n FROM n GROUP BY ALL), d AS (SELECT phase, cell FROM (SELECT DISTINCT phase FROM k), (SELECT DISTINCT cell FROM k))
  SELECT phase, cell, coalesce(n, 0) AS n, round((coalesce(n, 0) + 0.01) / sum(coalesce(n, 0) + 0.01) OVER (PARTITION BY phase), 6) AS p FROM d LEFT JOIN k USING (phase, cell)""")
def occupancy_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _moves(spark, sf_dir).groupBy("phase", "cell").agg(F.count("*").alias("n"))
    return c.smoothed_share(k, k, ["phase"], "cell", 0.01).withColumn("p", F.round("p", 6))


@query(f"""WITH {M}, ed AS (SELECT DISTINCT cell, next_cell FROM n WHERE cell <> next_cell), dg AS (SELECT cell, count(*) AS degree FROM ed GROUP BY 1),
  st AS (SELECT cell, avg((cell = next_cell)::INT) AS stay FROM n GROUP BY 1)
  SELECT cell, next_cell, round((1 - stay) / degree, 6) AS p FROM ed JOIN dg USING (cell) JOIN st USING (cell) UNION ALL SELECT cell, cell, round(stay, 6) FROM st""")
def random_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moves(spark, sf_dir)
    edges = m.where("cell <> next_cell").select("cell", "next_cell").distinct()
    stays = m.groupBy("cell").agg(F.avg((F.col("cell") == F.col("next_cell")).cast("int")).alias("stay"))
    return c.random_walk(edges, stays, "cell", "next_cell").withColumn("p", F.round("p", 6))


@query(f"""WITH {E}, f AS (SELECT user_id, arg_min(cell // 10, us) AS cell FROM e GROUP BY 1) SELECT cell, count(*) AS n FROM f GROUP BY 1""")
def spawn_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = sightings(spark, sf_dir).groupBy("user_id").agg(F.min_by("cell", "us").alias("cell"))
    return first.groupBy(F.floor(F.col("cell") / 10).alias("cell")).agg(F.count("*").alias("n"))


@query(f"""WITH {E}, k AS (SELECT cell, event_type, count(*) AS n FROM e GROUP BY ALL)
  SELECT cell, event_type AS label FROM k QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, event_type) = 1""")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.majority(sightings(spark, sf_dir).select("cell", F.col("event_type").alias("label")), "cell", "label")


@query("SELECT o_orderpriority AS priority, round(quantile_cont(o_totalprice, 0.1), 6) AS p10 FROM orders GROUP BY 1")
def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.percentile("o_totalprice", F.lit(0.1)), 6).alias("p10"))


@query("""WITH s AS (SELECT o_custkey, o_totalprice AS z, coalesce(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 0) > 20000 AS cut FROM orders),
  p AS (SELECT o_custkey, z, sum(cut::INT) OVER (PARTITION BY o_custkey ORDER BY z ROWS UNBOUNDED PRECEDING) AS part FROM s),
  f AS (SELECT o_custkey, part, count(*) AS n, quantile_cont(z, 0.1) AS height FROM p GROUP BY ALL HAVING count(*) >= 3),
  r AS (SELECT o_custkey, n, round(height, 6) AS height, row_number() OVER (PARTITION BY o_custkey ORDER BY height) - 1 AS floor FROM f)
  SELECT o_custkey, n, height, floor FROM r WHERE floor < 3""")
def gap_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-dimensional clusters of a customer's prices, as floors are found from heights."""
    found = c.floors(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 20_000, 3)
    return found.select("o_custkey", "n", F.round("height", 6).alias("height"), "floor")


@query("""SELECT CAST(least(floor(l_quantity / 10), 4) AS INTEGER) AS q, CAST(least(floor(l_extendedprice / 10000), 5) AS INTEGER) AS x, count(*) AS n, CAST(sum((l_returnflag = 'R')::INT) AS BIGINT) AS k FROM lineitem GROUP BY ALL""")
def binomial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("q"), F.least(F.floor(F.col("l_extendedprice") / 10000), F.lit(5)).cast("int").alias("x"))  # noqa: E741
    return c.binomial_cells(l, ["q", "x"], F.col("l_returnflag") == "R")


@query("""WITH k AS (SELECT s_nationkey AS a, c_nationkey AS b, sum((l_returnflag = 'R')::INT) AS k, count(*) * 0.5 AS e FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
  m AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(k) AS k, sum(e) AS e FROM k GROUP BY ALL),
  f AS (SELECT a, b, greatest(0.02, least(50.0, (k * CASE WHEN a = b THEN 2 ELSE 1 END + 3) / (e * CASE WHEN a = b THEN 2 ELSE 1 END + 3))) AS factor FROM m)
  SELECT a, b, round(factor, 6) AS factor FROM f UNION ALL SELECT b, a, round(factor, 6) FROM f WHERE a <> b""")
def pair_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")  # noqa: E741
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    cu = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b"))
    counts = l.join(s, "l_suppkey").join(o, "l_orderkey").join(cu, "c_custkey").groupBy("a", "b").agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("k"), (F.count("*") * 0.5).alias("e"))
    return c.pair_factors(counts, "a", "b").withColumn("factor", F.round("factor", 6))


@query("""WITH k AS (SELECT l_returnflag, l_linestatus, o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
  a AS (SELECT l_returnflag, l_linestatus, sum(n) AS n FROM k GROUP BY ALL), p AS (SELECT l_returnflag, l_linestatus, n / sum(n) OVER (PARTITION BY l_returnflag) AS average FROM a),
  d AS (SELECT o_orderpriority, l_returnflag FROM (SELECT DISTINCT o_orderpriority, l_returnflag FROM k))
  SELECT d.o_orderpriority AS context, p.l_returnflag AS last, p.l_linestatus AS now,
         round((coalesce(k.n, 0) + 5 * average) / sum(coalesce(k.n, 0) + 5 * average) OVER (PARTITION BY d.o_orderpriority, d.l_returnflag), 6) AS p
  FROM d JOIN p USING (l_returnflag) LEFT JOIN k ON k.l_returnflag = p.l_returnflag AND k.l_linestatus = p.l_linestatus AND k.o_orderpriority = d.o_orderpriority""")
def contingency_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of an outcome by context, shrunk to the average context with the weight of five rows."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("last"), F.col("l_linestatus").alias("now"))  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("context"))
    joined = l.join(o, "l_orderkey")
    k = c.transitions(joined, ["context"], "last", "now")
    average = c.row_share(k.groupBy("last", "now").agg(F.sum("n").alias("n")), ["last"], "n")
    return c.shrunk(k, average, ["context"], "last", "now", 5.0).withColumn("p", F.round("p", 6))


@query("""WITH k AS (SELECT l_returnflag AS class, l_linestatus AS gun, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT class, gun FROM (SELECT DISTINCT class FROM k), (SELECT DISTINCT gun FROM k))
  SELECT class, gun, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY class), 6) AS p FROM d LEFT JOIN k USING (class, gun)""")
def add_one_guns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("class"), F.col("l_linestatus").alias("gun")).agg(F.count("*").alias("n"))
    return c.smoothed_share(k, k, ["class"], "gun", 1.0).withColumn("p", F.round("p", 6))


@query("""SELECT CAST(least(floor(l_quantity / 5), 9) AS INTEGER) AS bin, round(sum(l_extendedprice), 4) AS mass, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1""")
def weighted_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.least(F.floor(F.col("l_quantity") / 5), F.lit(9)).cast("int").alias("bin")).agg(F.round(F.sum("l_extendedprice"), 4).alias("mass"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice"), 6).alias("mean"))


@query("""WITH b AS (SELECT l_suppkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1)
  SELECT l_suppkey, lo, hi, (SELECT min(l_quantity) FROM lineitem l WHERE l.l_suppkey = b.l_suppkey AND l.l_quantity > b.lo + 11) AS hi_floor FROM b""")
def scatter_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.bands(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", 11)


#: Undirected graph of cells: steps of at most three apart seen twice or more.
G = f"""{E}, mv AS (SELECT cell, lead(cell) OVER w AS nxt, lead(us) OVER w - us AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  d AS (SELECT cell AS src, nxt AS dst FROM mv WHERE gap <= {20 * DAY} AND abs(cell - nxt) <= 3 GROUP BY ALL HAVING count(*) >= 2),
  g AS (SELECT src, dst FROM d WHERE src <> dst UNION SELECT dst, src FROM d WHERE src <> dst)"""


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = t.moves(sightings(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", "cell", most=20 * DAY).where("abs(cell - next_cell) <= 3")
    return g.symmetric(c.transitions(moved, [], "cell", "next_cell", 2).select(F.col("cell").alias("src"), F.col("next_cell").alias("dst")))


@query(f"WITH {G} SELECT src, dst FROM g")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)


@query("""WITH n AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS x, CAST(round(l_discount * 100) AS BIGINT) AS y, CAST(l_linenumber AS BIGINT) AS z FROM lineitem)
  SELECT a.x * 10000 + a.y * 10 + a.z AS src, b.x * 10000 + b.y * 10 + b.z AS dst FROM n a JOIN n b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) AND abs(a.z - b.z) <= 1""")
def offset_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (quantity, discount) with a height (line number) and their neighbours in the 8 columns around."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    n = l.select(F.col("l_quantity").cast("long").alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y"), F.col("l_linenumber").cast("long").alias("z")).distinct()
    n = n.withColumn("cell", F.col("x") * 10_000 + F.col("y") * 10 + F.col("z"))
    return g.offset_neighbours(n, "x", "y", "z", "cell", 1)


@query(f"""WITH RECURSIVE {G}, r AS (SELECT src AS a, src AS b FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON r.b = g.src),
  k AS (SELECT a AS node, min(b) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS n FROM k GROUP BY 1)
  SELECT node FROM k WHERE component = (SELECT component FROM s ORDER BY n DESC, component LIMIT 1)""")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.largest_component(_graph(spark, sf_dir))


@query(f"""WITH {G}, n AS (SELECT DISTINCT src AS node FROM g), i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM n)
  SELECT a.i AS src, b.i AS dst FROM g JOIN i a ON a.node = g.src JOIN i b ON b.node = g.dst""")
def reindexed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)
    return g.reindexed(edges.select(F.col("src").alias("node")).distinct(), edges)[1]


@query(f"""WITH RECURSIVE {G}, r AS (SELECT DISTINCT src, src AS dst, 0 AS hop FROM g UNION SELECT r.src, g.dst, hop + 1 FROM r JOIN g ON r.dst = g.src WHERE hop < 3)
  SELECT src, dst, min(hop) AS hop FROM r GROUP BY ALL""")
def hops3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.hops(_graph(spark, sf_dir), 3)


@query(f"""WITH {G}, b AS (SELECT cell AS node, count(*) / (SELECT count(*) FROM e) AS b FROM e GROUP BY 1), dg AS (SELECT src, count(*) AS degree FROM g GROUP BY 1),
  s AS (SELECT src, dst, 1 / degree AS p FROM g JOIN dg USING (src)), r1 AS (SELECT dst AS node, sum(b * p) AS b FROM b JOIN s ON src = node GROUP BY 1),
  r2 AS (SELECT dst AS node, sum(b * p) AS b FROM r1 JOIN s ON src = node GROUP BY 1)
  SELECT node, round(sum(b), 6) AS b FROM (SELECT node, 0.4 * b AS b FROM b UNION ALL SELECT node, 0.4 * b FROM r1 UNION ALL SELECT node, 0.2 * b FROM r2) GROUP BY 1""")
def smooth_two_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sightings(spark, sf_dir)
    n = e.count()
    b = e.groupBy(F.col("cell").alias("node")).agg((F.count("*") / n).alias("b"))
    return g.smooth_two_rings(b, _graph(spark, sf_dir)).withColumn("b", F.round("b", 6))


@query(f"""WITH {G}, r AS (SELECT DISTINCT src AS node, 'R' || (src // 20) AS region FROM g)
  SELECT a.region AS a, b.region AS b, count(*) AS n FROM g JOIN r a ON a.node = g.src JOIN r b ON b.node = g.dst WHERE a.region <> b.region GROUP BY ALL HAVING count(*) >= 3""")
def region_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)
    regions = edges.select(F.col("src").alias("node"), F.concat(F.lit("R"), F.floor(F.col("src") / 20)).alias("region")).distinct()
    return g.region_edges(edges, regions)


APSP = f"""WITH RECURSIVE {G}, w AS (SELECT src, dst, abs(src - dst) AS length FROM g),
  r AS (SELECT DISTINCT src, src AS dst, 0 AS hop, 0 AS d FROM g UNION SELECT src, dst, hop + 1, min(d) FROM (SELECT r.src, w.dst, r.hop, r.d + w.length AS d FROM r JOIN w ON r.dst = w.src WHERE hop < 100) GROUP BY src, dst, hop),
  b AS (SELECT src, dst, min(d) AS d FROM r GROUP BY ALL), n AS (SELECT DISTINCT src AS node FROM g)"""


@query(APSP + " SELECT x.node AS src, y.node AS dst, CAST(coalesce(d, 100000) AS DOUBLE) AS distance FROM n x CROSS JOIN n y LEFT JOIN b ON b.src = x.node AND b.dst = y.node")
def apsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.shortest_paths(_graph(spark, sf_dir).withColumn("length", F.abs(F.col("src") - F.col("dst"))))


@query(APSP + """, tr AS (SELECT cell AS node, 'R' || (cell // 20) AS region, count(*) AS n FROM e WHERE cell IN (SELECT node FROM n) GROUP BY ALL),
  bs AS (SELECT region AS a, node AS src FROM tr QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, node) = 1)
  SELECT a, t.region AS b, round(min(coalesce(d, 100000)) / 250.0, 6) AS seconds FROM bs CROSS JOIN tr t LEFT JOIN b ON b.src = bs.src AND b.dst = t.node GROUP BY a, t.region""")
def region_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("cell")).distinct()
    traffic = sightings(spark, sf_dir).join(nodes, "cell", "left_semi").groupBy(F.col("cell").alias("node"), F.concat(F.lit("R"), F.floor(F.col("cell") / 20)).alias("region")).agg(F.count("*").alias("n"))
    distances = g.shortest_paths(edges.withColumn("length", F.abs(F.col("src") - F.col("dst"))))
    return g.travel_times(distances, traffic).withColumn("seconds", F.round("seconds", 6))
