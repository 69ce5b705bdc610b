"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's mean repetition rate is budget * weight / mass, its mass being the code points of its texts. Every
document draws its count by inverting the Poisson distribution of that mean at a uniform number hashed from the seed
and doc_id: the count is the number of values k with u >= P(X <= k). The document is exploded by the count, and the
copies are dealt and sorted by a hash of seed, doc_id and copy, which shuffles them globally; each copy has a key of
its own, so a hot source or a much repeated document spreads over all partitions.

Defined cases: a null source is a source of its own; a null text is empty; a source without mass has rate 0, as has
one missing from given weights; rows that repeat a doc_id draw the same count; a null doc_id is hashed as an empty
string. Columns of the input with the names of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPER = 0.5
SEED = "mix-1"
#: Rates are broadcast for so many sources at most (a few MB); beyond that the join shuffles.
MOST_BROADCAST = 20_000


def source_rates(documents: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temper: float = TEMPER) -> DataFrame:
    """(source, mass, rate). Without weights, a source's weight is its mass to the power temper; epochs is the budget
    as a multiple of the whole mass."""
    mass = documents.groupBy(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("unnamed")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("mass"))
    if weights is None:
        raw = F.when(F.col("mass") > 0, F.pow(F.col("mass").cast("double"), F.lit(temper))).otherwise(0.0)
    else:
        table = F.create_map(*(F.lit(v) for kv in sorted(weights.items()) for v in kv)) if weights else F.expr("cast(map() as map<string, double>)")
        raw = F.when((F.col("mass") > 0) & ~F.col("unnamed"), F.coalesce(F.element_at(table, F.col("source")).cast("double"), F.lit(0.0))).otherwise(0.0)
    mass = mass.withColumn("raw", F.round(raw, 6))
    total = mass.agg(F.sum("mass").alias("m"), F.sum(F.col("raw").cast("decimal(38,6)")).cast("double").alias("w")).first()
    if not total["w"]:
        return mass.select("source", "unnamed", "mass", F.lit(0.0).alias("rate"))
    rate = F.when(F.col("mass") > 0, F.lit(float(total["m"]) * epochs) * (F.col("raw") / F.lit(total["w"])) / F.col("mass")).otherwise(0.0)
    return mass.select("source", "unnamed", "mass", rate.alias("rate"))


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until all that is left is below any u that can be drawn."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    step = F.log(rate)

    def add(acc: Column, k: Column) -> Column:
        logp = F.when(k == 0, -rate).otherwise(acc["logp"] + step - F.log(k.cast("double")))
        return F.struct(logp.alias("logp"), (acc["sum"] + F.exp(logp)).alias("sum"), F.array_append(acc["out"], acc["sum"] + F.exp(logp)).alias("out"))

    start = F.struct(F.lit(0.0).alias("logp"), F.lit(0.0).alias("sum"), F.expr("cast(array() as array<double>)").alias("out"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, add, lambda acc: acc["out"])).otherwise(F.expr("cast(array() as array<double>)"))


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix_sources(documents: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """The copies of documents: their columns with copy (from 0), n_copies and shuffle_key, in global shuffle order."""
    new = ("copy", "n_copies", "shuffle_key")
    documents = documents.select(*[c for c in documents.columns if c.lower() not in new])
    rates = source_rates(documents, weights, epochs)
    few = rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    table = rates.select(F.col("source").alias("__source"), F.col("unnamed").alias("__unnamed"), poisson_table(F.col("rate")).alias("__cdf"))
    on = (F.coalesce("source", F.lit("")) == F.col("__source")) & (F.col("source").isNull() == F.col("__unnamed"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    u = hashed_uniform(F.lit(seed), doc)
    drawn = documents.join(F.broadcast(table) if few else table, on).withColumn("__u", u)
    drawn = drawn.withColumn("n_copies", F.size(F.filter("__cdf", lambda c: F.col("__u") >= c)).cast("int")).where("n_copies > 0")
    copies = drawn.select(*documents.columns, "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.substring(F.md5(F.concat_ws("|", F.lit(seed), doc, F.col("copy")).cast("binary")), 1, 16))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(source, '') AS s FROM documents),
m AS (SELECT s, sum(length(text)) AS mass FROM d GROUP BY s),
w AS (SELECT s, mass, CASE WHEN mass > 0 THEN round(pow(CAST(mass AS DOUBLE), {TEMPER}), 6) ELSE 0 END AS raw FROM m),
r AS (SELECT s, CASE WHEN mass > 0 THEN CAST((SELECT sum(mass) FROM w) AS DOUBLE) * (raw / (SELECT CAST(sum(CAST(raw AS DECIMAL(38,6))) AS DOUBLE) FROM w)) / mass ELSE 0 END AS rate FROM w),
k AS (SELECT s, i, sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) OVER (PARTITION BY s ORDER BY i) AS cdf
      FROM r, range(0, 400) AS t(i) WHERE rate > 0),
u AS (SELECT doc_id, source, text, s, (CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM d),
n AS (SELECT doc_id, source, text, (SELECT count(*) FROM k WHERE k.s = u.s AND u.u >= k.cdf) AS n_copies FROM u)
SELECT doc_id, source, CAST(c AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies,
       substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || c), 1, 16) AS shuffle_key, md5(text) AS text_md5
FROM n, range(0, 100000) AS t(c) WHERE c < n_copies
"""
