"""Team factors from recorded line-ups as joins: every request meets the line-ups near its clock, and these the ways to
give the hidden entities different players of them.

A line-up counts by clock, buy and surplus players, and by how well its places fit the independent beliefs; see
corrections.team_ratio for the same in arrays. Equal line-ups of a request are summed before anything is multiplied out,
the ways come from a table function over the few pairs of numbers that occur, and all that is summed by request is
summed in part before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .belief import LineUps
from .corrections import LEAST, SLOTS


@F.udtf(returnType="way int, slots array<int>")
class Pairings:
    """All ways to give k entities different ones of n slots, in order; 120 at most."""

    def eval(self, n: int, k: int) -> Iterator[tuple]:
        if n is not None and k is not None and 0 < k <= n <= SLOTS:
            yield from enumerate(map(list, permutations(range(n), k)))


def ways(kinds: DataFrame) -> DataFrame:
    """(alive, k, way, slots) for the pairs (alive, k) of kinds: 325 rows at most."""
    return kinds.select("alive", "k").distinct().lateralJoin(Pairings(F.col("alive").outer(), F.col("k").outer()))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def near_line_ups(requests: DataFrame, recorded: DataFrame, keys: Sequence[str], options: LineUps) -> DataFrame:
    """(keys, k, places, alive, a, b): the line-ups near each request's clock with sums of their weights (a) and of the
    squares (b) by how often they were recorded."""
    near, width = 1.5 * options.sigma, 1.5 * options.sigma
    bucket = lambda c: F.floor(c / width)
    q = requests.select(*keys, F.col("clock").alias("__clock"), F.size("p").alias("k"), *((F.col("buy").alias("__shares"),) if "buy" in requests.columns else ()))
    q = q.where(F.col("k").between(1, SLOTS)).withColumn("__bucket", F.explode(F.array(*(bucket(F.col("__clock")) + d for d in (-1, 0, 1)))))
    r = recorded.select("clock", "places", F.size("places").alias("alive"), "buy", "n", bucket(F.col("clock")).alias("__bucket"))
    met = q.join(r, "__bucket").where((F.abs(F.col("clock") - F.col("__clock")) <= near) & (F.col("alive") >= F.col("k")))
    suits = F.pow(F.lit(options.surplus), F.col("alive") - F.col("k")) * F.exp(-0.5 * F.pow((F.col("clock") - F.col("__clock")) / options.sigma, F.lit(2)))
    if "buy" in requests.columns:
        own = F.transform("__shares", lambda share, kind: share * F.pow(F.lit(options.buy_step), F.abs(F.col("buy") - kind)))
        suits = suits * F.when(F.col("__shares").isNull(), 1.0).otherwise(_total(own))
    return met.withColumn("s", suits).groupBy(*keys, "k", "places", "alive").agg(F.sum(F.col("s") * F.col("n")).alias("a"), F.sum(F.col("s") * F.col("s") * F.col("n")).alias("b"))


def lifted(near: DataFrame, requests: DataFrame, keys: Sequence[str], regions: int, power: float) -> DataFrame:
    """(keys, usual, lift): how usual each region is among a request's line-ups, and how much more each belief holds of it."""
    at = near.select(*keys, "a", F.explode("places").alias("region")).groupBy(*keys, "region").agg(F.sum("a").alias("m"))
    found = at.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("region", "m"))).alias("m"), F.sum("m").alias("all"))  # as many as regions
    usual = F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda r: F.greatest(F.coalesce(F.element_at("m", r), F.lit(0.0)) / F.greatest("all", F.lit(1e-300)), F.lit(LEAST)))
    q = requests.select(*keys, "p").join(found.select(*keys, usual.alias("usual")), list(keys))

    def one(p: Column) -> Column:
        raw = F.zip_with(p, F.col("usual"), lambda x, u: F.pow(F.greatest(x, F.lit(LEAST)) / u, F.lit(power)))
        total = _total(F.zip_with(raw, F.col("usual"), lambda x, u: x * u))
        return F.transform(raw, lambda x: x / total)

    return q.select(*keys, "usual", F.transform("p", one).alias("lift"))


def team_factors(requests: DataFrame, recorded: DataFrame, keys: Sequence[str], regions: int, options: LineUps | None = None) -> DataFrame:
    """(keys, entity, region, factor): by how much recorded line-ups near the clock change independent beliefs.

    requests: keys, clock, p (an array of region probabilities for each living entity) and, if buys count, buy (three
    shares or null); recorded: clock, places (regions of the living, SLOTS at most), buy, n (how often). Requests that no
    line-up fits have no row. All line-ups near the clock count, however many.
    """
    options, keys = options or LineUps(), list(keys)
    near = near_line_ups(requests, recorded, keys, options)
    lifts = lifted(near, requests, keys, regions, options.power)
    pairs = near.join(lifts.select(*keys, "lift"), keys).join(F.broadcast(ways(near)), ["alive", "k"])  # ways: 325 rows at most
    of = F.transform("slots", lambda j, e: F.get(F.get(F.col("lift"), e), F.get(F.col("places"), j)))
    fit = pairs.withColumn("fit", F.aggregate(of, F.lit(1.0), lambda acc, x: acc * x))
    up = [*keys, "k", "places", "alive"]
    if options.single:
        best = F.max_by(F.struct("slots", "fit"), F.struct("fit", -F.col("way")))
        fit = fit.groupBy(*up, "a", "b").agg(best.alias("x")).select(*up, "a", "b", "x.slots", "x.fit", F.lit(1.0).alias("scale"))
    else:
        fit = fit.withColumn("scale", F.element_at(F.array(*(F.lit(1.0 / n) for n in _counts())), (F.col("alive") * (SLOTS + 1) + F.col("k") + 1).cast("int")))
    whole = fit.groupBy(*up, "a", "b").agg((F.sum("fit") * F.first("scale")).alias("w"))
    sums = whole.groupBy(*keys).agg(F.sum(F.col("a") * F.col("w")).alias("total"), F.sum(F.col("b") * F.col("w") * F.col("w")).alias("squares"))
    each = fit.select(*keys, (F.col("a") * F.col("fit") * F.col("scale")).alias("m"), "places", F.posexplode("slots").alias("entity", "slot"))
    met = each.groupBy(*keys, "entity", F.get(F.col("places"), F.col("slot")).alias("region")).agg(F.sum("m").alias("m"))
    size = F.col("total") * F.col("total") / F.greatest("squares", F.lit(1e-300))
    dense = lifts.join(sums.where("total > 0"), keys).select(*keys, "usual", "total", size.alias("size"), F.posexplode("lift").alias("entity", "l"))
    dense = dense.select(*keys, "entity", "total", "size", F.posexplode(F.zip_with("l", "usual", lambda x, u: x * u)).alias("region", "expected"))
    both = dense.join(met, [*keys, "entity", "region"], "left")
    corrected = (F.col("size") * F.coalesce("m", F.lit(0.0)) / F.col("total") + options.pseudo * F.col("expected")) / (F.col("size") + options.pseudo)
    return both.select(*keys, "entity", "region", (corrected / F.greatest("expected", F.lit(1e-12))).alias("factor"))


def _counts() -> list[int]:
    """How many ways there are to give k entities different ones of n slots, at n * (SLOTS + 1) + k; 1 where there is none."""
    out = []
    for n in range(SLOTS + 1):
        for k in range(SLOTS + 1):
            many = 1
            for i in range(k):
                many *= max(n - i, 1)
            out.append(many)
    return out
