"""Scores of probability tables: metrics by slices, reliability, calibration of counts, cluster bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins, maths
from ..session import stored
from . import sampling

#: Picks that a task makes at a time, and those of a block of clusters over all draws.
STRETCH, MOST_PICKS = 1 << 20, 1 << 22


def summary(samples: DataFrame, slices: Sequence[Sequence[str]], rank: str = "rank", p_true: str = "p_true") -> DataFrame:
    """n, top-1, top-3 and log-loss by several slices in one pass (grouping sets); columns of other slices are null."""
    keys = list(dict.fromkeys(k for s in slices for k in s))
    metrics = [
        F.count("*").alias("n"),
        F.avg((F.col(rank) < 1).cast("double")).alias("top1"),
        F.avg((F.col(rank) < 3).cast("double")).alias("top3"),
        F.avg(maths.log_loss(F.col(p_true))).alias("log_loss"),
    ]
    return samples.groupingSets([[F.col(k) for k in s] for s in slices], *(F.col(k) for k in keys)).agg(F.grouping_id(*keys).alias("slice"), *metrics)


def reliability(probs: DataFrame, p: str, truth: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """By bin of every stated probability: how many, mean stated, how often true."""
    each = probs.select(*by, truth, F.posexplode(p).alias("__i", "__p"))
    binned = each.select(*by, bins.unit_bin(F.col("__p"), edges).alias("bin"), "__p", (F.col("__i") == F.col(truth)).cast("double").alias("__hit"))
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("__p").alias("said"), F.avg("__hit").alias("there"))


def calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum over bins of their share times |said - there|."""
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("said") - F.col("there"))) / F.sum("n")).alias("ece"))


def count_brier(expected: Column, actual: Column) -> Column:
    """Sum of squared differences of expected and actual counts, place by place."""
    return F.aggregate(F.zip_with(expected, actual, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)


def count_calibration(df: DataFrame, expected: str, actual: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    binned = df.groupBy(*by, bins.unit_bin(F.col(expected), edges).alias("bin")).agg(F.count("*").alias("n"), F.sum(expected).alias("e"), F.sum(actual).alias("a"))
    return binned.select(*by, "bin", "n", (F.col("e") / F.col("n")).alias("expected"), (F.col("a") / F.col("n")).alias("actual"))


def highest_density(df: DataFrame, keys: Sequence[str], mass: str, share: float, tie: str) -> DataFrame:
    """The fewest rows by keys that hold `share` of the mass, and all rows as heavy as the lightest of them."""
    w = Window.partitionBy(*keys).orderBy(F.col(mass).desc(), tie)
    total = F.sum(mass).over(Window.partitionBy(*keys))
    before = F.coalesce(F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    needed = df.withColumn("__in", before < share * total)
    lightest = F.min(F.when(F.col("__in"), F.col(mass))).over(Window.partitionBy(*keys))
    return needed.withColumn("__least", lightest).where(F.col(mass) >= F.col("__least")).drop("__in", "__least")


def cluster_draws(samples: DataFrame, cluster: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, cluster, copies): for every draw as many clusters as there are, taken with replacement. The j-th pick of a
    draw is the cluster whose place in order is an MD5 of (seed, draw, j) modulo their number, so all models, metrics and
    engines see the same draws. Copies are counted where they are made, and nothing is collected but the number."""
    ranks = stored(sampling.dense_ranks(samples.where(F.col(cluster).isNotNull()), cluster), "ranks")
    n = ranks.select("total").first()
    if n is None:
        return ranks.select(F.lit(0).alias("draw"), cluster, F.lit(0).cast("long").alias("copies")).limit(0)
    n = n["total"]
    picks = samples.sparkSession.range(draws * n).select(F.expr(f"cast(id div {n} as int)").alias("draw"), F.expr(f"id % {n}").alias("j"))
    rank = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", "j").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(n))
    copies = picks.groupBy("draw", rank.alias("rank")).agg(F.count("*").alias("copies"))
    return copies.join(ranks.select("rank", cluster), "rank").select("draw", cluster, "copies")


def resampled_means(samples: DataFrame, model: str, cluster: str, metrics: Sequence[str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """(model, metric, draw, mean): means of metrics over the clusters of cluster_draws, by model. A draw that misses all
    clusters of a model has no row.

    The picks never become rows: a task makes those of a stretch of a draw, sorts them, and sends them on as arrays of two
    bytes a pick by block of clusters. A block's picks and sums meet in one group, which holds MOST_PICKS picks or so."""
    metrics = list(metrics)
    ranks = stored(sampling.dense_ranks(samples.where(F.col(cluster).isNotNull()), cluster), "ranks")
    first = ranks.select("total").first()
    n = 0 if first is None else first["total"]
    size = max(1, min(1 << 16, MOST_PICKS // draws))
    sums = samples.groupBy(F.col(model).cast("string").alias("model"), cluster).agg(*(f for i, m in enumerate(metrics) for f in (F.sum(F.col(m).cast("double")).alias(f"s{i}"), F.count(m).cast("double").alias(f"n{i}"))))
    values = [f"{part}{i}" for i in range(len(metrics)) for part in "sn"]
    placed = sums.join(ranks.select(cluster, "rank"), cluster).select("model", F.expr(f"rank div {size}").alias("of_block"), F.expr(f"cast(rank % {size} as int)").alias("at"), *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))
    a_draw = -(-n // STRETCH)

    def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch in batch.column(0).to_pylist():
                draw, at = divmod(stretch, a_draw)
                rank = np.sort(sampling.hashed(f"{seed}|{draw}|".encode(), at * STRETCH, min(STRETCH, n - at * STRETCH)) % n)
                block = np.arange(rank[0] // size, rank[-1] // size + 1)
                ends = np.searchsorted(rank, np.append(block, block[-1] + 1) * size)
                raw = (rank % size).astype("<u2").tobytes()
                sent = [raw[2 * i : 2 * j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.full(len(block), draw, np.int32)), pa.array(sent, pa.binary())], names=["block", "draw", "picks"])

    def summed(drawn: pa.Table, held: pa.Table) -> pa.Table:
        copies = np.zeros((draws, size))
        for draw, raw in zip(drawn["draw"].to_pylist(), drawn["picks"], strict=True):
            copies[draw] += np.bincount(np.frombuffer(raw.as_buffer(), "<u2"), minlength=size)
        names, of = np.unique(np.array(["" if x is None else "x" + x for x in held["model"].to_pylist()]), return_inverse=True)
        at, each = held["at"].to_numpy(), np.stack([held[v].to_numpy() for v in values], 1) if len(held) else np.zeros((0, len(values)))
        out = []
        for i, name in enumerate(names):
            own, its = at[of == i], each[of == i]
            table = np.zeros((size, len(values) + 1))
            table[own, :-1], table[own, -1] = np.where(np.isfinite(its), its, 0.0), 1.0
            total = copies @ table
            for k in np.flatnonzero(~np.isfinite(its).all(1)):  # counts only in the draws that took it
                taken = copies[:, own[k], None]
                total[:, :-1] += np.where(taken > 0, taken * np.where(np.isfinite(its[k]), 0.0, its[k]), 0.0)
            met = np.flatnonzero(total[:, -1] > 0)
            out.append(pa.table([pa.array([name[1:] if name else None] * len(met), pa.string()), pa.array(met.astype(np.int32)), *(pa.array(c) for c in total[met, :-1].T)], names=["model", "draw", *values]))
        blank = pa.table([pa.array([], t) for t in (pa.string(), pa.int32(), *[pa.float64()] * len(values))], names=["model", "draw", *values])
        return pa.concat_tables([blank, *out])

    stretches = samples.sparkSession.range(0, draws * a_draw, 1, max(1, min(draws * a_draw, 2_000)))
    drawn = stretches.mapInArrow(picks, "block long, draw int, picks binary")
    parts = drawn.groupBy("block").cogroup(placed.groupBy("of_block")).applyInArrow(summed, ", ".join(["model string", "draw int", *(f"{v} double" for v in values)]))
    each = parts.groupBy("model", "draw").agg(*(F.sum(v).alias(v) for v in values))
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.try_divide(F.col(f"s{i}"), F.col(f"n{i}")).alias("mean")) for i, m in enumerate(metrics))))
    return each.select("model", "draw", long.alias("x")).select("model", "x.metric", "draw", "x.mean")


def _ends(values: DataFrame, *keys: str) -> DataFrame:
    """95 % intervals; a group holds one number a draw."""
    return values.groupBy(*keys).agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))


def bootstrap(samples: DataFrame, model: str, cluster: str, value: str, draws: int = 2000, seed: int = 0, pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(model, mean, lo, hi): 95 % intervals of a mean by resampling clusters; for pairs (a, b) the difference a - b on
    the same draws, as model 'a - b'."""
    drawn = stored(resampled_means(samples, model, cluster, [value], draws, seed), "draws")
    means = samples.groupBy(F.col(model).cast("string").alias("model")).agg(F.avg(value).alias("mean"))
    for a, b in pairs:
        x, y = drawn.where(F.col("model") == a), drawn.where(F.col("model") == b)
        both = x.select("metric", "draw", F.col("mean").alias("x")).join(y.select("draw", F.col("mean").alias("y")), "draw")
        drawn = drawn.unionByName(both.select(F.lit(f"{a} - {b}").alias("model"), "metric", "draw", (F.col("x") - F.col("y")).alias("mean")))
        one = means.groupBy().agg(F.sum(F.when(F.col("model") == a, F.col("mean"))).alias("x"), F.sum(F.when(F.col("model") == b, F.col("mean"))).alias("y"))
        means = means.unionByName(one.select(F.lit(f"{a} - {b}").alias("model"), (F.col("x") - F.col("y")).alias("mean")))
    return means.join(_ends(drawn, "model"), "model")


def intervals(samples: DataFrame, model: str, cluster: str, metrics: Sequence[str], reference: str | None = None, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(model, metric, n, mean, lo, hi, diff, diff_lo, diff_hi): every metric of every model with its interval, and its
    paired difference to a reference model on the same draws (null for the reference, or without one)."""
    drawn = stored(resampled_means(samples, model, cluster, metrics, draws, seed), "draws")
    means = samples.groupBy(F.col(model).cast("string").alias("model")).agg(F.count("*").alias("n"), *(F.avg(m).alias(f"__{i}") for i, m in enumerate(metrics)))
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"__{i}").alias("mean")) for i, m in enumerate(metrics))))
    means = means.select("model", "n", long.alias("x")).select("model", "n", "x.*")
    out = means.join(_ends(drawn, "model", "metric"), ["model", "metric"])
    if reference is None:
        return out.select("*", *(F.lit(None).cast("double").alias(c) for c in ("diff", "diff_lo", "diff_hi")))
    of = lambda df, name: df.where(F.col("model") == reference).select("metric", *(c for c in ("draw",) if c in df.columns), F.col("mean").alias(name))
    paired = drawn.where(F.col("model") != reference).join(of(drawn, "r"), ["metric", "draw"]).withColumn("mean", F.col("mean") - F.col("r"))
    ends = _ends(paired, "model", "metric").withColumnsRenamed({"lo": "diff_lo", "hi": "diff_hi"})
    diff = F.when(F.col("model") != reference, F.col("mean") - F.col("r")).alias("diff")
    return out.join(of(means, "r"), "metric").join(ends, ["model", "metric"], "left").select("model", "metric", "n", "mean", "lo", "hi", diff, "diff_lo", "diff_hi")


def folds(df: DataFrame, cluster: str, k: int, seed: int = 0) -> DataFrame:
    """df with fold: whole clusters are dealt to k folds of equal numbers of clusters but for one, in an order hashed with the
    seed."""
    each = df.select(cluster).where(F.col(cluster).isNotNull()).distinct().withColumn("__one", F.lit(1))
    hashed = each.withColumn("__u", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(cluster).cast("string")).cast("binary")))
    dealt = sampling.prefix_sums(hashed, [], ["__u", cluster], "__one").select(cluster, F.pmod("before", F.lit(k)).cast("int").alias("fold"))
    return df.join(dealt, cluster)
