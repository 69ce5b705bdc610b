"""Conditional logits fitted many at a time: bootstrap refits and cross-fitted stacks in the passes of one fit.

A row holds the features of every place (x, place by place) and the index of the true one. Each of a number of fits
weighs the rows its own way (w, an array with a weight a fit), and all are improved by Newton steps from one pass over
the rows; a fit whose step made it worse goes half the way back. What a pass returns is a gradient and a curvature a fit,
summed in Spark, whatever the number of rows or partitions. All rows have the same number of places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import sampling, scoring

#: Rows x places x fits that are multiplied out at a time.
MOST_CELLS = 2_000_000


def _chunks(batch: pa.RecordBatch, size: int, fits: int, weighed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x as rows x places x features, truth, weights) of a batch, some rows at a time."""
    if not len(batch):
        return
    x = np.array(batch.column(0).to_pylist(), float).reshape(len(batch), -1, size)
    truth = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
    w = np.array(batch.column(2).to_pylist(), float).reshape(len(batch), fits) if weighed else np.ones((len(batch), fits))
    step = max(1, MOST_CELLS // max(1, x.shape[1] * fits))
    for i in range(0, len(x), step):
        yield x[i : i + step], truth[i : i + step], w[i : i + step]


def probabilities(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """(rows, places, fits) of x (rows, places, features) under theta (fits, features)."""
    u = x @ theta.T
    u = np.exp(u - u.max(1, keepdims=True))
    return u / u.sum(1, keepdims=True)


def _pass(df: DataFrame, size: int, fits: int, of, width: int) -> np.ndarray:
    """Sums over all rows of what of(x, truth, w) gives: an array (fits, width)."""
    weighed = "w" in df.columns

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((fits, width))
        for batch in batches:
            for x, truth, w in _chunks(batch, size, fits, weighed):
                total += of(x, truth, w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(fits * width, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    found = df.select("x", "truth", *(["w"] if weighed else [])).mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(fits * width)
    out[found["i"].to_numpy()] = found["v"].to_numpy()
    return out.reshape(fits, width)


def feature_scales(df: DataFrame, size: int, fits: int = 1, unscaled: Sequence[int] = ()) -> np.ndarray:
    """(fits, size): the standard deviation of each feature over the rows and places that a fit weighs; 1 for unscaled."""
    sums = _pass(df, size, fits, lambda x, _, w: np.hstack([w.sum(0)[:, None] * x.shape[1], w.T @ x.sum(1), w.T @ (x**2).sum(1)]), 1 + 2 * size)
    n = np.maximum(sums[:, :1], 1e-300)
    mean = sums[:, 1 : 1 + size] / n
    out = np.sqrt(np.maximum(sums[:, 1 + size :] / n - mean**2, 0.0)) + 1e-9
    out[:, list(unscaled)] = 1.0
    return out


def fit_choices(df: DataFrame, size: int, fits: int = 1, pull: float = 0.0, towards: Sequence[float] | None = None, scale: np.ndarray | None = None, rounds: int = 60, tolerance: float = 1e-9) -> np.ndarray:
    """(fits, size): for each fit the weights of the scaled features that maximise the mean log-likelihood of its rows less
    pull times the squared distance to `towards`. df: x, truth and, for more than one fit, w. Fits without rows stay at
    `towards`."""
    centre = np.zeros(size) if towards is None else np.asarray(towards, float)
    scale = np.ones((fits, size)) if scale is None else scale
    best = np.tile(centre, (fits, 1))
    trial, value, step = best.copy(), np.full(fits, -np.inf), np.zeros((fits, size))
    rows = stored(df.select("x", "truth", *(["w"] if "w" in df.columns else [])), "choices")

    def of(x: np.ndarray, truth: np.ndarray, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
        p = probabilities(x, theta)
        at = np.arange(len(x))
        mean = np.einsum("rcb,rcd->rbd", p, x)
        log = np.log(np.maximum(p[at, truth], 1e-300))
        gradient = np.einsum("rb,rbd->bd", w, x[at, truth][:, None, :] - mean)
        squares = (w[:, None, :] * p).reshape(-1, p.shape[2]).T @ (x[..., :, None] * x[..., None, :]).reshape(-1, size * size)
        curved = squares - np.einsum("rb,rbd,rbe->bde", w, mean, mean).reshape(-1, size * size)
        return np.hstack([w.sum(0)[:, None], (w * log).sum(0)[:, None], gradient, curved])

    for _ in range(rounds):
        s = _pass(rows, size, fits, lambda x, truth, w, t=trial / scale: of(x, truth, w, t), 2 + size + size * size)
        n = np.maximum(s[:, 0], 1e-300)
        now = np.where(s[:, 0] > 0, s[:, 1] / n - pull * ((trial - centre) ** 2).sum(1), 0.0)
        better = now >= value - 1e-12
        gradient = s[:, 2 : 2 + size] / n[:, None] / scale - 2 * pull * (trial - centre)
        curvature = (s[:, 2 + size :] / n[:, None]).reshape(fits, size, size) / (scale[:, :, None] * scale[:, None, :]) + (2 * pull + 1e-10) * np.eye(size)
        fresh = np.linalg.solve(curvature, np.where(s[:, :1] > 0, gradient, 0.0)[..., None])[..., 0]
        best, value = np.where(better[:, None], trial, best), np.where(better, now, value)
        step = np.where(better[:, None], fresh, step / 2)
        if np.abs(step).max() < tolerance:
            break
        trial = best + step
    return best


def refits(df: DataFrame, cluster: str, size: int, pull: float = 0.0, towards: Sequence[float] | None = None, draws: int = 200, seed: int = 0) -> np.ndarray:
    """(draws, size): the weights fitted again, to convergence, on clusters drawn with replacement (scoring.cluster_draws)."""
    copies = scoring.cluster_draws(df, cluster, draws, seed).groupBy(cluster).agg(F.map_from_entries(F.collect_list(F.struct("draw", "copies"))).alias("m"))  # a number a draw
    weights = copies.select(cluster, F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double")).alias("w"))
    return fit_choices(df.join(weights, cluster), size, draws, pull, towards)


def fold_draws(df: DataFrame, cluster: str, folds: int, seeds: int) -> DataFrame:
    """(cluster, fold): for every seed the fold of each cluster, as an array: its place in an order hashed with the seed,
    modulo folds, so folds have the same number of clusters but for one."""
    each = df.select(cluster).where(F.col(cluster).isNotNull()).distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("one", F.lit(1))
    hashed = each.withColumn("u", F.md5(F.concat_ws("|", "seed", F.col(cluster).cast("string")).cast("binary")))
    dealt = sampling.prefix_sums(hashed, ["seed"], ["u", cluster], "one").select("seed", cluster, F.pmod("before", F.lit(folds)).cast("int").alias("f"))
    return dealt.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "f"))), lambda x: x["f"]).alias("fold"))


def cross_fitted(df: DataFrame, cluster: str, size: int, pull: float = 0.0, towards: Sequence[float] | None = None, unscaled: Sequence[int] = (), folds: int = 5, seeds: int = 5) -> tuple[DataFrame, np.ndarray]:
    """df with p, the mean over seeds of each row's probabilities under the fit that its cluster was held out of; and the
    weights (seeds x folds fits, over the scaled features) with a fit's scale beside them: (fits, 2, size). Features are
    scaled by their deviation among the rows of each fit alone."""
    fits = seeds * folds
    rows = df.join(fold_draws(df, cluster, folds, seeds), cluster)
    own = F.transform(F.sequence(F.lit(0), F.lit(fits - 1)), lambda i: (F.get(F.col("fold"), F.floor(i / folds).cast("int")) != F.pmod(i, F.lit(folds))).cast("double"))
    rows = stored(rows.withColumn("w", own), "folds")
    scale = feature_scales(rows, size, fits, unscaled)
    theta = fit_choices(rows, size, fits, pull, towards, scale)
    shown = theta / scale

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, fold in zip(batch.column("x").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                p = probabilities(np.array(x, float).reshape(1, -1, size), shown[[s * folds + f for s, f in enumerate(fold)]])
                out.append(p[0].mean(1).tolist())
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in ("fold", "w")]
            names = [n for n in batch.schema.names if n not in ("fold", "w")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.float64()))], names=[*names, "p"])

    kept = [c for c in df.columns if c != "p"]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept) + ", p array<double>"
    return rows.select(*kept, "fold", "w").mapInArrow(predict, schema), np.stack([theta, scale], 1)
