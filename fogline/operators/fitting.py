"""Maximum-likelihood fits over distributed rows.

Rows stay where they are: each iteration sums, partition by partition, a log-likelihood with its gradient and the outer
products of the rows' gradients (which stand for the curvature), and a second pass tries several step lengths at once.
What comes back is a few numbers a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corrections import apply_map

RowLikelihood = Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]


def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as arrays; lists of equal length as matrices."""
    return {n: np.array(c.to_pylist()) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _sums(df: DataFrame, f: Callable[[dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += f(columns_of(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    rows = df.mapInArrow(part, "v array<double>").toArrow()["v"].to_pylist()
    return np.sum(np.array(rows).reshape(-1, size), 0)


def maximise(df: DataFrame, loglik: RowLikelihood, start: Sequence[float], pull: Sequence[float] | float = 0.0, towards: Sequence[float] | None = None, bounds: tuple[float, float] | None = None, rounds: int = 30, tolerance: float = 1e-7) -> np.ndarray:
    """theta that maximises sum(loglik) - n * sum(pull * (theta - towards)^2), within bounds."""
    theta = np.array(start, float)
    d = len(theta)
    pulls, centre = np.broadcast_to(np.asarray(pull, float), d), np.zeros(d) if towards is None else np.asarray(towards, float)
    df = df.persist()
    try:
        for _ in range(rounds):

            def local(c: dict[str, np.ndarray], theta=theta) -> np.ndarray:
                base, h = loglik(c, theta), 1e-5
                g = np.stack([(loglik(c, theta + h * e) - loglik(c, theta - h * e)) / (2 * h) for e in np.eye(d)], 1)
                return np.concatenate([[len(base), base.sum()], g.sum(0), (g.T @ g).ravel()])

            s = _sums(df, local, 2 + d + d * d)
            n = s[0]
            if not n:
                return theta
            g = s[2 : 2 + d] / n - 2 * pulls * (theta - centre)
            curvature = s[2 + d :].reshape(d, d) / n + np.diag(2 * pulls + 1e-8)
            free = np.ones(d, bool)
            if bounds is not None:
                free = ~((theta <= bounds[0]) & (g < 0) | (theta >= bounds[1]) & (g > 0))
            step = np.zeros(d)
            if free.any():
                step[free] = np.linalg.solve(curvature[np.ix_(free, free)], g[free])
            lengths = np.array([2.0, 1.0, 0.5, 0.25, 0.1, 0.02, 0.0])
            trials = [np.clip(theta + a * step, *bounds) if bounds is not None else theta + a * step for a in lengths]
            values = _sums(df, lambda c, t=trials: np.array([loglik(c, x).sum() for x in t]), len(trials)) / n
            values = values - np.array([(pulls * (x - centre) ** 2).sum() for x in trials])
            best = int(np.nanargmax(values))
            if values[best] - values[-1] < tolerance:
                break
            theta = trials[best]
    finally:
        df.unpersist()
    return theta


def choice_likelihood(features: str = "x", truth: str = "truth", places: int | None = None) -> RowLikelihood:
    """Conditional logit: x holds the features of every place, place by place; truth is the index of the chosen one."""

    def f(c: dict[str, np.ndarray], theta: np.ndarray) -> np.ndarray:
        x = c[features].reshape(len(c[truth]), -1, len(theta))
        u = x @ theta
        u = u - u.max(1, keepdims=True)
        return u[np.arange(len(u)), c[truth]] - np.log(np.exp(u).sum(1))

    return f


def calibration_likelihood(kind: str, p: str = "p", truth: str = "truth") -> RowLikelihood:
    def f(c: dict[str, np.ndarray], theta: np.ndarray) -> np.ndarray:
        q = apply_map(c[p], kind, np.maximum(theta, 1e-4) if kind != "platt" else theta)
        return np.log(np.maximum(q[np.arange(len(q)), c[truth]], 1e-12))

    return f


STARTS = {"power": (1.0,), "platt": (1.0, 0.0), "piecewise": (1.0, 1.0, 1.0, 1.0)}


def fit_calibration(df: DataFrame, kind: str) -> tuple[float, ...]:
    """Parameters of a calibration map for rows of (p array, truth index)."""
    return tuple(maximise(df.select("p", "truth"), calibration_likelihood(kind), STARTS[kind], bounds=(-10.0, 20.0) if kind == "platt" else (1e-3, 20.0)))


def choose_calibration(df: DataFrame, fold: str, k: int, kinds: Sequence[str] = ("power", "platt", "piecewise")) -> dict[str, float]:
    """Mean held-out log-loss of each kind over folds of whole clusters, and of no calibration."""
    out = {"none": 0.0, **dict.fromkeys(kinds, 0.0)}
    n = 0
    for i in range(k):
        train, test = df.where(F.col(fold) != i).select("p", "truth"), df.where(F.col(fold) == i).select("p", "truth")
        fitted = {kind: fit_calibration(train, kind) for kind in kinds} | {"none": (1.0,)}
        names = list(fitted)

        def loss(c: dict[str, np.ndarray], fitted=fitted, names=names) -> np.ndarray:
            return np.array([len(c["truth"]), *(-calibration_likelihood("power" if m == "none" else m)(c, np.array(fitted[m])).sum() for m in names)])

        s = _sums(test, loss, 1 + len(names))
        n += s[0]
        for m, v in zip(names, s[1:], strict=True):
            out[m] += v
    return {m: v / max(n, 1) for m, v in out.items()}


def fit_binned_logit(cells: DataFrame, bins: Sequence[tuple[str, int]], pull: float = 0.005, start: float = -2 / 3, steps: int = 50) -> list[np.ndarray]:
    """Additive tables of a logistic model of k hits in n trials by bins; cells is the binned table (a few thousand rows)."""
    rows = cells.select(*(b for b, _ in bins), "n", "k").toArrow()
    sizes = [m for _, m in bins]
    offset = np.concatenate(([0], np.cumsum(sizes)))
    at = np.stack([np.array(rows[b].to_pylist(), np.int64) + o for (b, _), o in zip(bins, offset, strict=False)], 1)
    n, k = (np.array(rows[c].to_pylist(), float) for c in ("n", "k"))
    theta = np.full(offset[-1], start)
    x = np.zeros((len(n), offset[-1]))
    np.put_along_axis(x, at, 1.0, 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (k - n * p) - 2 * pull * theta
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 2 * pull * np.eye(len(theta))
        step = np.linalg.solve(h, g)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return [theta[a:b] for a, b in zip(offset, offset[1:], strict=False)]


def stack_likelihood(base: str = "base", features: str = "x", truth: str = "truth") -> RowLikelihood:
    """Conditional logit on top of given log-probabilities: theta is the correction, zero leaves the base alone."""

    def f(c: dict[str, np.ndarray], theta: np.ndarray) -> np.ndarray:
        x = c[features].reshape(len(c[truth]), -1, len(theta))
        u = np.log(np.maximum(c[base], 1e-9)) + x @ theta
        u = u - u.max(1, keepdims=True)
        return u[np.arange(len(u)), c[truth]] - np.log(np.exp(u).sum(1))

    return f


def held_out_loss(df: DataFrame, fold: str, k: int, loglik: RowLikelihood, start: Sequence[float], pull: float = 0.01) -> tuple[float, np.ndarray]:
    """Mean held-out loss over k folds (of whole clusters, see scoring.folds), and the folds' mean weights."""
    loss, n, weights = 0.0, 0.0, []
    for i in range(k):
        theta = maximise(df.where(F.col(fold) != i).drop(fold), loglik, start, pull=pull)
        s = _sums(df.where(F.col(fold) == i).drop(fold), lambda c, t=theta: np.array([-loglik(c, t).sum(), len(next(iter(c.values())))]), 2)
        loss, n = loss + s[0], n + s[1]
        weights.append(theta)
    return loss / max(n, 1), np.mean(weights, 0)


def bootstrap_weights(df: DataFrame, cluster: str, loglik: RowLikelihood, theta: Sequence[float], pull: float = 0.0, draws: int = 200, seed: int = 0) -> list[tuple[float, float]]:
    """95 % intervals of fitted weights by resampling clusters, in one pass over the rows.

    Every draw gives a cluster a Poisson number of copies, hashed from (seed, draw, cluster), and moves theta by one
    Newton step from the optimum on the draw's rows, which is what refitting does to first order.
    """
    theta, d = np.asarray(theta, float), len(theta)
    draw = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    below = np.cumsum(np.exp(-1.0) / np.concatenate(([1.0], np.cumprod(np.arange(1.0, 18.0)))))

    def local(c: dict[str, np.ndarray]) -> np.ndarray:
        h = 1e-5
        g = np.stack([(loglik(c, theta + h * e) - loglik(c, theta - h * e)) / (2 * h) for e in np.eye(d)], 1)
        x = draw[:, None] ^ c["__h"].astype(np.int64).view(np.uint64)[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        copies = np.searchsorted(below, (x >> np.uint64(11)).astype(np.float64) / 2**53, "right")
        return np.concatenate([[len(g)], (g.T @ g).ravel(), (copies @ g).ravel(), copies.sum(1)])

    rows = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(cluster))).drop(cluster)
    s = _sums(rows, local, 1 + d * d + draws * d + draws)
    if not s[0]:
        return [(float(t), float(t)) for t in theta]
    curvature = s[1 : 1 + d * d].reshape(d, d) / s[0] + np.diag(np.full(d, 2 * pull + 1e-8))
    gradient = s[1 + d * d : 1 + d * d + draws * d].reshape(draws, d) / np.maximum(s[-draws:], 1)[:, None] - 2 * pull * theta
    moved = theta + np.linalg.solve(curvature, gradient.T).T
    return [tuple(np.percentile(moved[:, i], (2.5, 97.5))) for i in range(d)]
