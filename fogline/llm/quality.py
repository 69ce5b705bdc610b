"""Quality rules: counting rules, then a calibrated n-gram classifier trained on labelled rows.

Method: hashed word and character n-gram logistic regression. Words and pairs of words fall into one block of
buckets, runs of 3 and 4 characters into another; a text's features are the shares of its n-grams in each bucket.
Training uses at most `train_rows` labelled rows of each class (the smallest hashes of doc_id, so the sample does
not depend on order or partitioning); a part of them, not used for the weights, calibrates the score to a
probability (Platt scaling, weighted back to the class shares of all labels). One task fits these bounded rows, and only
the weights come to the driver. All rows are then scored in Arrow batches against fixed thresholds.

Defined cases: a null text has no words; an empty text fails the base rule; without labels of both classes there is
no model, and the base rules alone decide; repeated rows are judged one by one; columns of the input with the
names of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .text import U, chunks, grams, mix, small_batches

BITS = 12
BLOCK = 1 << BITS
#: Fixed thresholds.
LEAST_WORDS, MOST_REPEATED, LEAST_QUALITY = 50, 50, 0.5
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_NOT_WORD_CHARS = bytes(range(0x80, 0xC0)) + _BLANKS

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality double, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class QualityModel:
    """weights: of the word block, then of the character block; margin = bias + features @ weights."""

    weights: np.ndarray
    bias: float
    slope: float  # calibration: P(good) = sigmoid(slope * margin + shift)
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += bool(line.strip(_BLANKS))
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        once: set[tuple] = set()
        twice: set[tuple] = set()
        for w in windows:
            (twice if w in once else once).add(w)
        covered = -1  # last word counted so far
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    return len(words), len(text.translate(None, _NOT_WORD_CHARS)), len(text) - len(text.translate(None, _SYMBOLS)), dup, repeated


def _buckets(chunk) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each kind of n-gram: bucket of every n-gram, where each text's n-grams begin, first bucket of the block."""
    words, first = chunk.word_hashes(), chunk.first
    pairs_at, pairs = grams(words, first, 2)
    out = [((words >> U(64 - BITS)).astype(np.int64), first, 0), ((mix(pairs + U(2)) >> U(64 - BITS)).astype(np.int64), np.searchsorted(pairs_at, first), 0)]
    # a byte of the form 10xxxxxx goes on with a character
    begins = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    ends = np.append(begins, len(chunk.data))
    of = np.searchsorted(begins, chunk.bounds)
    for n in (3, 4):
        # a run that reaches into the next text of the chunk belongs to neither
        inside = np.arange(len(begins)) + n <= np.repeat(of[1:], np.diff(of))
        at = np.flatnonzero(inside)
        codes = chunk.byte_hashes(begins[at], ends[at + n])
        out.append(((mix(codes + U(n)) >> U(64 - BITS)).astype(np.int64), np.searchsorted(at, of), BLOCK))
    return out


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]


def margins(chunk, model: QualityModel) -> np.ndarray:
    """bias + the mean weight of the texts' n-grams, block by block."""
    out = np.full(len(chunk.rows), model.bias)
    for block in (0, BLOCK):
        total, count = np.zeros(len(out)), np.zeros(len(out))
        for bucket, begin, at in _buckets(chunk):
            if at == block:
                total += _sums(model.weights[bucket + at], begin)
                count += np.diff(begin)
        out += total / np.maximum(count, 1)
    return out


def features(column: pa.Array) -> np.ndarray:
    """Shares of the n-grams by bucket, one row for each text."""
    out = np.zeros((len(column), 2 * BLOCK), np.float32)
    for chunk in chunks(column):
        n = len(chunk.rows)
        for block in (0, BLOCK):
            count = np.zeros(n * BLOCK)
            for bucket, begin, at in _buckets(chunk):
                if at == block:
                    count += np.bincount(np.repeat(np.arange(n), np.diff(begin)) * BLOCK + bucket, minlength=n * BLOCK)
            count = count.reshape(n, BLOCK)
            out[chunk.rows, block : block + BLOCK] = count / np.maximum(count.sum(1, keepdims=True), 1)
    return out


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, pull: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient steps; columns are scaled by their root mean square. x is
    scaled in place and scaled back at the end."""
    scale = (1 / (np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-4)).astype(np.float32)
    x *= scale
    weight = weight / weight.sum()
    rate = 4 / max(float(weight @ np.einsum("ij,ij->i", x, x)), 1e-9)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    ahead, ahead_b = w, b
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead + ahead_b, -50, 50)))
        g = weight * (p - y)
        new, new_b = ahead - rate * (x.T @ g.astype(np.float32) + pull / x.shape[1] * ahead), ahead_b - rate * float(g.sum())
        momentum = t / (t + 3)
        ahead, ahead_b = new + momentum * (new - w), new_b + momentum * (new_b - b)
        w, b = new, new_b
    x /= scale
    return (w * scale).astype(np.float64), b


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with Platt's smoothed targets."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    sd = margin.std() or 1.0
    z = np.stack([margin / sd, np.ones_like(margin)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -50, 50)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.05, 0.05])
        step = np.linalg.solve(h, z.T @ (weight * (p - t)) + np.array([0.05, 0.05]) * theta)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0] / sd), float(theta[1])


def fit_quality(documents: DataFrame, labels: DataFrame, train_rows: int = 1500) -> QualityModel | None:
    """The classifier of labels.quality (1: good); train_rows bounds the labelled rows used of each class."""
    small_batches(documents.sparkSession)
    labels = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return None
    sample = None
    for y in (0, 1):
        part = labels.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        sample = part if sample is None else sample.unionAll(part)

    def vectors(batches):
        for batch in batches:
            x = features(batch.column(2)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    # at most 2 * train_rows rows are broadcast
    joined = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    # a doc_id may stand on any number of rows: of what they make, no more than train_rows of a class are fitted
    made = stored(joined.mapInArrow(vectors, "doc_id long, quality int, x binary"), "vectors")
    bounded = [made.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(train_rows) for y in (0, 1)]

    def fitted(batches):
        model = _train(*_read(batches, 2 * train_rows), shares)
        if model is not None:
            columns = [pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([v], pa.float64()) for v in (model.bias, model.slope, model.shift))]
            yield pa.RecordBatch.from_arrays(columns, names=["weights", "bias", "slope", "shift"])

    # the matrix stays in a worker; the driver gets the weights
    found = _matrix(bounded[0].unionAll(bounded[1])).mapInArrow(fitted, "weights binary, bias double, slope double, shift double").collect()
    return QualityModel(np.frombuffer(found[0]["weights"]), *found[0][1:]) if found else None


def _matrix(rows: DataFrame) -> DataFrame:
    """The training rows, whose number is bounded, for one task."""
    return rows.coalesce(1)


def _read(batches: Iterator[pa.RecordBatch], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, doc_ids and labels of at most so many rows, a batch at a time."""
    x, ids, y, n = np.empty((most, 2 * BLOCK), np.float32), np.zeros(most, np.int64), np.zeros(most), 0
    for batch in batches:
        for vector in batch.column(2):
            x[n] = np.frombuffer(vector.as_buffer(), np.float16)
            n += 1
        ids[n - len(batch) : n], y[n - len(batch) : n] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    return x[:n], ids[:n], y[:n]


def _train(x: np.ndarray, ids: np.ndarray, y: np.ndarray, shares: dict[int, int]) -> QualityModel | None:
    """The classifier of these rows, calibrated to the labels' numbers by class; x is reordered and scaled in place."""
    if len(set(y)) < 2:
        return None
    held = mix(ids.view(U)) % U(4) == U(0)
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    # the rows for the weights first, so that both parts are views
    order = np.lexsort((y, ids, held))
    _reorder(x, order)
    y, n = y[order], int((~held).sum())
    fit_y = y[:n]
    weights, bias = _descend(x[:n], fit_y, np.where(fit_y == 1, 0.5 / max((fit_y == 1).sum(), 1), 0.5 / max((fit_y == 0).sum(), 1)))
    part = slice(n, None) if n < len(y) else slice(None)
    margin, y = x[part] @ weights.astype(np.float32) + bias, y[part]
    prior = np.where(y == 1, shares[1], shares[0]) / np.where(y == 1, (y == 1).sum(), (y == 0).sum())
    slope, shift = _platt(margin.astype(np.float64), y, prior * len(y) / prior.sum())
    return QualityModel(weights, bias, slope, shift)


def _reorder(x: np.ndarray, order: np.ndarray) -> None:
    """x[:] = x[order] with room for one row: every cycle of the permutation is turned in place."""
    done = np.zeros(len(order), bool)
    for i in range(len(order)):
        if done[i] or order[i] == i:
            continue
        first, at = x[i].copy(), i
        while not done[at]:
            done[at] = True
            x[at] = first if order[at] == i else x[order[at]]
            at = order[at]


def quality_columns(text: Column, model: QualityModel | None, least_quality: float = LEAST_QUALITY) -> Column:
    """A struct of the counts, the probability of good quality and the decision, for each text."""

    @F.arrow_udf(RESULT_STRUCT)
    def judged(column: pa.Array) -> pa.Array:
        n = len(column)
        counts = np.array([base_counts(x or b"") for x in column.cast(pa.binary()).to_pylist()], np.int64).reshape(n, 5)
        p = np.ones(n)
        if model is not None:
            for chunk in chunks(column):
                p[chunk.rows] = model.probability(margins(chunk, model))
        failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
        cols = [*(pa.array(c) for c in counts.T.copy()), pa.array(p), pa.array(failed), pa.array(~failed & (p >= least_quality))]
        return pa.StructArray.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])

    return judged.asNondeterministic()(text)


RESULT_STRUCT = f"struct<{', '.join(f'{a}: {b}' for a, b in (x.split() for x in RESULT.split(', ')))}>"


def judge_quality(documents: DataFrame, model: QualityModel | None, least_quality: float = LEAST_QUALITY) -> DataFrame:
    """documents with the columns of RESULT; nothing is shuffled."""
    small_batches(documents.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]
    kept = [documents[c] for c in documents.columns if c.lower() not in names]
    return documents.select(*kept, quality_columns(F.col("text"), model, least_quality).alias("__judged")).select(*[c for c in documents.columns if c.lower() not in names], "__judged.*")
