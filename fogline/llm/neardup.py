"""MinHash near-dedup with SetSketch registers.

Method: a document's set of word shingles is summarised by M registers. Register i holds the exponentially spaced,
truncated minimum over the set of an exponential hash, floor(1 - log_b h_i) clipped to 16 bits; registers of two
sets merge by their maximum, and two registers are equal with a probability close to the Jaccard similarity. Bands
of registers are the candidates' keys. For a candidate pair, the counts of larger, smaller and equal registers and
the two known set sizes give a likelihood of the similarity; pairs whose threshold is far less likely than the best
estimate are dropped, and all others are verified on their full shingle sets.

Equal sets are one class, and only classes are compared. In a band's bucket every class is first compared with one
leader; the links found give components. Only buckets of three or more classes that still hold different components go
on: their classes are compared on full sets across components, a block of classes with another at a time, inside the
task; a task returns no more links than join its components. So a bucket filled by one group of near copies costs one
comparison a member and those of its outliers, pairs are never rows, and no link is lost to the leader's choice.
With 40 bands of 5 registers a pair at similarity 0.75 shares no bucket with probability 2e-5, at 0.8 with 1e-7.

A class is known by 64 bits mixed from two sums over its shingle hashes and its size: among N different sets about
N * N / 2**65 are taken for others (6e-6 at the 15 million documents of 30 GB). Every other link is confirmed on full
sets.

Defined cases: a null or wordless text has an empty set and is linked with nothing; fewer words than the shingle
length are one shingle; repeated rows are members of the same class; a null doc_id takes part in links, is never the
smallest id unless all are null, and component_id is then null; columns other than doc_id and text are not used.
Tests measure recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import release, stored
from .text import Chunk, U, chunks, grams, mix, runs, small_batches

WORDS = 5
PERCENT = 75
BANDS, ROWS = 40, 5
M = BANDS * ROWS
#: SetSketch's base, rate and truncation.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: A candidate goes on to verification unless its threshold is e**-DOUBT times as likely as the best estimate.
DOUBT = 14.0
#: Members compared with one copy of a leader's text.
GROUP = 32
#: Classes of an unsettled bucket, and their shingles, that make a block; larger buckets are compared block by block.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000

_SEED = mix(np.arange(1, M + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_FACTOR = mix(_SEED) | U(1)


def shingle_sets(chunk: Chunk, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's set begins."""
    words, first = chunk.word_hashes(lower=True), chunk.first
    counts = np.diff(first)
    at, hashes = grams(words, first, k)
    short = (counts > 0) & (counts < k)
    if short.any():
        lo = first[:-1][short]
        at, hashes = np.concatenate((at, lo)), np.concatenate((hashes, runs(words, lo, first[1:][short])))
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
    begin = np.searchsorted(at, first)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    starts = begin[:-1]
    new[starts[starts < len(new)]] = True
    total = np.concatenate(([0], np.cumsum(new)))
    return hashes[new], total[begin]


def _each(ufunc: np.ufunc, values: np.ndarray, begin: np.ndarray, empty) -> np.ndarray:
    """ufunc over each text's values; `empty` where it has none."""
    out = np.full(len(begin) - 1, empty, values.dtype)
    full = begin[1:] > begin[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, begin[:-1][full])
    return out


def registers(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The M registers of each set, uint16."""
    low = np.empty((M, len(begin) - 1), U)
    work = np.empty_like(sets)
    for i in range(M):
        np.bitwise_xor(sets, _SEED[i], out=work)
        np.multiply(work, _FACTOR[i], out=work)
        low[i] = _each(np.minimum, work, begin, U(0xFFFFFFFFFFFFFFFF))
    uniform = (low.astype(np.float64) + 1) / 2.0**64
    spaced = np.floor(1 - np.log(-np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE) / np.log(BASE))
    return np.clip(spaced, 0, TOP).astype(np.uint16).T.copy()


def bands(regs: np.ndarray) -> np.ndarray:
    """The bucket keys of register rows, one column for each band."""
    key = np.zeros((len(regs), BANDS), U)
    rows = regs.reshape(-1, BANDS, ROWS)
    for i in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, :, i].astype(U) + U(1))
    return mix(key + np.arange(BANDS, dtype=U) * U(0xC2B2AE3D27D4EB4F))


def _log_likelihood(j: np.ndarray, larger, smaller, equal, u, v) -> np.ndarray:
    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return larger * np.log(np.maximum(a, tiny)) + smaller * np.log(np.maximum(b, tiny)) + equal * np.log(np.maximum(1 - a - b, tiny))


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of register rows x and y of sets of nx and ny shingles, jointly over register orders and
    sizes; and how much less likely (in log) the threshold PERCENT is than it (0 where the estimate lies above)."""
    larger, smaller = (x > y).sum(1)[:, None].astype(float), (x < y).sum(1)[:, None].astype(float)
    equal = x.shape[1] - larger - smaller
    u = (nx / (nx + ny))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    values = _log_likelihood(grid, larger, smaller, equal, u, v)
    best = values.argmax(1)
    at = grid[np.arange(len(grid)), best]
    limit = np.minimum(PERCENT / 100, np.minimum(u / v, v / u))
    gap = values.max(1) - _log_likelihood(limit, larger, smaller, equal, u, v)[:, 0]
    return at, np.where(at >= PERCENT / 100, 0.0, gap)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = len(batch)
        size, h1, h2 = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, U)
        regs: list = [None] * n
        for chunk in chunks(batch.column(2)):
            sets, begin = shingle_sets(chunk)
            size[chunk.rows] = np.diff(begin)
            h1[chunk.rows] = _each(np.add, mix(sets + U(0x5851F42D4C957F2D)), begin, U(0))
            h2[chunk.rows] = _each(np.add, mix(sets ^ U(0x14057B7EF767814F)), begin, U(0))
            for row, r in zip(chunk.rows, registers(sets, begin), strict=True):
                regs[row] = r.tobytes() if size[row] else None
        cid = mix(h1 ^ mix(h2 + size.astype(U))).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(cid, mask=size == 0), pa.array(regs, pa.binary())], names=["doc_id", "th", "n", "cid", "regs"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        regs = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(-1, M)
        others = [c.take(pa.array(np.repeat(np.arange(len(batch)), BANDS))) for c in batch.columns[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(bands(regs).ravel().view(np.int64)), *others], names=["bucket", *batch.schema.names[1:]])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (2, 4))
            _, gap = estimate(x, y, batch.column(3).to_numpy().astype(float), batch.column(5).to_numpy().astype(float))
            yield batch.select(["cid", "leader"]).filter(pa.array(gap <= DOUBT))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by leader and part, the leader's own text (is_member 0) before its members'."""
    leader, own = None, np.zeros(0, U)
    for batch in batches:
        lead, member, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        out_a, out_b = [], []
        for chunk in chunks(batch.column(4)):
            sets, begin = shingle_sets(chunk)
            for i, row in enumerate(chunk.rows):
                mine = sets[begin[i] : begin[i + 1]]
                if not member[row]:
                    leader, own = lead[row], mine.copy()
                    continue
                if lead[row] != leader:
                    raise ValueError("a leader's text is missing")
                both = int((own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine).sum())
                if 100 * both >= PERCENT * (len(own) + len(mine) - both):
                    out_a.append(ids[row])
                    out_b.append(leader)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["src", "dst"])


def _texts(documents: DataFrame, classes: DataFrame, cids: DataFrame) -> DataFrame:
    """(cid, text): one text of each wanted class."""
    wanted = cids.join(classes.select("cid", "id", "th"), "cid")
    keyed = documents.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("th"), "text")
    return keyed.join(wanted, ["id", "th"]).select("cid", "text").dropDuplicates(["cid"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that join parts within one bucket (or two of its blocks); rows come bucket by bucket."""
    key, held = None, []

    def links() -> pa.RecordBatch:
        cid, part, side = (np.array([h[i] for h in held]) for i in range(3))
        sets = [h[3] for h in held]
        size = np.array([len(x) for x in sets])
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(size)))
        group, inverse = np.unique(part, return_inverse=True)
        parent = np.arange(len(group))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        mark, out_a, out_b = np.zeros(len(values), np.int64), [], []
        two = len(set(side.tolist())) > 1
        # rows of the largest part are met by all others
        largest = np.bincount(inverse).argmax()
        for i in np.flatnonzero(inverse != largest):
            other = inverse != inverse[i]
            if two:
                other &= side != side[i]
            if not other.any():
                continue
            mine = at[begin[i] : begin[i + 1]]
            mark[mine] = 1
            both = np.add.reduceat(mark[at], begin[:-1])
            mark[mine] = 0
            for j in np.flatnonzero(other & (100 * both >= PERCENT * (size + size[i] - both))):
                a, b = root(inverse[i]), root(inverse[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out_a.append(cid[i])
                    out_b.append(cid[j])
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["src", "dst"])

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        side, cid, part = (batch.column(i).to_pylist() for i in (3, 4, 5))
        for chunk in chunks(batch.column(6)):
            sets, begin = shingle_sets(chunk)
            for i, row in enumerate(chunk.rows):
                if keys[row] != key:
                    if held:
                        yield links()
                    key, held = keys[row], []
                held.append((cid[row], part[row], side[row], sets[begin[i] : begin[i + 1]].copy()))
    if held:
        yield links()


def _links(documents: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (cid, leader) pairs whose full sets are similar, as (src, dst)."""
    regs = classes.select("cid", "regs", "n")
    sized = pairs.join(regs, "cid").join(regs.select(F.col("cid").alias("leader"), F.col("regs").alias("regs2"), F.col("n").alias("n2")), "leader")
    likely = stored(sized.select("cid", "leader", "regs", "n", "regs2", "n2").mapInArrow(_likely, "cid long, leader long"), "pairs")
    crowd = likely.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = likely.join(crowd, "leader").select("leader", F.expr("pmod(xxhash64(cid), parts)").alias("part"), "cid")
    texts = stored(_texts(documents, classes, likely.select("cid").union(likely.select("leader")).distinct()), "texts")
    members = dealt.join(texts, "cid").select("leader", "part", F.lit(1).alias("is_member"), "cid", "text")
    leaders = dealt.select("leader", "part").distinct().join(texts.withColumnRenamed("cid", "leader"), "leader").select("leader", "part", F.lit(0).alias("is_member"), F.col("leader").alias("cid"), "text")
    merged = members.unionAll(leaders).repartition("leader", "part").sortWithinPartitions("leader", "part", "is_member")
    return stored(merged.mapInArrow(_verified, "src long, dst long"), "links")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of documents; see the module's text."""
    found = _grouped(documents)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.expr("doc_id <=> (case when n = 0 then doc_id else component_id end)").alias("kept"))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """The rows of documents without all but one of each component: that with the smallest doc_id (null last, then by a
    hash of the text; of equal rows one stays). Rows without words are all kept."""
    found = _grouped(documents).where("n > 0")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(-1)).alias("id"), "th")
    winner = found.groupBy("component").agg(F.min(key).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.th").alias("__th"))
    winner = stored(winner, "winners")
    keyed = documents.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__th": F.xxhash64("text")})
    stay = keyed.join(winner, ["__id", "__th"], "left_semi")
    again = found.groupBy(F.coalesce("doc_id", F.lit(-1)), "th").agg(F.count("*").alias("many")).where("many > 1")
    if again.take(1):
        stay = stay.dropDuplicates(["__id", "__th"])
    wordless = documents.where("text is null").unionAll(documents.where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    return stay.select(*documents.columns).unionAll(wordless)


def _grouped(documents: DataFrame) -> DataFrame:
    """doc_id, th, n, component (a class id) and component_id for every row."""
    spark = documents.sparkSession
    small_batches(spark)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(documents.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_sketched, "doc_id long, th long, n long, cid long, regs binary"), "sets")
    of_class = rows.where("n > 0").groupBy("cid").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), "th")).alias("rep"), F.min("doc_id").alias("least_id"), F.min("n").alias("n"), F.first("regs").alias("regs"))
    classes = stored(of_class.select("cid", "rep.id", "rep.th", "least_id", "n", "regs"), "classes")
    release(spark)

    banded = classes.select("regs", "cid", "n").mapInArrow(_banded, "bucket long, cid long, n long")
    lead = banded.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("lead"), F.count("*").alias("many")).where("many > 1")
    met = banded.join(lead, "bucket").where(f"cid <> lead.cid and 100 * least(n, lead.n) >= {PERCENT} * greatest(n, lead.n)")
    # the leader is the least of its bucket, so every pair is named in the same order
    tested = stored(met.select("cid", F.col("lead.cid").alias("leader")).distinct(), "candidates")
    release(spark)
    links = _links(documents, classes, tested)
    release(spark)

    parts = stored(connected_components(links), "parts")
    labelled = stored(classes.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("regs", "cid", F.coalesce("component", "cid").alias("part"), "n"), "labelled")
    banded = labelled.mapInArrow(_banded, "bucket long, cid long, part long, n long")
    split = banded.groupBy("bucket").agg(F.count("*").alias("many"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.sum("n").alias("size")).where("many > 2 and lo <> hi").select("bucket", F.ceil(F.greatest(F.col("many") / BLOCK, F.col("size") / BLOCK_SHINGLES)).alias("blocks"))
    left = stored(banded.join(split, "bucket").select("bucket", "cid", "part", "blocks", F.expr("pmod(xxhash64(cid), blocks)").alias("side")), "unsettled")
    release(spark)
    texts = stored(_texts(documents, classes, left.select("cid").distinct()), "texts")
    release(spark)
    paired = left.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(texts, "cid")
    paired = paired.select("bucket", F.least("side", "with").alias("x"), F.greatest("side", "with").alias("y"), "side", "cid", "part", "text")
    dealt = paired.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    more = stored(dealt.mapInArrow(_settled, "src long, dst long"), "links")
    release(spark)
    if more.take(1):
        parts = stored(connected_components(links.union(more)), "parts")
    whole = classes.select("cid", "least_id").join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least_id", F.coalesce("component", "cid").alias("component"))
    least = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = stored(whole.join(least, "component").select("cid", "component", "component_id"), "components")
    return rows.select("doc_id", "th", "n", "cid").join(of, "cid", "left").select("doc_id", "th", "n", "component", "component_id")


SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT r, array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT DISTINCT r, hash(g) AS h, g FROM g),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.g = b.g AND a.r < b.r GROUP BY ALL),
e AS (SELECT a, b FROM met JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * m >= {PERCENT} * (x.n + y.n - m)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
c AS (SELECT a AS r, min(doc_id) AS low FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(least(low, doc_id), doc_id) AS BIGINT) AS component_id,
  doc_id IS NOT DISTINCT FROM coalesce(least(low, doc_id), doc_id) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
