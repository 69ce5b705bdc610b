"""Phrase collocation mining: counts of frequent word runs, and the runs whose weakest cut still holds together.

1. Words are counted by language. Those that occur often enough form the dictionary; numbered() gives them ids from 1.
2. Texts are encoded: a text becomes an array of ids, in which 0 stands for a break between pieces, the end of the
   text and a word outside the dictionary. The head of the dictionary, its most frequent words up to a bound of
   words and bytes, is broadcast; words of the tail, if there is one, are joined to the dictionary by shuffle and
   patched into the array.
3. Id runs become keys of four ids, big-endian and padded with 0, so that byte order is id order. A task sorts its keys
   by radix, counts runs of equal ones, and sends (key, count) on; range partitions are sorted and counted again. Runs of
   three words are taken only where both of their pairs are in a Bloom filter of the frequent pairs, runs of four where
   both of their runs of three are in one of those. The filter's size is fixed; a wrongly let-in run costs time and is
   dropped by its exact count. A pass sends one row at most for a place in a text.
4. Frequent runs meet the counts of their parts, and their words, in one join; a longer run reports its count to the
   runs inside it. The result is ranked within each language.

Everything is exact and covers all texts; ids belong to a language, so one key space serves all.

Defined cases: a null text is empty, a null language is `und`; empty tables and languages without candidates give no
rows; repeated rows count as often as they occur, whatever their doc_id; texts of any length are read whole; ties in
score and count are ordered by the phrase's UTF-8 bytes, which are different for different phrases. Other columns are
not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .sharding import numbered
from .text import mix, small_batches

LEAST = 30
LONGEST = 4
TOP = 2000
#: A longer run with at least so many hundredths of a run's count makes the run a fragment.
WHOLE = 80
SCALE = 2_000_000
#: The head of the dictionary: words and bytes at most.
HEAD_WORDS, HEAD_BYTES = 400_000, 16 << 20
#: Bits of the filter of frequent pairs.
FILTER_BITS = 27
#: Word counts and keys that a task holds before it sends them on.
MOST_COUNTS, MOST_KEYS = 250_000, 1_000_000
#: Keys in a batch that is sent on.
SENT = 65_536

_FROM = bytes(range(65, 91)) + b"\t" + b".,;:!?\n\x0b\x0c\r"
_TO = bytes(range(97, 123)) + b" " + b"." * 10
_TABLE = bytes.maketrans(_FROM, _TO)
U = np.uint64


class Ids(dict):
    """Ids of words; 0 for all others."""

    def __missing__(self, word: bytes) -> int:
        return 0


def tokens(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, with b"." at every break between pieces (no word holds a full stop)."""
    return (text or "").encode().translate(_TABLE).replace(b".", b" . ").split()


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n); a word is its UTF-8 bytes."""
    small_batches(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def sent() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items() if w != b"."]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(tokens(text.as_py()))
            if sum(map(len, held.values())) > MOST_COUNTS:
                yield sent()
        if held:
            yield sent()

    parts = _texts(documents).mapInArrow(count, "lang string, word binary, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def dictionary(words: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """(lang, word, n, id) of the frequent words, ids from 1 by falling count, and how many there are."""
    frequent = words.where(F.col("n") >= least).withColumn("__rare", -F.col("n"))
    rows, many = numbered(frequent, ("__rare", "lang", "word"), "id")
    return rows.select("lang", "word", "n", (F.col("id") + 1).alias("id")), many


def encode(documents: DataFrame, known: DataFrame, many: int, head_words: int = HEAD_WORDS, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(ids): the ids of each text as little-endian 64-bit integers, 0 at the end."""
    spark = documents.sparkSession
    small_batches(spark)
    # at most head_words rows, and of them those within head_bytes
    head, size = {}, 0
    for lang, word, i in known.where(F.col("id") <= head_words).where(F.octet_length("word") <= head_bytes).select("lang", "word", "id").toArrow().sort_by("id").to_pandas().itertuples(index=False):
        size += len(word)
        if size > head_bytes:
            break
        head.setdefault(lang, Ids())[word] = i
    first_of_tail = sum(map(len, head.values())) < many
    shared = spark.sparkContext.broadcast(head)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, nothing = TaskContext.get().partitionId(), 0, Ids()
        for batch in batches:
            serials, out, tails = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokens(text.as_py())
                found.append(b".")
                ids = np.fromiter(map(shared.value.get(lang, nothing).__getitem__, found), np.int64, len(found))
                serials.append((part << 33) + serial)
                out.append(ids.tobytes())
                tails.append([{"at": k, "lang": lang, "word": found[k]} for k in np.flatnonzero(ids == 0).tolist() if found[k] != b"."] if first_of_tail else None)
                serial += 1
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.struct([("at", pa.int32()), ("lang", pa.string()), ("word", pa.binary())])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((serials, out, tails), kinds, strict=True)], names=["chunk", "ids", "tail"])

    chunks = stored(_texts(documents).mapInArrow(encoded, "chunk long, ids binary, tail array<struct<at:int,lang:string,word:binary>>"), "encoded", "zstd")
    if not first_of_tail:
        return chunks.select("ids")
    at_tail = chunks.select("chunk", F.explode("tail").alias("t")).select("chunk", "t.*")
    met = at_tail.join(known.select("lang", "word", "id"), ["lang", "word"])
    patches = met.groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("patch"))

    def patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, patch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, np.int64).copy()
                for p in patch or ():
                    ids[p["at"]] = p["id"]
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return stored(chunks.select("chunk", "ids").join(patches, "chunk", "left").select("ids", "patch").mapInArrow(patched, "ids binary"), "encoded", "zstd")


def pieces_of(column: pa.Array, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """The ids of a batch of texts, some texts at a time, cut after a break."""
    large = column.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = large.buffers()[2]
    ids = np.frombuffer(data, np.int64)[offsets[0] // 8 : offsets[-1] // 8] if data is not None and data.size else np.zeros(0, np.int64)
    breaks = np.flatnonzero(ids == 0) + 1
    lo = 0
    while lo < len(ids):
        ahead = np.searchsorted(breaks, lo + most)
        hi = int(breaks[min(ahead, len(breaks) - 1)])
        yield ids[lo:hi]
        lo = hi


def radix_order(digits: np.ndarray) -> np.ndarray:
    """The order of rows of 16-bit digits, most significant first, by stable passes from the last digit to the first."""
    order = np.arange(len(digits))
    for column in digits.T[::-1]:
        if len(column) and (column != column[0]).any():
            order = order[np.argsort(column[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys (rows of 64-bit integers) and their summed counts."""
    if not len(keys):
        return keys, counts
    digits = keys.astype(">i8").view(">u2").reshape(len(keys), -1).astype(np.uint16)
    order = radix_order(digits)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    return keys[start], np.add.reduceat(counts[order], start)


def run_bits(columns: Sequence[np.ndarray], bits: int = FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each run of ids, given word by word."""
    h = columns[0].astype(U)
    for right in columns[1:]:
        h = mix(h * U(0x9E3779B97F4A7C15) + mix(right.astype(U)))
    return h & U((1 << bits) - 1), (h >> U(64 - bits))


def _width(many: int) -> int:
    """Bytes of an id."""
    return 4 if many < 1 << 32 else 8


def packed(ids: np.ndarray, at: np.ndarray, n: int, columns: int, width: int) -> np.ndarray:
    """The runs of n ids at some places, as rows of 64-bit integers that hold one or two ids each; the rest is 0."""
    out = np.zeros((len(at), columns), np.int64)
    for i in range(n):
        if width == 4:
            out[:, i // 2] |= ids[at + i] << (32 * (1 - i % 2))
        else:
            out[:, i] = ids[at + i]
    return out


def places_of(ids: np.ndarray, n: int, table: np.ndarray | None = None) -> np.ndarray:
    """Where runs of n ids begin; table: the filter that holds both of the shorter runs of each."""
    whole = np.logical_and.reduce([ids[i : len(ids) - n + 1 + i] > 0 for i in range(n)])
    if table is None:
        return np.flatnonzero(whole)
    some = ids[:-1] > 0
    at = np.flatnonzero(np.logical_and.reduce([some[i : len(some) - n + 3 + i] for i in range(n - 2)] + [ids[n - 2 :] > 0]))
    let = np.zeros(len(ids) - n + 2, bool)
    let[at] = np.logical_and.reduce([(table[(x >> U(3)).astype(np.int64)] >> (x & U(7)).astype(np.uint8)) & 1 > 0 for x in run_bits([ids[at + i] for i in range(n - 1)])])
    return np.flatnonzero(whole & let[:-1] & let[1:])


def counted_runs(encoded: DataFrame, many: int, n: int, least: int = LEAST, allowed=None) -> DataFrame:
    """(key, n) of the runs of n ids that occur at least so often; allowed: the broadcast filter of those of n - 1."""
    width, length = _width(many), n
    columns = length * width + 7 >> 3
    names = [f"k{i}" for i in range(columns)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if allowed is None else np.frombuffer(allowed.value, np.uint8)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def compact() -> int:
            k, n = run_lengths(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [k], [n]
            return len(k)

        def sent() -> Iterator[pa.RecordBatch]:
            k, n = keys.pop(), counts.pop()
            for i in range(0, len(k), SENT):
                part = k[i : i + SENT]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in part.T), pa.array(n[i : i + SENT])], names=[*names, "n"])

        for batch in batches:
            for ids in pieces_of(batch.column(0)):
                if len(ids) < length:
                    continue
                at = places_of(ids, length, table)
                keys.append(packed(ids, at, length, columns, width))
                counts.append(np.ones(len(at), np.int64))
                if sum(map(len, keys)) > MOST_KEYS and compact() > MOST_KEYS // 2:
                    yield from sent()
        if keys:
            compact()
            yield from sent()

    schema = ", ".join(f"{c} long" for c in [*names, "n"])
    return frequent_keys(stored(encoded.select("ids").mapInArrow(local, schema), "runs", "zstd"), least, LONGEST * width)


def frequent_keys(parts: DataFrame, least: int, size: int) -> DataFrame:
    """(key, n): counts of keys summed over range partitions, in each a sort and a count of the runs of equal keys. A
    key becomes so many bytes, big-endian."""
    names = [c for c in parts.columns if c != "n"]

    def keyed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        raw = np.zeros((len(keys), size), np.uint8)
        raw[:, : 8 * len(names)] = keys.astype(">i8").view(np.uint8).reshape(len(keys), 8 * len(names))
        coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([coded, pa.array(n)], names=["key", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0  # the run that the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(len(names))], 1)
            start = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))))
            sums = np.add.reduceat(batch.column(len(names)).to_numpy(), start)
            if last is not None and (rows[0] == last[0]).all():
                sums[0] += held
            elif last is not None and held >= least:
                yield keyed(last, np.array([held]))
            last, held = rows[start[-1]][None, :], int(sums[-1])
            keep = np.flatnonzero(sums[:-1] >= least)
            yield keyed(rows[start[keep]], sums[keep])
        if last is not None and held >= least:
            yield keyed(last, np.array([held]))

    return parts.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(total, "key binary, n long")


def run_filter(runs: DataFrame, many: int, n: int):
    """The broadcast Bloom filter of the frequent runs of n words: 2**FILTER_BITS bits whatever their number."""
    size = _width(many)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), f">u{size}").reshape(-1, LONGEST)
            for x in run_bits([ids[:, i] for i in range(n)]):
                np.bitwise_or.at(table, (x >> U(3)).astype(np.int64), np.left_shift(1, (x & U(7)).astype(np.uint8)).astype(np.uint8))
        words = table.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    found = runs.select("key").mapInArrow(bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(1 << FILTER_BITS - 6, np.int64)
    words[found["at"].to_numpy()] = found["word"].to_numpy()
    return runs.sparkSession.sparkContext.broadcast(words.tobytes())


def frequent_runs(documents: DataFrame, least: int = LEAST, head_words: int = HEAD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Runs of 2 to LONGEST words that occur at least so often (key, n), the dictionary, the words of each language
    (lang, n), and the bytes of an id."""
    words = stored(word_counts(documents), "words")
    known, many = dictionary(words, least)
    encoded = encode(documents, known, many, head_words)
    runs = shorter = stored(counted_runs(encoded, many, 2, least), "frequent")
    for n in range(3, LONGEST + 1):
        allowed = run_filter(shorter, many, n - 1)
        shorter = stored(counted_runs(encoded, many, n, least, allowed), "frequent")
        allowed.unpersist()
        runs = runs.unionByName(shorter)
    return runs, known, words.groupBy("lang").agg(F.sum("n").alias("n")), _width(many)


def mine_phrases(documents: DataFrame, least: int = LEAST, top: int = TOP, whole: int = WHOLE, head_words: int = HEAD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language; see the module's text."""
    runs, known, totals, w = frequent_runs(documents, least, head_words)
    size = LONGEST * w
    zero = F.unhex(F.lit("00" * size))

    def part(first, many):
        """The key of some words of a run."""
        return F.substring(F.concat(F.expr(f"substring(key, {first * w + 1}, {many * w})"), zero), 1, size)

    runs = runs.withColumn("m", sum(((F.expr(f"substring(key, {i * w + 1}, {w})") != F.unhex(F.lit("00" * w))).cast("int") for i in range(LONGEST)), F.lit(0)))
    # what longer runs say of the runs inside them
    inside = [F.when(F.col("m") > k, part(i, k)) for k in range(2, LONGEST) for i in range(LONGEST - k + 1)]
    fits = [F.col("m") >= i + k for k in range(2, LONGEST) for i in range(LONGEST - k + 1)]
    held = runs.where("m > 2").select(F.explode(F.array_compact(F.array(*[F.when(f, p) for f, p in zip(fits, inside, strict=True)]))).alias("key"), F.col("n").alias("longer"))
    held = held.groupBy("key").agg(F.max("longer").alias("longer"))
    candidates = runs.join(held, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(25,0)") < whole * F.col("n").cast("decimal(25,0)"))).select("key", "n", "m")
    # the counts of all parts, and the words
    ones = known.select(F.unhex(F.rpad(F.lpad(F.hex("id"), 2 * w, "0"), 2 * size, "0")).alias("part"), "n", "word", "lang")
    counts = runs.select(F.col("key").alias("part"), "n", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("string").alias("lang")).unionByName(ones)
    wanted = []
    for k in range(1, LONGEST):
        wanted += [F.when(F.col("m") > k, F.struct(F.lit(f"l{k}").alias("role"), part(0, k).alias("part")))]
        wanted += [F.when(F.col("m") > k, F.struct(F.lit(f"r{k}").alias("role"), part(k, LONGEST - k).alias("part")))]
    wanted += [F.when(F.col("m") > i, F.struct(F.lit(f"w{i}").alias("role"), part(i, 1).alias("part"))) for i in range(LONGEST)]
    asked = candidates.select("key", F.col("n").alias("a"), "m", F.explode(F.array_compact(F.array(*wanted))).alias("x")).select("key", "a", "m", "x.role", "x.part")
    met = asked.join(counts, "part")
    one = lambda role, column: F.max(F.when(F.col("role") == role, F.col(column)))
    joined = met.groupBy("key", "a", "m").agg(
        F.max("lang").alias("lang"),
        *[one(f"{s}{k}", "n").alias(f"{s}{k}") for s in "lr" for k in range(1, LONGEST)],
        *[one(f"w{i}", "word").cast("string").alias(f"w{i}") for i in range(LONGEST)],
    )
    exact = lambda k: F.expr(f"(cast(a as decimal(24,0)) * {SCALE}) div (cast(l{k} as decimal(24,0)) + r{k})")
    cuts = F.array_compact(F.array(*[F.when(F.col("m") > k, F.struct(exact(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]))
    scored = joined.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(LONGEST)]).alias("phrase"), "a", F.array_min(cuts).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").cast("binary"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^ \x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
u AS (SELECT lang, piece, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM w),
q4 AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM u WINDOW o AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, ph, len(ph) AS k, count(*) AS f FROM (SELECT lang, [w1] AS ph FROM q4 UNION ALL SELECT lang, [w1, w2] FROM q4 WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM q4 WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4] FROM q4 WHERE w4 IS NOT NULL) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, ph, k AS m, f AS a FROM g WHERE k > 1),
y AS (SELECT lang, array_to_string(ph, ' ') AS part, f FROM g),
x AS MATERIALIZED (SELECT lang, ph, a, m, k, array_to_string(ph[1:k], ' ') AS first, array_to_string(ph[k + 1:m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT x.lang, ph, a, m, l.f AS l, r.f AS r, k, ({SCALE}::HUGEINT * a // (l.f + r.f))::BIGINT AS score FROM x JOIN y l ON l.lang = x.lang AND l.part = x.first JOIN y r ON r.lang = x.lang AND r.part = x.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
o AS (SELECT lang, sub, max(a) AS longer FROM (SELECT lang, a, ph[i:i + k - 1] AS sub FROM (SELECT lang, a, ph, k, unnest(range(1, m - k + 2)) AS i FROM c, range(2, {LONGEST}) t(k) WHERE k < m)) GROUP BY ALL),
z AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN o ON o.lang = b.lang AND o.sub = b.ph WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < {WHOLE}::HUGEINT * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= {TOP}
"""
