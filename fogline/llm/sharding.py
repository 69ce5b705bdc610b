"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered from 0 in the order of given columns: range partitions are sorted, written and counted, and a row's
number is its place in its partition plus the rows of the partitions before. A keyed Feistel network on the least even
number of bits that holds all numbers, walked along its cycles until it lands below the row count, permutes the numbers;
the permuted number modulo the shard count is the shard, divided by it the slot. So shard and slot follow from (number,
row count, seed) alone, counts of shards differ by one at most, slots have no gaps, and positions() tells without the
data where any row number is.

Defined cases: a null text is empty; a null key sorts first; rows that repeat a key are told apart by the further order
columns, and rows equal in all of those are spread by their place in the input, which decides nothing unless their other
columns differ; a very long text is one row like any other (only its size and checksum are looked at); an empty table
gives an empty result. Other columns pass unchanged; columns of the input with the names of the result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

SHARDS = 24
SEED = "shard-1"
ROUNDS = 6
#: Odd multipliers of a round, below 2**31, so that every product of a round is below 2**62.
MULTIPLY = (0x2C1B3C6D, 0x297A2D39)
LOW = (1 << 31) - 1


def numbered(rows: DataFrame, order: Sequence[str], name: str = "number") -> tuple[DataFrame, int]:
    """rows with their dense 0-based number in the order of some columns, and how many there are.

    The rows are written to the shared folder once, so that counts and numbers are of the same partitions whatever
    executor is lost. Equal keys spread over several partitions, as their places in the input order them too.
    """
    at, key = "__place", "__row"
    placed = rows.withColumn(at, F.monotonically_increasing_id())
    spread = placed.repartitionByRange(*order, at).sortWithinPartitions(*order, at)
    kept = stored(spread.drop(at).withColumn(key, F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright(key, 33), F.col(key).bitwiseAND((1 << 33) - 1)
    counts = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before = np.concatenate(([0], np.cumsum([n for _, n in counts], dtype=np.int64)))
    offsets = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(counts, before, strict=False)], "__part long, __before long")
    out = kept.join(F.broadcast(offsets), part == F.col("__part"))
    return out.select(*rows.columns, (place + F.col("__before")).alias(name)), int(before[-1])


def round_keys(seed: str, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}|{i}".encode()).digest()[:4], "big") & LOW for i in range(rounds)]


def half_bits(n: int) -> int:
    """Bits of each half of the network that permutes n numbers."""
    return max(1, (max(n, 1) - 1).bit_length() + 1 >> 1)


def positions(numbers: np.ndarray, n: int, seed: str = SEED) -> np.ndarray:
    """Where the permutation of 0..n-1 puts some numbers."""
    if n > 1 << 62:
        raise ValueError("row numbers have 62 bits at most")
    h, u = half_bits(n), np.uint64
    mask = u((1 << h) - 1)
    out = np.array(numbers, u)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> u(h), out[todo] & mask
        for k in round_keys(seed):
            x = (right ^ u(k)) * u(MULTIPLY[0])
            x = ((x ^ (x >> u(29))) & u(LOW)) * u(MULTIPLY[1])
            left, right = right, left ^ ((x ^ (x >> u(31))) & mask)
        out[todo] = (left << u(h)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_rows(rows: DataFrame, order: Sequence[str], shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """rows with shard and slot. order: the columns that number the rows."""
    if shards < 1:
        raise ValueError("at least one shard")
    rows = rows.select(*[c for c in rows.columns if c.lower() not in ("shard", "slot")])
    numbers, n = numbered(rows, order, "__number")

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(positions(x.to_numpy(), n, seed))

    p = F.col("__position")
    placed = numbers.withColumn("__position", permuted("__number"))
    return placed.select(*rows.columns, (p % shards).cast("int").alias("shard"), F.floor(p / shards).cast("long").alias("slot") if n < 1 << 52 else F.expr(f"__position div {shards}").alias("slot"))


def sized(documents: DataFrame) -> DataFrame:
    """documents with size (UTF-8 bytes of the text and 8) and text_crc32."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [c for c in documents.columns if c.lower() not in ("size", "text_crc32")]
    return documents.select(*kept, (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def shard_documents(documents: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """documents, all columns kept, with size, text_crc32, shard and slot; numbered by doc_id, size and checksum."""
    return shard_rows(sized(documents), ("doc_id", "size", "text_crc32"), shards, seed)


def write_shards(sharded: DataFrame, path: str) -> None:
    """The rows in slot order, a folder a shard. A shard's rows lie in as many files as its size needs."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)


def _round_sql(key: int, side: str, other: str) -> str:
    x = f"(xor({side}, {key}) * {MULTIPLY[0]})"
    x = f"((xor({x}, {x} >> 29) & {LOW}) * {MULTIPLY[1]})"
    return f"xor({other}, xor({x}, {x} >> 31) & m)"


def _walk_sql(source: str, x: str) -> str:
    """One application of the network to x of source, whose columns m and h are the mask and bits of a half."""
    sql = f"(SELECT number, n, h, m, {x} >> h AS l0, {x} & m AS r0 FROM {source})"
    for i, key in enumerate(round_keys(SEED)):
        sql = f"(SELECT number, n, h, m, r{i} AS l{i + 1}, {_round_sql(key, f'r{i}', f'l{i}')} AS r{i + 1} FROM {sql})"
    return f"SELECT number, n, h, m, (l{ROUNDS} << h) | r{ROUNDS} AS x FROM {sql}"


def sql() -> str:
    return f"""
WITH RECURSIVE crc_step AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
  crc AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
  d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]))) END AS text_crc32 FROM documents, crc),
  r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM d),
  s AS (SELECT number, n, number AS x, h, (1::BIGINT << h) - 1 AS m FROM (SELECT number, n, (SELECT min(b) FROM range(1, 32) t(b) WHERE 1::HUGEINT << (2 * b)::INT >= n)::INT AS h FROM r)),
  walk AS (({_walk_sql("s", "x")}) UNION ALL ({_walk_sql("(SELECT * FROM walk WHERE x >= n)", "x")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard, (x // {SHARDS})::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN walk USING (number) WHERE walk.x < walk.n
"""
