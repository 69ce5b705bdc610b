"""Substring dedup by content-defined blocks and a window join, in place of a greedy relative Lempel-Ziv parse.

A factor is a stretch of a document that occurs at another place of the corpus; stretches of WINDOW words or more,
however long, are removed wherever they occur. The index makes every text a reference of every other:

- Anchors. In each window of WINDOW words the least hash among its runs of ANCHOR words is its anchor. Consecutive
  windows with the same anchor form one block, so equal stretches fall into equal blocks, up to those at their ends.
- Reference blocks. A block is keyed by its anchor and a hash of all its words. Blocks met twice or more are factors
  as a whole. No text is parsed greedily: matched blocks and windows are joined by hash and their stretches united.
- Factor boundaries. Where an anchor is known but the block around it is not, a factor begins or ends inside the
  block. Only there, the single windows are looked up among the windows of all blocks with this anchor.

So the table of anchors is a fraction (2 in 29) of the words, single windows are looked up at the ends of factors only,
and what a passage in very many documents costs grows with its occurrences, not with their pairs. Groups are
aggregated with partial sums and joined back; no anchor's occurrences meet in one task.

Words are compared by hashes of 64 bits for anchors together with 64 bits for blocks or for windows (an accidental
match needs both; among N different windows under one anchor about N * N / 2**65 pairs, 4e-5 at 4e7 windows). A window that repeats inside one document is removed at both places. Windows are judged
on the input. Defined cases: null, empty and short texts lose nothing; repeated rows are each other's copies; doc_id
may be null or repeated. Columns other than doc_id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, release, stored
from .text import Chunk, U, chunks, grams, runs, small_batches

WINDOW = 35
ANCHOR = 8


def blocks(chunk: Chunk, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """The blocks of a chunk's texts: row, start (word of the text), windows, kg, b; and w, the 64-bit hashes of all
    windows in order."""
    words, first = chunk.word_hashes(), chunk.first
    at, hashes = grams(words, first, window)
    if not len(at):
        return {k: np.zeros(0, np.int64) for k in ("row", "start", "windows", "kg", "b", "w")}
    n = len(words) - anchor + 1
    everywhere = np.arange(n)
    kgrams = runs(words, everywhere, everywhere + anchor)
    low = (kgrams & U(0xFFFFFFFF00000000)) | everywhere.astype(U)
    span, width = window - anchor + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        rest = span - width
        low = np.minimum(low[: len(low) - rest], low[rest:])
    place = (low[at] & U(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(at)))
    start = at[begin]
    return {
        "row": chunk.rows[text[begin]],
        "start": start - first[text[begin]],
        "windows": many,
        "kg": kgrams[place[begin]].view(np.int64),
        "b": runs(words, start, start + many + window - 1, 1).view(np.int64),
        "w": hashes.view(np.int64),
    }


def _keys(window: int, anchor: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found = blocks(chunk, window, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(found["kg"]), pa.array(found["b"]), batch.column(0).take(pa.array(found["row"]))], names=["kg", "b", "id"])

    return keys


def _places(window: int, anchor: int):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found = blocks(chunk, window, anchor)
                rows = pa.array(found["row"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(found["windows"])).astype(np.int32)), pa.array(found["w"].astype(np.int64, copy=False)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found["start"].astype(np.int32)), pa.array(found["windows"].astype(np.int32)), pa.array(found["kg"]), pa.array(found["b"]), lists], names=["id", "th", "s", "m", "kg", "b", "win"])

    return places


def repeated_windows(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, th, spans): for each text with repeats its runs (s, m) of m window starts from word s whose windows occur
    elsewhere; id is doc_id (-1 for null), th a hash of the text."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), "text")
    counted = docs.mapInArrow(_keys(window, anchor), "kg long, b long, id long").groupBy("kg", "b").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    counted = stored(counted, "blocks")
    release(spark)
    of_anchor = counted.groupBy("kg").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.min("n").alias("least")).where("total > 1")
    index = stored(counted.join(of_anchor, "kg").select("kg", "b", "n", "rep", F.expr("kinds > 1 and least = 1").alias("ends")).where("n > 1 or ends"), "index")
    discard(counted)
    release(spark)

    placed = docs.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(_places(window, anchor), "id long, th long, s int, m int, kg long, b long, win array<long>")
    met = placed.join(index, ["kg", "b"])
    hits = stored(met.select("id", "th", "s", "m", "kg", F.expr("n > 1").alias("whole"), F.expr("case when ends and (n = 1 or id = rep) then win end").alias("win")), "hits")
    discard(index)
    release(spark)
    single = hits.where("win is not null").select("id", "th", "s", "kg", "whole", F.posexplode("win").alias("i", "w"))
    known = single.groupBy("kg", "w").agg(F.sum(F.when(F.col("whole"), 2).otherwise(1)).alias("n")).where("n > 1").select("kg", "w")
    ends = stored(single.where("not whole").join(known, ["kg", "w"]).select("id", "th", F.expr("s + i").alias("s"), F.lit(1).alias("m")), "ends")
    release(spark)
    whole = hits.where("whole").select("id", "th", "s", "m")
    # copies of a row have equal spans, which meet before the shuffle
    return whole.unionAll(ends).groupBy("id", "th").agg(F.collect_set(F.struct("s", "m")).alias("spans"))


def remove_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, spans (covered words, as starts and ends) and kept_text of every row."""
    spans = repeated_windows(documents, window, anchor)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = docs.join(spans, (F.coalesce("doc_id", F.lit(-1)) == F.col("id")) & (F.xxhash64("text") == F.col("th")), "left")
    flat = joined.select("doc_id", "text", F.col("spans.s").alias("s"), F.col("spans.m").alias("m"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            total, gone, kept, spans = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n, [[]] * n
            starts, counts = batch.column(2), batch.column(3)
            for chunk in chunks(batch.column(1)):
                for i, row in enumerate(chunk.rows):
                    a, b = chunk.first[i], chunk.first[i + 1]
                    total[row] = b - a
                    text = chunk.data[chunk.bounds[i] : chunk.bounds[i + 1]]
                    if starts[row].is_valid:
                        s, m = starts[row].values.to_numpy(), counts[row].values.to_numpy()
                        edge = np.zeros(b - a + 1, np.int64)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + m + window - 1, -1)
                        cover = np.cumsum(edge[:-1]) > 0
                        gone[row] = cover.sum()
                        cut = np.flatnonzero(np.diff(np.concatenate(([0], cover.view(np.int8), [0]))))
                        spans[row] = cut.tolist()
                        # blank out the removed words; splitting then leaves the others
                        text = text.copy()
                        base = chunk.bounds[i]
                        for x, y in cut.reshape(-1, 2):
                            text[chunk.start[a + x] - base : chunk.end[a + y - 1] - base] = 32
                    kept[row] = b" ".join(text.tobytes().split()).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(gone), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return flat.mapInArrow(removed, "doc_id long, n_words long, n_removed long, spans array<long>, kept_text string")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM p) WHERE n > 1),
covered AS (SELECT DISTINCT r, i + k AS j FROM c, range({WINDOW}) t(k)),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM x ANTI JOIN covered USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
