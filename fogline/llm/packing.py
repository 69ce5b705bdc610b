"""Packing documents into sequences of at most 1024 tokens: shortest-pack-first over the length histogram.

A document is its byte-level BPE ids and one id 0. It is cut at every multiple of 1024; whole pieces are sequences of
their own, and the rest of each document is a piece to pack. The histogram of piece lengths (at most 1023 counts) is
packed on the driver: lengths are placed longest first, each into the packing pattern with the most room left (the
shortest pack), a pattern's count being split as pieces run out; a length that fits nowhere opens new patterns. The
patterns give, for each length, intervals of piece ranks with their sequence ids and offsets. Pieces get a global rank
within their length from a rank within their partition and the counts of the partitions before, which needs no sort
and brings no length together in one task.

Defined cases: a null or empty text is one piece holding id 0; repeated rows are packed one by one; doc_id may be null.
The ids are those of the tokenizers library; texts that hold a special token's string are encoded by that library, all
others by the faster equal implementation of tiktoken over the same vocabulary (the tests compare both).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .text import small_batches

LENGTH = 1024
VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
END = 0
#: A run of so many equal bytes goes to the tokenizers library, whose splitting does not backtrack.
LONG_RUN = 20_000

PIECE = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long"

_ENCODERS: dict[str, tuple] = {}


def _encoders(vocabulary: str | None):
    """The exact encoder and a fast one for texts without special tokens, of a vocabulary file."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in entries.items() if token != SPECIAL}
        _ENCODERS[path] = exact, tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def encode(text: str, vocabulary: str | None = None) -> list[int]:
    """The ids of a whole text, without special tokens added."""
    exact, fast = _encoders(vocabulary)
    if SPECIAL in text or len(text) > LONG_RUN and _long_run(text):
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def _long_run(text: str) -> bool:
    """Whether a stretch of LONG_RUN characters holds no change between blank and other characters."""
    data = np.frombuffer(text.encode(), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(blank))
    return bool(np.diff(np.concatenate(([-1], edges, [len(data) - 1]))).max() >= LONG_RUN)


def pieces(documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their rank within length and partition; with keep_ids also their ids."""
    small_batches(documents.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ranks = [0] * (length + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(6 + keep_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or "", vocabulary), END], "<u4")
                for a in range(0, len(ids), length):
                    own = ids[a : a + length]
                    row = (doc, a, len(own), zlib.crc32(own.tobytes()), len(ids), ranks[len(own)], own.tolist())
                    ranks[len(own)] += 1
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
            columns = [pa.array(c, pa.int64()) for c in out[:6]]
            if keep_ids:
                columns.append(pa.array(out[6], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out[0]), part, np.int32)), *columns], names=[x.split()[0] for x in PIECE.split(", ")] + ["ids"] * keep_ids)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE + ", ids array<long>" * keep_ids)


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(number of sequences, piece lengths longest first) of each packing pattern."""
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []  # a heap of the rooms in by_room, largest first

    def keep(count: int, pattern: list[int]) -> None:
        room = length - sum(pattern)
        if room not in by_room:
            by_room[room] = []
            heapq.heappush(rooms, -room)
        by_room[room].append((count, pattern))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, placed = counts[size], []
        while left and rooms and -rooms[0] >= size:
            room = -rooms[0]
            count, pattern = by_room[room].pop()
            used = min(count, left)
            left -= used
            if count > used:
                by_room[room].append((count - used, pattern))
            if not by_room[room]:
                del by_room[room]
                heapq.heappop(rooms)
            placed.append((used, [*pattern, size]))
            if length - sum(pattern) - size >= size and left:
                keep(*placed.pop())  # the pack may take another piece of this length
        if left:
            each = length // size
            if left // each:
                placed.append((left // each, [size] * each))
            if left % each:
                placed.append((1, [size] * (left % each)))
        for x in placed:
            keep(*x)
    return [x for group in by_room.values() for x in group]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Intervals of ranks: pieces of `size` with rank >= first (up to the next interval) go to sequences from `sequence` on, at `offset`."""
    rows, base = [], 0
    seen: dict[int, int] = {}
    for count, pattern in patterns:
        at = 0
        for size in pattern:
            first = seen.get(size, 0)
            rows.append((size, first, base, at))
            seen[size] = first + count
            at += size
        base += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Every piece of documents with sequence_id and offset; see the module's text."""
    cut = stored(pieces(documents, vocabulary, length, keep_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", "length", before.alias("before"))
    # one row for each length, 1024 at most
    patterns = pack_histogram({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}, length)
    table = slots(patterns)
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name not in ("part", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(table["key"], (size << 48) + rank, "right") - 1
            extra = [pa.array(table["sequence"][i] + rank - table["first"][i]), pa.array(table["offset"][i])]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*names, "sequence_id", "offset"])

    ranked = cut.join(offsets, ["part", "length"]).select(*[x.split()[0] for x in columns], (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, ", ".join([*columns, "sequence_id long", "offset long"]))
