"""Recordings of matches: files that a decoder turns into the match tables, each by itself.

Files lie under root/source=.../demo_id=.../ in any store that Spark reads; Spark lists and reads them whole, so filters on
source and demo_id prune folders before a byte is read. A decoder is a function of a file's bytes that yields (table,
row), rows being dictionaries and one of them in the table `meta`; jsonl() is one, for recordings exported as JSON lines.
A file that cannot be decoded stops nothing: none of its rows are kept, and the reason is written to the quarantine of the
store. An empty file has not arrived yet: Spark does not list it.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import held, stored
from . import schemas
from .store import MatchStore, read_if_there

Decoder = Callable[[bytes], Iterator[tuple[str, dict]]]
DECODED = "source string, demo_id string, table string, row string, error string"
#: Decoded rows that a worker holds before it sends them on.
SENT = 20_000
QUARANTINE = "file string, reason string, source string, demo_id string"


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """(source, demo_id, path, content); only what is selected is read."""
    return spark.read.format("binaryFile").load(root).select(F.col("source").cast("string").alias("source"), F.col("demo_id").cast("string").alias("demo_id"), "path", "content")


def jsonl(content: bytes) -> Iterator[tuple[str, dict]]:
    """Lines of JSON objects with their table's name in `table`; the last line is of the table `end`, so that a recording
    which broke off is told from a whole one."""
    ended = False
    for line in _lines(content.decode()):
        if not line.strip():
            continue
        if ended:
            raise ValueError("lines after the end")
        row = json.loads(line)
        table = row.pop("table")
        if table == "end":
            ended = True
        elif table == "meta" or table in schemas.TABLES:
            yield table, row
        else:
            raise ValueError(f"no table {table}")
    if not ended:
        raise ValueError("truncated")


def _lines(text: str) -> Iterator[str]:
    """text.splitlines() without a list of all lines."""
    at = 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        yield from text[at:end].splitlines()
        at = end


def decoded(files: DataFrame, decoder: Decoder) -> DataFrame:
    """DECODED: the rows of all files as JSON by table, and a row with error for a file that failed, after those before
    the fault; written to the shared folder, one file at a time in a worker, SENT rows at a time."""
    names = [c.split()[0] for c in DECODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, demo, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):

                def sent(tables: list, rows: list, error: str | None = None) -> pa.RecordBatch:
                    n = len(tables)
                    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([source] * n, [demo] * n, tables, rows, [error] * n)], names=names)  # noqa: B023

                each = None
                while True:
                    tables, rows, error = [], [], None
                    try:
                        each = iter(decoder(content)) if each is None else each
                        for table, row in itertools.islice(each, SENT):
                            rows.append(json.dumps(row))
                            tables.append(table)
                    except Exception as e:  # a broken recording is no reason to stop the others
                        error = f"{type(e).__name__}: {e}"[:300]
                    if tables:
                        yield sent(tables, rows[: len(tables)])
                    if error is not None:
                        yield sent([None], [None], error)
                    if error is not None or len(tables) < SENT:
                        break

    with held(files.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        return stored(files.select("source", "demo_id", "content").mapInArrow(run, DECODED), "decoded")


def ingest(store: MatchStore, root: str, decoder: Decoder = jsonl) -> tuple[DataFrame, DataFrame]:
    """Decodes the recordings that the store has no meta row of, and writes their tables. (source, demo_id) of the matches
    read, and (source, demo_id, file, reason) of those that failed; a failed one is tried again by the next call, and
    leaves the quarantine once it can be read."""
    files = recordings(store.spark, root)
    todo = store.todo(files.select("source", "demo_id").distinct())
    rows = decoded(files.join(F.broadcast(todo), ["source", "demo_id"], "left_semi"), decoder)  # two strings a match
    failed = rows.where("error is not null").select("source", "demo_id", F.col("error").alias("reason")).dropDuplicates(["source", "demo_id"])
    bad = stored(failed.join(files.groupBy("source", "demo_id").agg(F.min("path").alias("file")), ["source", "demo_id"]).select("file", "reason", "source", "demo_id"), "failed")
    # a broken recording's rows before the fault go too
    broken = bad.select(F.col("source").alias("__source"), F.col("demo_id").alias("__demo"))
    good = rows.where("error is null").join(broken, F.col("source").eqNullSafe(F.col("__source")) & F.col("demo_id").eqNullSafe(F.col("__demo")), "left_anti")
    for table, schema in schemas.TABLES.items():
        own = good.where(F.col("table") == table).select("source", "demo_id", F.from_json("row", schema).alias("r")).select("source", "demo_id", "r.*")
        store.write(table, own)
    bad.write.partitionBy("source", "demo_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{store.root}/quarantine")
    # a match counts as read once its meta row is there, so that comes last
    meta = good.where("table = 'meta'").dropDuplicates(["source", "demo_id"])
    columns = [c.split()[0] for c in schemas.META.split(", ")]
    told = meta.select("source", "demo_id", F.from_json("row", schemas.META).alias("r")).select(*(F.col(c) if c in ("source", "demo_id") else F.col(f"r.{c}").alias(c) for c in columns))
    told = stored(told, "meta")
    store.write_meta(told)
    return told.select("source", "demo_id"), bad.select("source", "demo_id", "file", "reason")


def quarantined(store: MatchStore) -> DataFrame:
    """(source, demo_id, file, reason) of the recordings that could not be read so far."""
    found = read_if_there(store.spark, f"{store.root}/quarantine", QUARANTINE)
    if found is None:
        found = store.spark.createDataFrame([], QUARANTINE)
    return found.join(store.demos().select("source", "demo_id"), ["source", "demo_id"], "left_anti").select("source", "demo_id", "file", "reason")
