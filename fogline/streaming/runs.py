"""Streams of sightings: windows, sessions, keyed state.

A stream is read from files, transformed with event-time watermarks and written by foreachBatch to the shared folder,
so it runs on a cluster without a driver-side sink. Runs use availableNow: they process what is there and stop; the
same plans run continuously with another trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, late: str = "3650 days") -> DataFrame:
    """The events as a stream with a watermark; props.k is the cell. File order is no time order, so by default nothing
    of a finished table is late."""
    path = f"{sf_dir}/event[s].parquet"  # as a pattern, the table may be a file or a folder
    raw = spark.readStream.schema(EVENTS).parquet(path)
    e = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("cell"))
    return e.withWatermark("ts", late)


def new_base(spark: SparkSession) -> str:
    """A new folder for a stream's state and output."""
    return f"{shared_dir(spark).rstrip('/')}/fogline-stream-{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str = "update", base: str | None = None) -> DataFrame:
    """Runs a stream over all it has; its rows with the number of the batch that wrote them last. With the base of an
    earlier run of the same stream it goes on where that ended."""
    spark = stream.sparkSession
    base = base or new_base(spark)

    def write(batch: DataFrame, number: int) -> None:
        # the folder is named by the batch, so a batch that is run again replaces what it wrote
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/written={number}")

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    schema = stream.schema.add("batch", "integer")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/out/written=-1")
    return spark.read.schema(schema).parquet(f"{base}/out").drop("written")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key's row."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v")).select(*keys, "__v.*")


def tumbling_counts(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def last_seen(events: DataFrame) -> DataFrame:
    """(user_id, seen_us, cell, n): keyed state with the latest sighting, whatever order its rows come in."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, cell, n = state.get if state.exists else (-1, -1, 0)
        for rows in batches:
            n += len(rows)
            rows = rows[rows.event_type == "view"]
            if len(rows):
                top = rows.sort_values(["us", "event_id"]).iloc[-1]
                if top.us > seen:
                    seen, cell = int(top.us), int(top.cell)
        state.update((seen, cell, n))
        yield pd.DataFrame({"user_id": [key[0]], "seen_us": [seen], "cell": [cell], "n": [n]})

    keyed = events.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("us"), "cell")
    return keyed.groupBy("user_id").applyInPandasWithState(update, "user_id long, seen_us long, cell int, n long", "seen_us long, cell int, n long", "update", GroupStateTimeout.NoTimeout)
