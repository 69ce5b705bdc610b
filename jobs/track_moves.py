"""Moves and transition counts from recordings as they arrive.

    python -m jobs.track_moves <events> <out> [--config settings.json]

Motion chains are fitted on how entities go from cell to cell. This job keeps the rows behind them: a file stream takes
the event files that no run has taken yet (its checkpoint, <out>/checkpoint, knows them), judges every row once, and
stops. Under <out>:

- moves/batch=N/outcome=.../split=...: every event with the cell its entity came from and the time between. Outcomes:
  `invalid` (no entity, time or known cell), `late` (not after what earlier batches hold of the entity), `repeat`
  (same entity, time and event as the row before), `first`, `break` (too long since the row before), `stay`, `move`.
  split is that of the entity, so that all rows of an entity fall to one side of a fit.
- marks/batch=N: the latest row of each entity of the batch, the high-water mark that the next batch goes on from.
- chains/batch=N: counts of (split, from_cell, cell) over stays and moves; chains of all batches add up.

A batch's folders carry its number and are replaced as a whole, and a batch reads marks of earlier batches only: a batch
that died half-way is done again with the same result, and a run without new files changes nothing. An entity's rows are
ordered within buckets of time and the buckets' ends are joined, so one entity's history is never one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fogline.functions.bins import split_of
from fogline.operators.counting import transitions
from fogline.sources.store import read_if_there
from fogline.streaming.runs import EVENTS
from jobs.common import counted, log, main, pattern, settings

HOUR = 3_600_000_000
AT = "struct(us, event_id, cell)"
MOVES = "event_id long, user_id long, us long, cell int, from_cell int, gap_us long, outcome string, split string"
CHAINS = "split string, from_cell int, cell int, n long"
MARKS = "user_id long, us long, event_id long, cell int"


def parsed(events: DataFrame, cells: int) -> DataFrame:
    cell = F.get_json_object("props", "$.k").try_cast("int")
    e = events.select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), cell.alias("cell"))
    valid = F.col("event_id").isNotNull() & F.col("user_id").isNotNull() & F.col("us").isNotNull() & F.coalesce(F.col("cell").between(0, cells - 1), F.lit(False))
    return e.withColumn("valid", valid)


def judged(events: DataFrame, marks: DataFrame, conf: dict) -> DataFrame:
    """Every event with its outcome; marks: the last accepted row of each entity (user_id, us, event_id, cell)."""
    last = marks.groupBy("user_id").agg(F.max(F.expr(AT)).alias("mark"))
    rows = parsed(events, conf["cells"]).join(last, "user_id", "left")
    not_after = F.coalesce(F.expr("struct(us, event_id) <= struct(mark.us, mark.event_id)"), F.lit(False)) & F.col("mark").isNotNull()
    kind = F.when(~F.col("valid"), "invalid").when(not_after, "late").otherwise("fresh")
    rows = rows.select("*", kind.alias("kind"), F.expr(f"us div {int(conf['bucket_hours'] * HOUR)}").alias("bucket"), F.expr(AT).alias("at"))
    within = Window.partitionBy("user_id", "bucket", "kind").orderBy("at")
    rows = rows.withColumn("before", F.lag("at").over(within))
    ends = rows.where("kind = 'fresh'").groupBy("user_id", "bucket").agg(F.max("at").alias("end"))
    ends = ends.select("user_id", "bucket", F.lag("end").over(Window.partitionBy("user_id").orderBy("bucket")).alias("earlier"))
    rows = rows.join(ends, ["user_id", "bucket"], "left")
    before = F.when(F.col("kind") == "fresh", F.coalesce("before", "earlier", "mark"))
    gap = F.col("us") - before["us"]
    outcome = (
        F.when(F.col("kind") != "fresh", F.col("kind"))
        .when(before.isNull(), "first")
        .when((gap == 0) & (before["event_id"] == F.col("event_id")), "repeat")
        .when(gap > int(conf["most_gap_hours"] * HOUR), "break")
        .when(before["cell"] == F.col("cell"), "stay")
        .otherwise("move")
    )
    split = F.coalesce(split_of(F.col("user_id").cast("string")), F.lit("none"))
    return rows.select("event_id", "user_id", "us", "cell", before["cell"].alias("from_cell"), gap.alias("gap_us"), outcome.alias("outcome"), split.alias("split"))


def run(spark: SparkSession, events: str, out: str, conf: dict | None = None) -> DataFrame:
    """Takes the event files that are new and adds their moves, marks and counts; see the module's text."""
    conf, out = conf or settings("track_moves"), out.rstrip("/")

    def batch_done(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        marks = read_if_there(s, f"{out}/marks", f"{MARKS}, batch int")
        marks = s.createDataFrame([], MARKS) if marks is None else marks.where(F.col("batch") < number)
        path = f"{out}/moves/batch={number}"
        judged(batch, marks, conf).repartition("outcome", "split", F.pmod(F.hash("user_id"), F.lit(16))).write.mode("overwrite").partitionBy("outcome", "split").parquet(path)
        rows = s.read.schema(MOVES).parquet(path)
        fresh = rows.where("outcome not in ('invalid', 'late')")
        fresh.groupBy("user_id").agg(F.max(F.expr(AT)).alias("m")).select("user_id", "m.us", "m.event_id", "m.cell").write.mode("overwrite").parquet(f"{out}/marks/batch={number}")
        transitions(rows.where("outcome in ('stay', 'move')"), ["split"], "from_cell", "cell").write.mode("overwrite").parquet(f"{out}/chains/batch={number}")
        log.info("batch %d from %s: %s", number, events, counted(rows, "outcome", "split"))

    reader = spark.readStream.schema(EVENTS)
    if conf["files_a_batch"]:
        reader = reader.option("maxFilesPerTrigger", int(conf["files_a_batch"]))
    stream = reader.parquet(pattern(events)).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(batch_done).start()
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()
    rows = moves(spark, out)
    log.info("%s holds %s", out, counted(rows, "outcome"))
    return rows


def moves(spark: SparkSession, out: str) -> DataFrame:
    """The output so far: every event once."""
    found = read_if_there(spark, f"{out.rstrip('/')}/moves", f"{MOVES}, batch int")
    return spark.createDataFrame([], MOVES) if found is None else found.drop("batch")


def chains(spark: SparkSession, out: str) -> DataFrame:
    """(split, from_cell, cell, n) over all batches."""
    found = read_if_there(spark, f"{out.rstrip('/')}/chains", f"{CHAINS}, batch int")
    if found is None:
        return spark.createDataFrame([], CHAINS)
    return found.groupBy("split", "from_cell", "cell").agg(F.sum("n").alias("n"))


if __name__ == "__main__":
    main("track_moves", run, {"events": "folder or file of event Parquet"})
