"""What several queries share: the event table as a stream of sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

HOUR = 3_600_000_000
DAY = 24 * HOUR

#: SQL of sightings(), as a common table expression named e.
E = """e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS cell FROM events)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("cell"))


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*columns)
