"""The flagship query: how long a sighting stays true."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .registry import query


@query(
    """
    WITH e AS (
      SELECT event_id, user_id, epoch_us(ts) AS us, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS cell
      FROM events),
    f AS (
      SELECT *, last_value(CASE WHEN event_type = 'view' THEN us END IGNORE NULLS) OVER w AS seen_us,
             last_value(CASE WHEN event_type = 'view' THEN cell END IGNORE NULLS) OVER w AS seen_cell
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (
      SELECT *, (us - seen_us) / 3600e6 AS hours FROM f)
    SELECT CASE WHEN hours IS NULL THEN 'never' WHEN hours < 24 THEN '0-24h' WHEN hours < 96 THEN '24-96h'
                WHEN hours < 240 THEN '96-240h' ELSE '240h+' END AS horizon,
           count(*) AS n, round(avg(CASE WHEN seen_cell = cell THEN 1.0 WHEN seen_cell IS NOT NULL THEN 0.0 END), 6) AS still_there
    FROM s GROUP BY 1
    """
)
def horizon_still_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly earlier forward fill of the last sighting, binned by its age."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("cell"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("event_type") == "view"
    f = e.withColumn("seen_us", F.last(F.when(seen, F.col("us")), True).over(w)).withColumn("seen_cell", F.last(F.when(seen, F.col("cell")), True).over(w))
    hours = (F.col("us") - F.col("seen_us")) / 3600e6
    label = F.when(hours.isNull(), "never").when(hours < 24, "0-24h").when(hours < 96, "24-96h").when(hours < 240, "96-240h").otherwise("240h+")
    still = F.when(F.col("seen_cell") == F.col("cell"), 1.0).when(F.col("seen_cell").isNotNull(), 0.0)
    return f.groupBy(label.alias("horizon")).agg(F.count("*").alias("n"), F.round(F.avg(still), 6).alias("still_there"))
