"""Match tables on storage: a folder a kind, partitioned by source and demo_id; catalog, splits, sinks, caches.

Everything goes through Spark's readers and writers, so any store that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import split_of
from ..session import stored
from . import schemas


class MatchStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- tables

    def write(self, table: str, df: DataFrame) -> None:
        """Replaces the matches that df holds and leaves all others (a partial refresh is the same call)."""
        rows = schemas.conform(df, table).sortWithinPartitions("demo_id", *(c for c in ("round_num", "tick") if c in df.columns))
        rows.write.partitionBy("source", "demo_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/{table}")

    def read(self, table: str, sources: Sequence[str] | None = None, demos: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """A table; sources prune folders, demos (with demo_id) is a semi-join, columns are projected in the scan."""
        try:
            df = self.spark.read.schema(f"{schemas.TABLES[table]}, {schemas.KEYS}").parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = schemas.empty(self.spark, table)
        if sources is not None:
            df = df.where(F.col("source").isin(*sources))
        if demos is not None:
            df = df.join(demos.select("demo_id"), "demo_id", "left_semi")
        return df.select("source", "demo_id", *columns) if columns is not None else df

    def refresh(self, table: str, derive: Callable[[DataFrame], DataFrame], demos: DataFrame | None = None) -> None:
        """Makes a table's rows anew from themselves, for all matches or those of demos (with demo_id); all others stay. The
        rows are stored before their files are replaced."""
        rows = stored(self.read(table, demos=demos), "refresh")
        self.write(table, derive(rows))

    # -- catalog

    def write_meta(self, meta: DataFrame) -> None:
        meta.write.mode("append").json(f"{self.root}/meta")

    def demos(self, splits: Sequence[str] | None = None, sources: Sequence[str] | None = None, listed: Sequence[DataFrame] = ()) -> DataFrame:
        """The catalog with each match's split: that of the last list that names it, else its hash's."""
        try:
            meta = self.spark.read.schema(schemas.META).json(f"{self.root}/meta").dropDuplicates(["source", "demo_id"])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            meta = self.spark.createDataFrame([], schemas.META)
        named = None
        for i, d in enumerate(listed):
            d = d.select("demo_id", F.struct(F.lit(i).alias("i"), "split").alias("s"))
            named = d if named is None else named.unionByName(d)
        if named is not None:
            last = named.groupBy("demo_id").agg(F.max("s").alias("s")).select("demo_id", F.col("s.split").alias("named"))
            meta = meta.join(last, "demo_id", "left")
        else:
            meta = meta.withColumn("named", F.lit(None).cast("string"))
        out = meta.withColumn("split", F.coalesce("named", split_of(F.col("demo_id")))).drop("named")
        if splits is not None:
            out = out.where(F.col("split").isin(*splits))
        return out.where(F.col("source").isin(*sources)) if sources is not None else out

    def todo(self, found: DataFrame) -> DataFrame:
        """The matches of found (source, demo_id) that have no meta row yet."""
        return found.join(self.demos().select("source", "demo_id"), ["source", "demo_id"], "left_anti")

    # -- models

    def save_model(self, name: str, parts: Mapping[str, DataFrame]) -> None:
        for part, df in parts.items():
            df.write.mode("overwrite").parquet(f"{self.root}/models/{name}/{part}")

    def load_part(self, name: str, part: str) -> DataFrame | None:
        """A part of a model; None if it was never fitted."""
        return read_if_there(self.spark, f"{self.root}/models/{name}/{part}")


def model_name(sources: Sequence[str]) -> str:
    return "+".join(sorted(sources))


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table at path; None if there is none. Only with a schema may its folders be without files."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_splits(spark: SparkSession, path: str, key: str = "demo_id") -> DataFrame:
    """(demo_id, split) of a CSV with a header."""
    return spark.read.option("header", True).csv(path).select(F.col(key).alias("demo_id"), "split")


def wanted_entries(names: DataFrame, map_name: str) -> DataFrame:
    """names (path) of the recordings of one map in match archives, with the match's number in the series."""
    number = F.regexp_extract(F.lower("path"), rf"-m(\d+)-{map_name}\.dem$", 1)
    return names.withColumn("number", number).where("number <> ''").withColumn("number", F.col("number").cast("int"))


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_answers(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_answers(spark: SparkSession, path: str, schema: str, key: str = "key", answers: str = "answers", order: str = "written") -> DataFrame:
    """The cache's last answered row of each key."""
    rows = spark.read.schema(schema).json(path).where(F.col(answers).isNotNull())
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("__r")).select(key, "__r.*")


def once(spark: SparkSession, path: str, make) -> DataFrame:
    """What make() gives, computed at the first call and read at later ones."""
    found = read_if_there(spark, path)
    if found is None:
        make().write.parquet(path)
        found = spark.read.parquet(path)
    return found
