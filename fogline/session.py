"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume (UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fogline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def held(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none and the master is local, a temporary folder is set; on a cluster that is an
    error, as a folder of one machine would not do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    path = spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), "fogline-checkpoints")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext.getCheckpointDir()
    return path


#: Tables written by stored() in this process, by application.
_WRITTEN: dict[str, list[str]] = {}


def stored(df: DataFrame, label: str = "step", compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back; compression: a codec in place of the session's.

    Cuts the lineage, so that a lost executor costs only the stage it was working on, and lets
    the shuffle files of the finished stages go. The table is deleted when the driver's JVM ends, or before that by
    discard() or clear_stored().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fogline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask the driver to drop what finished stages left (their shuffle files)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() has written, once all that is read from it is stored itself."""
    spark = df.sparkSession
    written, files = _WRITTEN.get(spark.sparkContext.applicationId, []), df.inputFiles()
    for path in [p for p in written if files and f"/{p.rsplit('/', 1)[1]}/" in files[0]]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        written.remove(path)


def clear_stored(spark: SparkSession) -> int:
    """Deletes the tables that stored() has written for this application; their DataFrames can no longer be read."""
    jvm, gone = spark.sparkContext._jvm, 0
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return gone
