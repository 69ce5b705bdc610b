"""What the jobs share: settings, patterns for file streams, logging, and the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(job: str, spark: SparkSession | None = None, path: str = "") -> dict:
    """The settings that come with a job, and over them those of a JSON file that Spark reads."""
    found = json.loads(Path(__file__).with_name(f"{job}.json").read_text())
    if path:
        own = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        unknown = set(own) - set(found)
        if unknown:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        found |= own
    return found


def pattern(path: str) -> str:
    """A pattern that matches just this file or folder, which a file stream takes for either."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def counted(df: DataFrame, *keys: str) -> str:
    """Rows by a few columns of small domains, for the log."""
    rows = df.groupBy(*keys).count().orderBy(*keys).limit(100).collect()
    return ", ".join("/".join(str(r[k]) for k in keys) + f" {r['count']}" for r in rows) or "nothing"


def main(job: str, run, inputs: dict[str, str]) -> None:
    """The command line: one argument an input, the output folder, and settings; the only place that makes a session."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for name, says in inputs.items():
        parser.add_argument(name, help=says)
    parser.add_argument("out", help="folder of the output, of any store that Spark reads")
    parser.add_argument("--config", default="", help="JSON file with other settings")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *(args[name] for name in inputs), args["out"], settings(job, spark, args["config"]))
    finally:
        spark.stop()
