"""From raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.llm.mixing import mix_sources
from fogline.llm.neardup import drop_near_duplicates
from fogline.llm.packing import pack
from fogline.llm.quality import fit_quality, judge_quality
from fogline.llm.secrets import find_secrets, redact
from fogline.session import stored, table


USED = ("doc_id", "text", "source", "n_chars")


def _beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs; those that no stage uses are out of the way of the operators' own names."""
    aside = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c.lower() not in USED}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules accept."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return _beside(docs, lambda d: judge_quality(d, model).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows the text."""

    def stage(d: DataFrame) -> DataFrame:
        redacted = redact(find_secrets(d))
        if "n_chars" not in d.columns:
            return redacted
        changed = F.when(F.size("all_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
        return redacted.withColumn("n_chars", changed.cast(d.schema["n_chars"].dataType))

    return _beside(docs, stage)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their target weights, in global random order."""
    return _beside(docs, mix_sources)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into pieces and packs them into sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express the classifier, the registers or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
