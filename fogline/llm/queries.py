"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import mixing, neardup, phrases, sharding, substrings, topk, urls
from .html import extract_main_text
from .mixing import mix_sources
from .neardup import near_duplicates
from .packing import pack
from .phrases import mine_phrases
from .quality import fit_quality, judge_quality
from .secrets import find_secrets, span_text
from .substrings import remove_repeats
from .topk import integer_vectors, top_k
from .toxicity import fit_grammar, score_toxicity
from .urls import judge_urls

#: (verdict, host and path prefix) of op9's contract.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("id % 50 = 0"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_quality(documents, table(spark, sf_dir, "labels"))
    judged = judge_quality(documents.select("doc_id", "text"), model)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text("base_spans"), 256).alias("base_sha256"), span_text("all_spans").alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit_grammar(documents, table(spark, sf_dir, "labels"))
    return score_toxicity(documents, grammar).select("doc_id", "held_out", "score", "predicted")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # of the texts only size and checksum are carried; shard_documents() keeps whatever columns it is given
    sized = sharding.sized(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32")
    sharded = sharding.shard_rows(sized, ("doc_id", "size", "text_crc32"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_exact_topk, op3_quality_rules, op4_secret_scans, op5_packing, op6_substring_dedup, op7_toxicity, op8_source_mixing, op9_url_filters, op10_near_duplicates, op11_phrases, op12_sharding)
}
#: The others rest on a classifier, a tokenizer, tree alignment or real-valued tests; brute force tests them.
SQL: dict[str, str] = {"op2_exact_topk": topk.SQL, "op6_substring_dedup": substrings.SQL, "op10_near_duplicates": neardup.SQL, "op8_source_mixing": mixing.SQL, "op9_url_filters": urls.sql(), "op11_phrases": phrases.SQL, "op12_sharding": sharding.sql()}
