"""The opN queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm.common import short_batches

ship(__name__)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.html_extract import extract_pages

    return extract_pages(read(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.quality_classifier import fit_rules, score_quality

    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, fit_rules(docs, read(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), vocabulary())


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.decontam import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.line_dedup import dedup_lines

    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.quality_rules import apply_rules, fit_rules

    docs = read(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, read(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "tree_score"
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.near_dup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.suffix_dedup import repeated_passages

    return repeated_passages(read(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.license_scan import plain_sample, scan_licenses, train

    docs = read(spark, sf_dir, "documents")
    return scan_licenses(docs, train(plain_sample(docs)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.llm.sharding import shard_documents

    out = shard_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_quality_classifier, op3_best_fit_packing, op4_benchmark_decontamination, op5_line_dedup, op6_quality_rules, op7_minhash_near_dedup, op8_suffix_dedup, op9_license_scans, op10_sharding)
}
