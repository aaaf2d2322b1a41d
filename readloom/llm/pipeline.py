"""What the stages of the corpus pipeline share: each keeps the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm.common import short_batches

ship(__name__)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    from readloom.llm.queries import read
    from readloom.llm.quality_classifier import accepted, fit_rules

    return accepted(docs, fit_rules(docs, read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated lines removed; n_chars follows the text."""
    short_batches(spark)
    from readloom.llm.line_dedup import dedup_lines

    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = dedup_lines(docs, carry=others).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*[c for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked at a similarity of 0.80 (op7 has 0.85 of its own)."""
    short_batches(spark)
    from readloom.llm.near_dup import near_duplicates

    gone = near_duplicates(docs, num=80, den=100).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    from readloom.llm.decontam import clean_documents
    from readloom.llm.queries import read

    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their places in the sequences."""
    short_batches(spark)
    from readloom.llm.packing import pack_documents
    from readloom.llm.queries import vocabulary

    return pack_documents(docs, vocabulary())
