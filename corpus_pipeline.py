"""A training corpus from `documents`, in five stages, each over all that the one before kept.

Quality classifier, line dedup, near-duplicate removal, benchmark
decontamination, packing. `run` writes each stage's rows as Parquet into the
folder that spark.checkpoint.dir names and reads them again, so a lost executor
costs at most a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import pipeline
from readloom.llm.common import Scratch, made, tidy

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", pipeline.quality),
    ("line_dedup", pipeline.lines),
    ("minhash_near_dedup", pipeline.near),
    ("benchmark_decontamination", pipeline.decontaminate),
    ("best_fit_packing", pipeline.pack),
]

ORACLE_SQL = None  # trained models, tokens and edit distances; tests/llm/test_pipeline.py holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents of one folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, first = None, made()
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        tidy(first)  # what the stage itself wrote between its steps
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
