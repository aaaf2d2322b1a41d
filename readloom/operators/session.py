"""Progress, cancellation and caching, by Spark's own means."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readloom import ship

ship(__name__)


def with_progress(df: DataFrame, name: str = "records") -> tuple[DataFrame, Observation]:
    """The same rows, counted as they pass; `observation.get` holds the count after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside can be ended from elsewhere with spark.interruptTag(tag)."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def kept(df: DataFrame) -> DataFrame:
    """A narrowed table that several queries read: in memory, on disk beyond it; unpersist() ends it."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
