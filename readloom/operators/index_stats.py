"""Counts and densities in table form, and from the index alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom import ship

ship(__name__)


def line_counts(reads: DataFrame) -> DataFrame:
    """Mapped records of each reference, by a scan."""
    return reads.groupBy("ref_id").agg(F.count_if(F.col("flags").bitwiseAND(4) == 0).alias("mapped"))


def density(linear: DataFrame, stats: DataFrame) -> DataFrame:
    """(ref_id, start, end, score) by window of 16,384 bases: the share of the file between two windows times the mapped count.

    linear: ref_id, window, block. The last window has no successor and no row.
    """
    w = Window.partitionBy("ref_id").orderBy("window")
    whole = Window.partitionBy("ref_id")
    rows = linear.withColumn("after", F.lead("block").over(w)).withColumn("total", F.max(F.struct("window", "block")).over(whole)["block"]).where(F.col("after").isNotNull())
    score = (F.col("after") - F.col("block")).cast("double") * F.col("mapped") / F.col("total")
    return rows.join(stats, "ref_id").select(
        "ref_id", (F.col("window") * 16384).cast("long").alias("start"), ((F.col("window") + 1) * 16384).cast("long").alias("end"), F.when(F.col("total") > 0, score).otherwise(0.0).alias("score")
    )


def name_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("name").agg(F.count("*").alias("n"))
