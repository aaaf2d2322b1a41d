"""Region queries over any table of records, and joins of many regions with records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.functions.columns import end_position, overlaps

ship(__name__)


def in_range(ref: int | str, start: int, end: int) -> Column:
    """Whether a record of one reference (id, or name where the table has ref_name) overlaps [start, end)."""
    if start > end:
        raise ValueError(f"region {start}-{end}: its start is after its end")
    here = F.col("ref_name") == ref if isinstance(ref, str) else F.col("ref_id") == ref
    return here & (F.col("start") < F.lit(end).cast("long")) & overlaps(F.col("start"), F.col("end"), start, end)


def records_for_range(reads: DataFrame, ref: int | str, start: int, end: int) -> DataFrame:
    """Records of one reference that overlap [start, end).

    Pure predicate: no order of the table is assumed, and filters stay simple
    comparisons so that sources with an index can plan by them.
    """
    return reads.where(in_range(ref, start, end))


def bins_of(start: Column, end: Column, shift: int = 14) -> Column:
    """Numbers of the windows that [start, end) touches; an empty interval touches one."""
    return F.sequence(F.call_function("shiftright", start, F.lit(shift)), F.call_function("shiftright", F.greatest(end - 1, start), F.lit(shift)))


def region_bins(start: Column, end: Column, shift: int = 14, depth: int = 5, bai: bool = True) -> Column:
    """All bin numbers of the indexing scheme that may hold records overlapping [start, end)."""
    most = 1 << (shift + 3 * depth)
    low = F.least(start, F.lit(most - 1)) if bai else start
    last = F.least(end, F.lit(most)) - 1
    parts, offset = [], 0
    for level in range(depth + 1):
        s = shift + 3 * (depth - level)
        a, b = (F.call_function("shiftright", x.cast("long"), F.lit(s)) + offset for x in (low, last))
        parts.append(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")))
        offset += 1 << 3 * level
    return F.concat(*parts)


def interval_join(reads: DataFrame, regions: DataFrame, shift: int = 14) -> DataFrame:
    """Pairs of records and regions (ref_id, region_start, region_end, ...) that overlap.

    Both sides are spread over windows and joined by (ref_id, window), so no
    partition sees all records of a reference; a pair is kept in the one window
    where the later of the two begins.
    """
    stop = end_position(F.col("start"), F.col("end")).cast("long")
    left = reads.withColumn("_bin", F.explode(bins_of(F.col("start").cast("long"), stop, shift)))
    right = regions.withColumn("_rbin", F.explode(bins_of(F.col("region_start").cast("long"), F.col("region_end").cast("long"), shift))).withColumnRenamed("ref_id", "_rref")
    first = F.greatest(*(F.call_function("shiftright", F.col(c).cast("long"), F.lit(shift)) for c in ("start", "region_start")))
    hit = overlaps(F.col("start"), F.col("end"), F.col("region_start"), F.col("region_end"))
    return left.join(right, (F.col("ref_id") == F.col("_rref")) & (F.col("_bin") == F.col("_rbin"))).where(hit & (F.col("_bin") == first)).drop("_bin", "_rbin", "_rref")
