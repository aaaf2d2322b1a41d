"""Mates of a region's records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.operators.region import in_range, records_for_range

ship(__name__)


def view_as_pairs(reads: DataFrame, ref_id: int, start: int, end: int, *, across: bool = False, max_insert: int = 200_000, key: str = "record_id",
                  broadcast_rows: int = 1_000_000, most_ranges: int = 64) -> DataFrame:
    """The region's records, then the mates that lie outside it, with `is_mate`.

    A record asks for its mate when its name is alone in the region and, unless
    `across`, the mate is said to be on the same reference less than `max_insert`
    away. Mates are the records of that name that cover the stated place; each
    is added once.

    The stated places are counted first, one row a reference. Only records that
    reach from the first to the last of them are read for mates, a filter that an
    indexed source can plan by; up to `broadcast_rows` places go to those records,
    which then aren't shuffled. Beyond that both sides meet by name and reference.
    """
    hits = records_for_range(reads, ref_id, start, end)
    alone = hits.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") == 1).drop("_n")
    asking = hits.join(alone, "name")
    if not across:
        asking = asking.where((F.col("next_refid") == ref_id) & (F.abs(F.col("start") - F.col("next_pos")) < max_insert))
    wanted = asking.select(F.col("name").alias("_name"), F.col("next_refid").alias("_ref"), F.col("next_pos").alias("_pos"))
    out = hits.select("*", F.lit(False).alias("is_mate"))
    asked = wanted.groupBy("_ref").agg(F.min("_pos").alias("low"), F.max("_pos").alias("high"), F.count("*").alias("n")).where(F.col("_ref").isNotNull()).collect()
    if not asked:
        return out
    near = [(F.col("ref_id") == r._ref) & (F.col("start") <= r.high) & (F.greatest("end", F.col("start") + 1) > r.low) for r in asked]
    there = reads.where(reduce(lambda a, b: a | b, near)) if len(near) <= most_ranges else reads
    few = sum(r.n for r in asked) <= broadcast_rows
    covers = (F.col("start") <= F.col("_pos")) & (F.greatest("end", F.col("start") + 1) > F.col("_pos"))
    found = there.join(F.broadcast(wanted) if few else wanted, (F.col("name") == F.col("_name")) & (F.col("ref_id") == F.col("_ref"))).where(covers)
    mates = found.where(~F.coalesce(in_range(ref_id, start, end), F.lit(False))).select(*reads.columns).dropDuplicates([key])
    return out.unionByName(mates.select(*hits.columns, F.lit(True).alias("is_mate")))
