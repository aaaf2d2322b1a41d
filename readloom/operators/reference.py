"""Reference sequences: what span is needed, and which records a region covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import ship

ship(__name__)


def needed_span(reads: DataFrame, has_md: Column) -> DataFrame:
    """(ref_id, span_start, span_end): what the records without an MD tag cover together."""
    return reads.where(~has_md).groupBy("ref_id").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"))


def reference_region(sequences: DataFrame, ref_name: str | None, start: int, end: int) -> DataFrame:
    """The part [start, end) of a stored sequence (ref_name, start, seq), or of all of them without a name; shorter where one ends."""
    cut = F.substring("seq", F.lit(start) - F.col("start") + 1, F.lit(end - start))
    named = F.lit(True) if ref_name is None else F.col("ref_name") == ref_name
    return sequences.where(named & (F.col("start") <= start)).select("ref_name", F.lit(start).alias("start"), cut.alias("seq"))


def covers(ref_start: Column, ref_end: Column, start: Column, end: Column) -> Column:
    return (ref_start <= start) & (ref_end >= end)


def tiles_of(sequences: DataFrame, size: int, overlap: int) -> DataFrame:
    """Sequences (ref_id, start, seq) in tiles of `size` bases, each with up to `overlap` bases more behind it.

    (_ref, region_start, _stop, _tile, _from, _part): tile k begins at k x size, or
    where the sequence does. Parts are cut from bytes, which doesn't scan the text,
    so a chromosome costs time in proportion to its length.
    """
    whole = sequences.select(
        F.col("ref_id").alias("_ref"), F.col("start").cast("long").alias("region_start"), (F.col("start").cast("long") + F.length("seq")).alias("_stop"), F.col("seq").cast("binary").alias("_seq")
    ).where(F.col("_stop") > F.col("region_start"))
    each = whole.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("region_start") / size), F.floor((F.col("_stop") - 1) / size))))
    each = each.withColumn("_from", F.greatest(F.col("_tile") * size, F.col("region_start")))
    part = F.substring("_seq", (F.col("_from") - F.col("region_start") + 1).cast("int"), ((F.col("_tile") + 1) * size + overlap - F.col("_from")).cast("int"))
    return each.select("_ref", "region_start", "_stop", "_tile", "_from", part.cast("string").alias("_part"))


def bind_reference(reads: DataFrame, sequences: DataFrame, shift: int = 14) -> DataFrame:
    """Records with the part of a sequence (ref_id, start, seq) that covers them whole; null if none does.

    region_start tells which sequence it was; reference_start and reference_seq
    are cut to the record. Sequences are laid out in tiles of 2**shift bases. A
    record of up to 2**shift bases lies in the tile that its start names and the
    one behind it, which comes along: an equi-join on (ref_id, tile). Of longer
    records each distinct place is joined with every tile that it touches and put
    together again. No row carries a whole sequence.
    """
    size = 1 << shift
    tile_of = lambda c: F.call_function("shiftright", c.cast("long"), F.lit(shift))
    inside = covers(F.col("region_start"), F.col("_stop"), F.col("start"), F.col("end"))
    here = (F.col("ref_id") == F.col("_ref")) & (F.col("_at") == F.col("_tile")) & inside
    span = F.col("end") - F.col("start")
    near = reads.where(span <= size).withColumn("_at", tile_of(F.col("start"))).join(tiles_of(sequences, size, size), here, "left")
    near = near.withColumn("_seq", F.substring("_part", (F.col("start") - F.col("_from") + 1).cast("int"), span.cast("int")))
    near = near.select(*reads.columns, "region_start", "_seq")

    far = reads.where((span > size) | span.isNull())
    places = far.where(span > size).select("ref_id", "start", "end").distinct()
    touched = places.withColumn("_at", F.explode(F.sequence(tile_of(F.col("start")), tile_of(F.col("end") - 1)))).join(tiles_of(sequences, size, 0), here)
    low = F.greatest(F.col("start").cast("long"), F.col("_from"))
    piece = F.substring("_part", (low - F.col("_from") + 1).cast("int"), (F.least(F.col("end").cast("long"), (F.col("_tile") + 1) * size) - low).cast("int"))
    whole = touched.groupBy("ref_id", "start", "end", "region_start", "_stop").agg(F.array_sort(F.collect_list(F.struct("_tile", piece.alias("s")))).alias("_all"))
    whole = whole.select("ref_id", "start", "end", "region_start", F.array_join(F.col("_all")["s"], "").alias("_seq"))
    both = near.unionByName(far.join(whole, ["ref_id", "start", "end"], "left").select(*near.columns))
    bound = F.col("region_start").isNotNull()
    return both.select(*reads.columns, "region_start", F.when(bound, F.col("start")).alias("reference_start"), F.when(bound, F.col("_seq")).alias("reference_seq"))


def fetched(spans: DataFrame, fetch: Callable[[int, int, int], str]) -> DataFrame:
    """Sequences from a caller's function, one call a reference that needs one.

    A span table has a row for each reference, which the driver holds anyway.
    """
    rows = [(r.ref_id, r.span_start, fetch(r.ref_id, r.span_start, r.span_end)) for r in spans.toLocalIterator()]
    return spans.sparkSession.createDataFrame([r for r in rows if r[2] is not None], "ref_id int, start int, seq string")
