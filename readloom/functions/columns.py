"""Column expressions over alignment records: all but tags stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom import ship

ship(__name__)

#: Fixed values of the format: flag bits, letters of operations and of packed bases.
FLAGS = {
    "is_paired": 1, "is_properly_paired": 2, "is_segment_unmapped": 4, "is_mate_unmapped": 8, "is_reverse_complemented": 16,
    "is_mate_reverse_complemented": 32, "is_read1": 64, "is_read2": 128, "is_secondary": 256, "is_failed_qc": 512, "is_duplicate": 1024,
    "is_supplementary": 2048,
}
OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
#: Orientation by (left of its mate, second read, reverse strands of both).
ORIENTATIONS = "F1F2 F1R2 R1F2 R1R2 F2F1 F2R1 R2F1 R2R1 F2F1 R2F1 F2R1 R2R1 F1F2 R1F2 F1R2 R1R2".split()


def flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(FLAGS[name]) != 0


def strand(flags: Column) -> Column:
    return F.when(flag(flags, "is_reverse_complemented"), -1).otherwise(1)


def mapq(raw: Column) -> Column:
    return F.nullif(raw, F.lit(255))


def end_position(start: Column, end: Column) -> Column:
    """A record without span counts as one base."""
    return F.greatest(end, start + 1)


def overlaps(start: Column, end: Column, low: int | Column, high: int | Column) -> Column:
    """Half-open overlap with [low, high). A point (low = high) is in what spans it strictly."""
    if isinstance(low, int) and isinstance(high, int) and low > high:
        raise ValueError(f"interval {low}-{high}: its start is after its end")
    low, high = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (low, high))
    return (start < high) & (end_position(start, end) > low)


def op_length(word: Column) -> Column:
    return F.shiftrightunsigned(word.cast("int"), 4)


def cigar_string(ops: Column) -> Column:
    letters = F.lit(OPS + "?" * 7)
    one = lambda x: F.concat(op_length(x).cast("string"), F.substring(letters, x.bitwiseAND(15) + 1, F.lit(1)))
    return F.array_join(F.transform(ops, one), "")


def is_numeric_cigar(ops: Column) -> Column:
    """Whether a CIGAR is given as operation words (an array of numbers) and not as text."""
    kind = F.typeof(ops)
    return kind.startswith("array<") & ~kind.contains("string")


def length_on_ref(ops: Column, flags: Column | None = None) -> Column:
    """Bases of the reference that the operations cover: bit k of 0x18D is set for those that count."""
    counts = lambda x: F.call_function("shiftright", F.lit(0x18D), x.bitwiseAND(15).cast("int")).bitwiseAND(1)
    span = F.aggregate(ops, F.lit(0).cast("long"), lambda a, x: a + op_length(x) * counts(x))
    return span if flags is None else F.when(flag(flags, "is_segment_unmapped"), F.lit(0).cast("long")).otherwise(span)


def is_placeholder_cigar(ops: Column, seq_length: Column) -> Column:
    """Two operations, the first a soft clip of the whole read: the real ones are in a tag."""
    first = F.get(ops, F.lit(0))
    return (F.size(ops) == 2) & (first.bitwiseAND(15) == 4) & (op_length(first) == seq_length)


def sequence(packed: Column, seq_length: Column) -> Column:
    return F.substring(F.translate(F.hex(packed), "0123456789ABCDEF", BASES), F.lit(1), seq_length)


def base_at(packed: Column, seq_length: Column, i: Column | int) -> Column:
    """The base at a 0-based place; null past the end."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when((i >= 0) & (i < seq_length), F.substring(sequence(packed, seq_length), i + 1, F.lit(1)))


def quality_text(qual: Column) -> Column:
    """Qualities as characters from `!` on; null stays null."""
    places = F.sequence(F.lit(1), F.length(qual))
    byte = lambda i: F.char(F.conv(F.hex(F.substring(qual, i, F.lit(1))), 16, 10).cast("int") + 33)
    return F.when(F.length(qual) == 0, F.lit("")).otherwise(F.array_join(F.transform(places, byte), ""))


def pair_orientation(flags: Column, ref_id: Column, next_refid: Column, start: Column, next_pos: Column) -> Column:
    left = F.when(ref_id != next_refid, ref_id < next_refid).when(start != next_pos, start < next_pos).otherwise(flag(flags, "is_read1"))
    place = F.call_function("shiftright", flags.cast("int"), F.lit(4)).bitwiseAND(7) + F.when(left, 8).otherwise(0)
    return F.when(flag(flags, "is_paired"), F.element_at(F.array(*map(F.lit, ORIENTATIONS)), place + 1))


def pack_reference(seq: Column) -> Column:
    """Two bases a byte, case ignored, unknown letters as N; a last odd half is 0."""
    known = F.regexp_replace(F.upper(seq), f"[^{BASES}]", "N")
    digits = F.translate(known, BASES, "0123456789ABCDEF")
    return F.unhex(F.rpad(digits, (F.ceil(F.length(seq) / 2) * 2).cast("int"), "0"))


def reference_code(seq: Column, i: Column) -> Column:
    """4-bit code of the base at a 0-based place of a reference text."""
    return F.instr(F.lit(BASES), F.regexp_replace(F.upper(F.substring(seq, i + 1, F.lit(1))), f"[^{BASES}]", "N")) - 1


def base_letter(code: Column) -> Column:
    """Character code of a 4-bit base code."""
    return F.ascii(F.substring(F.lit(BASES), code + 1, F.lit(1)))


def record_json() -> Column:
    """The record's usual fields as JSON; it needs columns cigar_string, seq and tags."""
    return F.to_json(F.struct("record_id", "ref_id", "start", "end", "name", "flags", "mq", "cigar_string", "seq", "next_refid", "next_pos", "template_length", "tags"))
