"""The walk along a record: its rules one by one, a slow oracle, and the batch form against the walk."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.codec.writer import cigar_words
from readloom.functions import columns as C
from readloom.operators.mismatch import batch_differences, differences, mismatch_rows, mismatches

X, I, D, N, S, H = map(ord, "XIDNSH")


def walk(cigar, seq="", md=None, qual=None, start=0, ref=None, ref_start=None, window=None, origin=0):
    given = [cigar_words(cigar), seq, md.encode() if md is not None else None, bytes(qual) if qual else None, start, ref, start if ref_start is None else ref_start]
    out = differences(*given, window, origin)
    kinds = (pa.list_(pa.int32()), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.int64())
    alone = batch_differences([pa.array([x], k) for x, k in zip(given, kinds)], window, origin)
    assert [tuple(m.values()) for m in alone[0].as_py()] == out
    return out


def sub(pos, base, ref=0, qual=-1):
    return X, pos, 1, base, qual, ord(ref) if ref else 0, 0


def test_positions_count_from_the_origin_and_windows_are_absolute():
    given = dict(cigar="7M", seq="CCCCCCC", md="1G2A2", start=900)
    assert walk(**given) == [sub(901, "C", "G"), sub(904, "C", "A")]
    assert walk(**given, origin=890) == [sub(11, "C", "G"), sub(14, "C", "A")]
    assert walk(**given, origin=890, window=(902, 905)) == [sub(14, "C", "A")]


def test_windows_take_points_by_position_and_gaps_by_overlap():
    given = dict(cigar="4M6D4M9N4M", seq="G" * 12, md="3T0^CATCAT8", start=50)
    assert walk(**given) == [sub(53, "G", "T"), (D, 54, 6, "", -1, 0, 0), (N, 64, 9, "", -1, 0, 0)]
    assert [m[0] for m in walk(**given, window=(59, 65))] == [D, N]
    assert [m[0] for m in walk(**given, window=(60, 64))] == []
    assert [m[0] for m in walk(**given, window=(53, 54))] == [X]
    assert walk("6M2S", "G" * 8, window=(0, 6)) == [] and walk("6M2S", "G" * 8, window=(0, 7)) == [(S, 6, 0, "", -1, 0, 2)]


def test_substitutions_come_from_the_tag_then_from_the_reference():
    assert walk("6M", "TTTTTT", md="4C1", ref="TATTTT") == [sub(4, "T", "C")]
    assert walk("6M", "TTTTTT", ref="TATTTT") == [sub(1, "T", "A")]
    assert walk("6M", "TTTTTT") == [] and walk("6M", "TTTTTT", md="") == []


def test_tags_that_say_something_else_end_a_run():
    assert walk("3M2M", "GGGGG", md="1n3") == []
    assert walk("5M", "GGGGG", md="1^A1C1") == []
    assert walk("2M1I3M", "GGGGGG", md="0A0T0C9") == [sub(0, "G", "A"), sub(1, "G", "T"), (I, 2, 0, "G", -1, 0, 1), sub(2, "G", "C")]
    assert walk("3M", "GGG", md="2") == [] and walk("3M", "GGG", md="12A") == []
    assert walk("2M2D2M", "GGGG", md="9") == [(D, 2, 2, "", -1, 0, 0)]


def test_deletions_skips_and_clips_use_no_bases_of_the_tag():
    got = walk("1H2S3M1D2M5N1M2I2M", "AACCCGGTTAGG", md="1G1^T2A0C1")
    assert got == [(H, 0, 0, "", -1, 0, 1), (S, 0, 0, "", -1, 0, 2), sub(1, "C", "G"), (D, 3, 1, "", -1, 0, 0), (N, 6, 5, "", -1, 0, 0), sub(11, "T", "A"), (I, 12, 0, "TA", -1, 0, 2), sub(12, "G", "C")]


def test_stated_differences_always_have_a_row():
    assert walk("2=2X1=", "ACGTA") == [sub(2, "G"), sub(3, "T")]
    assert walk("2=2X1=", "ACGTA", md="2T0G1") == [sub(2, "G", "T"), sub(3, "T", "G")]
    assert walk("2=2X1=", "ACGTA", md="3C1", ref="ACAAA") == [sub(2, "G"), sub(3, "T", "C")]
    assert walk("2=2X1=", "ACGTA", md="2T", ref="ACAGA") == [sub(2, "G", "T"), sub(3, "T", "G")]
    assert walk("2=2X1=", "ACGTA", ref="ACR") == [sub(2, "G", "R"), sub(3, "T")]


def test_bases_are_compared_as_codes():
    assert walk("5M", "acgtn", ref="ACGTN") == []
    assert walk("4M", "=NAZ", ref="ANNN") == [sub(0, "=", "A"), sub(2, "A", "N")]
    assert walk("4M", "GGGG", start=20, ref="TTTT", ref_start=22) == [sub(22, "G", "T"), sub(23, "G", "T")]
    assert walk("4M", "GGGG", start=20, ref="TTTT", ref_start=18) == [sub(20, "G", "T"), sub(21, "G", "T")]


def test_qualities_belong_to_bases():
    assert walk("1S2M1I2M", "AGGTGG", md="1C0A1", qual=[5, 6, 7, 8, 255, 9]) == [(S, 0, 0, "", -1, 0, 1), sub(1, "G", "C", 7), (I, 2, 0, "T", -1, 0, 1), sub(2, "G", "A", 255)]


def test_records_without_sequence_and_padding():
    assert walk("2S4M3I1X2D1N2H", md="4") == [(S, 0, 0, "", -1, 0, 2), (I, 4, 0, "", -1, 0, 3), (D, 5, 2, "", -1, 0, 0), (N, 7, 1, "", -1, 0, 0), (H, 8, 0, "", -1, 0, 2)]
    assert walk("2M3P2M", "CCCC", ref="CCAC") == [sub(2, "C", "A")]
    assert walk("4M", "CC", ref="AAAA") == [sub(0, "C", "A"), sub(1, "C", "A")] and walk("4M", "CC", md="0A2A0") == [sub(0, "C", "A")]


def base_by_base(ops, seq, start, ref):
    out, r, s = [], 0, 0
    for n, op in ops:
        if op in "M=":
            out += [sub(start + r + k, seq[s + k], ref[r + k]) for k in range(n) if seq[s + k] != ref[r + k]]
        elif op == "I":
            out.append((I, start + r, 0, seq[s:s + n], -1, 0, n))
        elif op in "DN":
            out.append((ord(op), start + r, n, "", -1, 0, 0))
        elif op in "SH":
            out.append((ord(op), start + r, 0, "", -1, 0, n))
        r += n if op in "M=DN" else 0
        s += n if op in "M=IS" else 0
    return out


def tag_of(ops, seq, ref):
    out, run, r, s = "", 0, 0, 0
    for n, op in ops:
        for k in range(n if op in "M=" else 0):
            same = seq[s + k] == ref[r + k]
            out, run = (out, run + 1) if same else (f"{out}{run}{ref[r + k]}", 0)
        if op == "D":
            out, run = f"{out}{run}^{ref[r:r + n]}", 0
        r += n if op in "M=DN" else 0
        s += n if op in "M=IS" else 0
    return f"{out}{run}"


@pytest.mark.parametrize("seed", range(8))
def test_tag_and_reference_give_what_a_look_at_each_base_gives(seed):
    rng = random.Random(seed)
    for _ in range(40):
        ops = [(rng.randint(1, 5), rng.choice("SH"))] * rng.randint(0, 1)
        for _ in range(rng.randint(1, 6)):
            ops += [(rng.randint(1, 20), rng.choice("M=")), (rng.randint(1, 4), rng.choice("IDN"))]
        ops.append((rng.randint(1, 20), "M"))
        seq = "".join(rng.choice("ACGT") for _ in range(sum(n for n, o in ops if o in "M=IS")))
        ref = "".join(rng.choice("ACGT") for _ in range(sum(n for n, o in ops if o in "M=DN")))
        want, cigar = base_by_base(ops, seq, 1000, ref), "".join(f"{n}{o}" for n, o in ops)
        assert walk(cigar, seq, start=1000, ref=ref) == want
        assert walk(cigar, seq, md=tag_of(ops, seq, ref), start=1000) == want


def odd_record(rng):
    """Any operations, any tag, sequences and references of any length."""
    ops = "".join(f"{rng.randint(0, 9)}{rng.choice('MMMIDNSHP=XX')}" for _ in range(rng.randint(0, 7)))
    seq = "".join(rng.choice("ACGTNacg=") for _ in range(rng.choice([0, 3, 20, 40])))
    md = rng.choice([None, "", "".join(rng.choice(["0", "3", "12", "A", "C", "^A", "^GT", "n", "^"]) if rng.random() < 0.4 else rng.choice(["1", "T", "5"]) for _ in range(rng.randint(1, 9)))])
    qual = bytes(rng.randrange(60) for _ in range(rng.choice([0, 5, 40])))
    ref = rng.choice([None, "", "".join(rng.choice("ACGTNRacgt-") for _ in range(30))])
    return cigar_words(ops) if ops else rng.choice([[], None]), seq, md.encode() if md is not None else None, qual or None, rng.randint(0, 30), ref, rng.randint(0, 30)


@pytest.mark.parametrize("window", [None, (10, 25), (12, 12), (0, 5), (500, 600)])
def test_a_batch_gives_what_the_walk_gives(window):
    rng = random.Random(9)
    records = [odd_record(rng) for _ in range(3000)] + [([16 * 9], "é" * 9, None, None, 0, "ACGTACGTA", 0)]
    want = [differences(c or [], s, m, q, p, r, o, window, 7) for c, s, m, q, p, r, o in records]
    kinds = (pa.list_(pa.int32()), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.int64())
    arrays = [pa.array(x, k) for x, k in zip(zip(*records), kinds)]
    for part in (slice(0, 3000), slice(5, 90), slice(0, 0), slice(2990, 3001)):
        got = batch_differences([a[part] for a in arrays], window, 7)
        assert [[tuple(m.values()) for m in g] for g in got.to_pylist()] == want[part]


def test_long_records_are_laid_out_in_parts(monkeypatch):
    monkeypatch.setattr("readloom.operators.mismatch.AT_ONCE", 100)
    rng = random.Random(2)
    seq, ref = ("".join(rng.choice("AC") for _ in range(1000)) for _ in range(2))
    assert walk("300M200X500M", seq, ref=ref) == differences(cigar_words("300M200X500M"), seq, None, None, 0, ref, 0)


def test_column_form(spark):
    rows = [(1, cigar_words("5M2D5M"), "A" * 10, "3G1^AC2T2", 7), (2, cigar_words("3M"), "AAA", None, 0), (3, None, None, None, 0)]
    reads = spark.createDataFrame(rows, "id long, cigar array<int>, seq string, md string, start int")
    walked = mismatches(reads, keep=["id"], qual=None)
    assert [(r.id, chr(r.code), r.ref_pos) for r in mismatch_rows(walked).orderBy("id", "ref_pos").collect()] == [(1, "X", 10), (1, "D", 12), (1, "X", 16)]
    assert mismatch_rows(walked, outer=True).count() == 5


def test_a_window_equals_the_whole_filtered(spark):
    rng = random.Random(4)
    rows = [(i, cigar_words("2S6M2I5M3D4M4N3M2S"), "".join(rng.choice("ACGT") for _ in range(24)), i, "".join(rng.choice("ACGT") for _ in range(60)), i - 5) for i in range(80)]
    reads = spark.createDataFrame(rows, "id long, cigar array<int>, seq string, start int, ref string, ref_start int")
    run = lambda **k: [tuple(r) for r in mismatch_rows(mismatches(reads, keep=["id"], md=None, qual=None, reference="ref", reference_start="ref_start", **k)).collect()]
    for a, b in ((30, 45), (0, 7), (100, 200), (50, 50)):
        want = [m for m in run() if (m[2] < b and m[2] + m[3] > a if m[1] in (D, N) else a <= m[2] < b)]
        assert sorted(run(window=(a, b))) == sorted(want)
    part = mismatches(reads, keep=["id"], md=None, qual=None, reference="ref", reference_start="ref_start", window=(30, 45))
    assert part.count() == reads.where((F.col("start") < 45) & (F.col("start") + C.length_on_ref(F.col("cigar")) >= 30)).count()
