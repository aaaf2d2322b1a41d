"""The engine's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import base64
import json
import struct
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import ship
from readloom.codec import bgzf, writer
from readloom.functions import columns as C
from readloom.functions import tags as T
from readloom.operators import index_stats, mismatch, pairs, reference, region
from readloom.plans import derive as D
from readloom.shared import copy, exists, put, shared_dir
from readloom.sources import bam as source

ship(__name__)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HIT = 'start < {b} and greatest("end", start + 1) > {a}'


@query(f'select l_orderkey, l_linenumber, ref_id, start, "end", flags from ({D.LINE_SQL}) where ref_id = 1 and ' + HIT.format(a=400000, b=600000))
def c1_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region.records_for_range(D.line_reads(spark, sf_dir), 1, 400_000, 600_000).select("l_orderkey", "l_linenumber", "ref_id", "start", "end", "flags")


EDGES = [("point", 500_000, 500_000), ("first", 0, 1), ("huge", 0, 1 << 53), ("past", 2_000_000, 1 << 31), ("one", 777_777, 777_778)]


@query(" union all ".join(f"select '{n}' as edge, count(*) as n from ({D.LINE_SQL}) where ref_id = 2 and {HIT.format(a=a, b=b)}" for n, a, b in EDGES))
def c1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge windows in one scan."""
    reads = D.line_reads(spark, sf_dir).where("ref_id = 2")
    hits = [F.count_if(C.overlaps(F.col("start"), F.col("end"), a, b)).alias(n) for n, a, b in EDGES]
    return reads.agg(*hits).unpivot([], [n for n, *_ in EDGES], "edge", "n")


@query(f"select l_orderkey, l_linenumber, flags, {', '.join(f'(flags & {b}) <> 0 as {n}' for n, b in C.FLAGS.items())} from ({D.LINE_SQL})")
def c7_flag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.line_reads(spark, sf_dir).select("l_orderkey", "l_linenumber", "flags", *(C.flag(F.col("flags"), n).alias(n) for n in C.FLAGS))


@query(f"select l_orderkey, l_linenumber, start from ({D.LINE_SQL}) where (flags & 3) = 3 and (flags & 1796) = 0 and span = 77")
def c19_caller_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("flags")
    return D.line_reads(spark, sf_dir).where((f.bitwiseAND(3) == 3) & (f.bitwiseAND(1796) == 0) & (F.col("span") == 77)).select("l_orderkey", "l_linenumber", "start")


@query("""select * from (values ('chrA', true, 0), ('chrB', true, 1), ('chrC', true, 2), ('chrD', true, 3), ('chrZ', false, null)) t(ref_name, known, ref_id)""")
def c5_has_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = D.bam_file(spark, sf_dir)
    names = [(n, source.has_ref(path, n)) for n in ("chrA", "chrB", "chrC", "chrD", "chrZ")]
    asked = spark.createDataFrame(names, "ref_name string, known boolean")
    return asked.join(F.broadcast(source.ref_table(spark, path)), "ref_name", "left").select("ref_name", "known", "ref_id")


@query(f"select ref_id, count(*) filter (where (flags & 4) = 0) as mapped from ({D.LINE_SQL}) group by ref_id")
def e1_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_stats.line_counts(D.line_reads(spark, sf_dir))


SPANS = "select o_orderkey, cast((o_orderkey * 52361) % {most} as bigint) as a, cast((o_orderkey * 52361) % {most} + 1 + o_custkey * 37 % 60000 as bigint) as b from orders"


def _bins_sql(most: int, shift: int, depth: int) -> str:
    parts, offset = [], 0
    for level in range(depth + 1):
        s = shift + 3 * (depth - level)
        parts.append(f"select o_orderkey, unnest(generate_series((a >> {s}) + {offset}, ((b - 1) >> {s}) + {offset})) as bin from s")
        offset += 1 << 3 * level
    return f"with s as ({SPANS.format(most=most)}) " + " union all ".join(parts)


def _bins(spark: SparkSession, sf_dir: str, most: int, shift: int, depth: int, bai: bool) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").selectExpr(*SPANS.format(most=most).removeprefix("select ").removesuffix(" from orders").replace(", cast", "\x00cast").split("\x00"))
    return rows.select("o_orderkey", F.explode(region.region_bins(F.col("a"), F.col("b"), shift, depth, bai)).alias("bin"))


@query(_bins_sql(500_000_000, 14, 5))
def b3_reg2bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, 500_000_000, 14, 5, True)


@query(_bins_sql(2_000_000_000, 14, 6))
def b4_csi_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir, 2_000_000_000, 14, 6, False)


LINEAR = """select ref_id, win as "window", cast(sum(n) over (partition by ref_id order by win) as bigint) * 100 as block
  from (select ref_id, start >> 14 as win, count(*) as n from ({reads}) group by 1, 2)"""


@query(f"""with l as ({LINEAR.format(reads=D.LINE_SQL)}), m as (select ref_id, count(*) filter (where (flags & 4) = 0) as mapped from ({D.LINE_SQL}) group by 1),
  w as (select *, lead(block) over (partition by ref_id order by "window") as nxt, max(block) over (partition by ref_id) as total from l)
  select ref_id, cast("window" * 16384 as bigint) as start, cast(("window" + 1) * 16384 as bigint) as "end", cast(nxt - block as double) * mapped / total as score
  from w join m using (ref_id) where nxt is not null""")
def e2_index_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    reads = D.line_reads(spark, sf_dir)
    counts = reads.groupBy("ref_id", F.call_function("shiftright", F.col("start"), F.lit(14)).alias("window")).agg(F.count("*").alias("n"))
    linear = counts.select("ref_id", "window", (F.sum("n").over(Window.partitionBy("ref_id").orderBy("window")) * 100).alias("block"))
    return index_stats.density(linear, index_stats.line_counts(reads))


def _pairs_sql(across: bool) -> str:
    near = "" if across else "where h.next_refid = 1 and abs(h.start - h.next_pos) < 200000"
    return f"""with reads as ({D.PAIR_SQL}), hit as (select * from reads where ref_id = 1 and {HIT.format(a=400000, b=600000)}),
  uniq as (select name from hit group by name having count(*) = 1), elig as (select h.* from hit h join uniq using (name) {near}),
  mates as (select distinct r.record_id, r.name, r.ref_id, r.start, r."end" from reads r join elig x on r.name = x.name and r.ref_id = x.next_refid
    and r.start < x.next_pos + 1 and greatest(r."end", r.start + 1) > x.next_pos where r.record_id not in (select record_id from hit))
  select record_id, name, ref_id, start, "end", false as is_mate from hit union all select *, true from mates"""


@query(_pairs_sql(False))
def d1_view_as_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.view_as_pairs(D.paired_reads(spark, sf_dir), 1, 400_000, 600_000).select("record_id", "name", "ref_id", "start", "end", "is_mate")


@query(_pairs_sql(True))
def d1_pairs_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.view_as_pairs(D.paired_reads(spark, sf_dir), 1, 400_000, 600_000, across=True).select("record_id", "name", "ref_id", "start", "end", "is_mate")


@query(f"""select ref_id, min(start) as span_start, max("end") as span_end from ({D.PAIR_SQL}) where raw_mq >= 128 group by ref_id""")
def d2_reference_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.needed_span(D.paired_reads(spark, sf_dir), F.col("raw_mq") < 128)


BASE = "substring('ACGT', cast(({rid} * 7 + ({k}) * 13 + ({k}) * ({k})) % 4 as int) + 1, 1)"
GENOME = "substring('ACGT', cast((({p}) * 5 + ({p}) % 11) % 4 as int) + 1, 1)"
REGIONS = [(0, 0, 250_000), (1, 300_000, 500_000), (2, 0, 1_000_000)]


def genome(start: int, end: int) -> str:
    """The bases of GENOME at [start, end)."""
    p = np.arange(start, end)
    return np.frombuffer(b"ACGT", np.uint8)[(p * 5 + p % 11) % 4].tobytes().decode()


def _genome_sql(start: str, n: str) -> str:
    return f"array_to_string(list_transform(range({n}), lambda k: {GENOME.format(p=f'({start}) + k')}), '')"


@query(f"""select r.record_id, s.a as region_start, case when s.a is not null then r.start end as reference_start, case when s.a is not null then {_genome_sql('r.start', 'r.span')} end as reference_seq
  from ({D.PAIR_SQL}) r left join (values {', '.join(map(str, REGIONS))}) s(ref, a, b) on r.ref_id = s.ref and s.a <= r.start and s.b >= r."end" """)
def d5_covering_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(r, a, genome(a, b)) for r, a, b in REGIONS], "ref_id int, start int, seq string")
    return reference.bind_reference(D.paired_reads(spark, sf_dir), known).select("record_id", "region_start", "reference_start", "reference_seq")


@query(f"""with r as (select record_id as rid, start, span from ({D.PAIR_SQL}) where raw_mq >= 128), j as (select rid, start + k as p, {BASE.format(rid='rid', k='k')} as b, {GENOME.format(p='start + k')} as g
    from r, (select unnest(range(160)) as k) where k < span)
  select rid as record_id, 88 as code, cast(p as int) as ref_pos, b as bases, ascii(g) as ref_base_code from j where b <> g""")
def d2_bound_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the span that records without an MD tag need, over one fetch a reference and the records that it covers, to their substitutions."""
    reads = D.paired_reads(spark, sf_dir)
    bases = F.expr(f"array_join(transform(sequence(0, span - 1), k -> {BASE.format(rid='record_id', k='k')}), '')")
    has_md = F.col("raw_mq") < 128
    known = reference.fetched(reference.needed_span(reads, has_md), lambda ref, a, b: genome(a, b))
    bound = reference.bind_reference(reads.where(~has_md), known).withColumns({"seq": bases, "cigar": F.array((F.col("span") * 16).cast("int"))})
    rows = mismatch.mismatch_rows(mismatch.mismatches(bound, keep=["record_id"], md=None, qual=None, reference="reference_seq", reference_start="reference_start"))
    return rows.select("record_id", "code", "ref_pos", "bases", "ref_base_code")


@query(f"""select 'r' || o_orderkey as ref_name, 7 as start, {_genome_sql('7', 'least(5, o_custkey % 40 - 7)')} as seq from orders where o_custkey % 40 > 7""")
def d3_reference_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same region of many stored sequences, of which some end inside it."""
    rows = D.table(spark, sf_dir, "orders").where("o_custkey % 40 > 7")
    whole = genome(0, 40)
    stored = rows.select(F.concat(F.lit("r"), F.col("o_orderkey")).alias("ref_name"), F.lit(0).alias("start"), F.substring(F.lit(whole), F.lit(1), (F.col("o_custkey") % 40).cast("int")).alias("seq"))
    return reference.reference_region(stored, None, 7, 12)


SHAPE = {"s": "o_orderkey % 9", "m": "20 + o_custkey % 50", "i": "1 + o_orderkey % 4", "d": "1 + o_custkey % 6", "n": "100 + o_orderkey % 900", "e": "10 + o_orderkey % 31", "x": "1 + o_custkey % 3"}
SHAPE_OPS = [("s", 4, "S"), ("m", 0, "M"), ("i", 1, "I"), ("e", 7, "="), ("d", 2, "D"), ("x", 8, "X"), ("n", 3, "N"), ("m", 0, "M"), ("i", 6, "P"), ("s", 5, "H")]


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ", ".join(f"cast(({SHAPE[k]}) * 16 + {op} as int)" for k, op, _ in SHAPE_OPS)
    return D.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"array({words}) as cigar", "cast(o_custkey % 4096 as int) as flags")


@query("select o_orderkey, " + " || ".join(f"cast({SHAPE[k]} as varchar) || '{c}'" for k, _, c in SHAPE_OPS) + " as cigar_string from orders")
def f1_cigar_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir).select("o_orderkey", C.cigar_string(F.col("cigar")).alias("cigar_string"))


@query("select o_orderkey, true as words, false as text from orders")
def f26_is_numeric_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shaped(spark, sf_dir).withColumn("written", C.cigar_string(F.col("cigar")))
    return rows.select("o_orderkey", C.is_numeric_cigar(F.col("cigar")).alias("words"), C.is_numeric_cigar(F.col("written")).alias("text"))


@query("select o_orderkey, case when (o_custkey % 4096 & 4) <> 0 then 0 else " + " + ".join(f"({SHAPE[k]})" for k, op, _ in SHAPE_OPS if 0x18D >> op & 1) + " end as length_on_ref from orders")
def f2_length_on_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir).select("o_orderkey", C.length_on_ref(F.col("cigar"), F.col("flags")).alias("length_on_ref"))


@query("select o_orderkey, o_custkey % 3 = 0 as is_placeholder from orders")
def f4_cg_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(50 + o_orderkey % 50 as int) as n", "array(cast((50 + o_orderkey % 50 + o_custkey % 3) * 16 + 4 as int), cast(1000 * 16 + 3 as int)) as cigar")
    return rows.select("o_orderkey", C.is_placeholder_cigar(F.col("cigar"), F.col("n")).alias("is_placeholder"))


HEX = "lpad(upper(hex(o_orderkey * 2654435761 % 4294967296)), 8, '0')"
LETTERS = "translate({h}, '0123456789ABCDEF', '" + C.BASES + "')"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"unhex({HEX}) as packed", "cast(1 + o_orderkey % 8 as int) as n")


@query(f"select o_orderkey, substring({LETTERS.format(h=HEX)}, 1, cast(1 + o_orderkey % 8 as int)) as seq from orders")
def f5_seq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("o_orderkey", C.sequence(F.col("packed"), F.col("n")).alias("seq"))


@query(f"select o_orderkey, case when 3 < 1 + o_orderkey % 8 then substring({LETTERS.format(h=HEX)}, 4, 1) end as base from orders")
def f6_seq_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("o_orderkey", C.base_at(F.col("packed"), F.col("n"), 3).alias("base"))


@query("select o_orderkey, repeat(chr(cast(33 + o_orderkey % 60 as int)), cast(o_custkey % 5 as int)) as qual_text from orders")
def f8_quality_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "unhex(repeat(lpad(hex(o_orderkey % 60), 2, '0'), cast(o_custkey % 5 as int))) as qual")
    return rows.select("o_orderkey", C.quality_text(F.col("qual")).alias("qual_text"))


@query(f"select record_id, nullif(raw_mq, 255) as mq, case when (flags & 16) <> 0 then -1 else 1 end as strand from ({D.ORDER_SQL})")
def f10_mapq_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.order_reads(spark, sf_dir).select("record_id", C.mapq(F.col("raw_mq")).alias("mq"), C.strand(F.col("flags")).alias("strand"))


@query(f"""select record_id, case when (flags & 1) <> 0 then list_extract([{', '.join(repr(x) for x in C.ORIENTATIONS)}], ((flags >> 4) & 7) + 1 + case when
  (case when ref_id <> next_refid then ref_id < next_refid when start <> next_pos then start < next_pos else (flags & 64) <> 0 end) then 8 else 0 end) end as pair_orientation from ({D.PAIR_SQL})""")
def f14_pair_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = D.paired_reads(spark, sf_dir)
    return reads.select("record_id", C.pair_orientation(*(F.col(c) for c in ("flags", "ref_id", "next_refid", "start", "next_pos"))).alias("pair_orientation"))


LITTLE = "lpad(upper(hex({x} % 256)), 2, '0'), lpad(upper(hex(cast(floor(({x}) / 256) as bigint) % 256)), 2, '0')"
#: Packed tags XB:B:S (two numbers), XS:B:c (-1 and one more), XF:f and XH:H.
RAW_ARRAYS = (f"unhex(concat('58424253', '02000000', {LITTLE.format(x='o_orderkey % 60000')}, '0700', '58534263', '02000000', 'FF', lpad(upper(hex(o_custkey % 100)), 2, '0'),"
              " '5846660000C03F', '584848', hex(lpad(upper(hex(o_orderkey % 256)), 2, '0')), '00'))")


@query("""select o_orderkey, (o_orderkey % 60000) || ',7' as numbers, '-1,' || (o_custkey % 100) as small, cast(1.5 as double) as f, lpad(upper(hex(o_orderkey % 256)), 2, '0') as h, 'BS Bc f H' as kinds from orders""")
def f20_array_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{RAW_ARRAYS} as raw").withColumn("t", T.decode_tags("raw"))
    t = F.col("t")
    kinds = F.concat_ws(" ", *(t[n]["type"] for n in ("XB", "XS", "XF", "XH")))
    return rows.select("o_orderkey", F.array_join(t["XB"]["ai"], ",").alias("numbers"), F.array_join(t["XS"]["ai"], ",").alias("small"), t["XF"]["f"].alias("f"), t["XH"]["s"].alias("h"), kinds.alias("kinds"))


TEXT = "coalesce(substring(o_orderpriority, 1, 8), '')"
#: Packed tags NM:C, XA:A (on even keys), MD:Z and a second NM, which must not count.
RAW_TAGS = f"unhex(concat('4E4D43', lpad(hex(o_orderkey % 200), 2, '0'), case when o_orderkey % 2 = 0 then '58414151' else '' end, '4D445A', hex({TEXT}), '00', '4E4D4301'))"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{RAW_TAGS} as raw")


@query(f"select o_orderkey, o_orderkey % 200 as nm, case when o_orderkey % 2 = 0 then 'Q' end as xa, {TEXT} as md, cast(case when o_orderkey % 2 = 0 then 3 else 2 end as int) as n_tags from orders")
def f15_tags_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tags")
    return _tagged(spark, sf_dir).withColumn("tags", T.decode_tags("raw")).select("o_orderkey", t["NM"]["i"].alias("nm"), t["XA"]["s"].alias("xa"), t["MD"]["s"].alias("md"), F.size(t).alias("n_tags"))


@query(f"select o_orderkey, o_orderkey % 200 as nm, hex({TEXT}) as md_hex from orders")
def f16_get_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _tagged(spark, sf_dir).select("o_orderkey", T.get_tags(F.col("raw"), NM="long", MD="binary").alias("t"))
    return got.select("o_orderkey", F.col("t.NM").alias("nm"), F.hex("t.MD").alias("md_hex"))


@query(f"select o_orderkey, case when o_orderkey % 2 = 0 then 'Q' else {TEXT} end as tag from orders")
def f18_tag_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("o_orderkey", T.get_tag_alt(F.col("raw"), "XA", "MD").alias("tag"))


REF_TEXT = "concat(substring('acgtnACGTN', cast(1 + o_orderkey % 5 as int), 5), case when o_custkey % 2 = 0 then 'Z' else '' end)"


@query(f"""select o_orderkey, rpad(translate(regexp_replace(upper({REF_TEXT}), '[^{C.BASES}]', 'N', 'g'), '{C.BASES}', '0123456789ABCDEF'), 6, '0') as packed,
  ascii(upper(substring({REF_TEXT}, 2, 1))) as second from orders""")
def f21_pack_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{REF_TEXT} as seq")
    return rows.select("o_orderkey", F.hex(C.pack_reference(F.col("seq"))).alias("packed"), C.base_letter(C.reference_code(F.col("seq"), F.lit(1))).alias("second"))


HEADER_LINES = [("HD", "VN", "1.6"), ("HD", "SO", "coordinate"), *(x for n, size in D.REFS for x in (("SQ", "SN", n), ("SQ", "LN", size))), ("CO", "derived", " from orders")]
_LINE_OF = {("HD", "VN"): 0, ("HD", "SO"): 0, ("CO", "derived"): 1 + len(D.REFS)}


@query("select * from (values " + ", ".join(f"({_LINE_OF.get((t, k), 1 + (i - 2) // 2)}, '{t}', '{k}', '{v}')" for i, (t, k, v) in enumerate(HEADER_LINES)) + ") t(line, tag, field, value)")
def a6_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the file's header lines."""
    source.register(spark)
    lines = spark.read.format("bam_header").load(D.bam_file(spark, sf_dir)).select(F.posexplode("lines").alias("line", "l"))
    return lines.select("line", F.col("l.tag").alias("tag"), F.explode("l.data").alias("d")).select("line", "tag", F.col("d.tag").alias("field"), F.col("d.value").alias("value"))


WINDOWS = [(w, w % 3, (w * 47_777) % 1_000_000, (w * 47_777) % 1_000_000 + 20_000 * (w % 4)) for w in range(40)]


@query(f"""select w.id as region_id, r.record_id from ({D.PAIR_SQL}) r join (values {', '.join(map(str, WINDOWS))}) w(id, ref, a, b)
  on r.ref_id = w.ref and r.start < w.b and greatest(r."end", r.start + 1) > w.a""")
def ij_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.createDataFrame(WINDOWS, "region_id int, ref_id int, region_start long, region_end long")
    return region.interval_join(D.paired_reads(spark, sf_dir), regions).select("region_id", "record_id")


#: Reads of shape M I M D M with bases by arithmetic, against a reference by arithmetic.
LENS = {"a": "10 + o_orderkey % 7", "i": "1 + o_orderkey % 3", "b": "12 + o_custkey % 5", "d": "1 + o_custkey % 4", "c": "9 + o_orderkey % 6"}


def _walk_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey as rid", "cast(o_orderkey * 97 % 100000 as int) as start", *(f"cast({x} as int) as {k}" for k, x in LENS.items()))
    return rows.selectExpr(
        "rid", "start", "array(a * 16, i * 16 + 1, b * 16, d * 16 + 2, c * 16) as cigar",
        f"array_join(transform(sequence(0, a + i + b + c - 1), k -> {BASE.format(rid='rid', k='k')}), '') as seq",
        f"array_join(transform(sequence(0, a + b + d + c - 1), k -> {GENOME.format(p='start + k')}), '') as ref",
    )


WALK_SQL = f"""with r as (select o_orderkey as rid, cast(o_orderkey * 97 % 100000 as int) as start, {', '.join(f'cast({x} as int) as {k}' for k, x in LENS.items())} from orders),
  o as (select rid, start, 0 as so, 0 as ro, a as n from r union all select rid, start, a + i, a, b from r union all select rid, start, a + i + b, a + b + d, c from r),
  j as (select rid, start, so + j as s, ro + j as p from o, (select unnest(range(40)) as j) where j < n),
  w as (select rid, 88 as code, start + p as pos, 1 as length, {BASE.format(rid='rid', k='s')} as bases, {GENOME.format(p='start + p')} as fb, 0 as clip_length from j),
  m as (select rid, code, pos, length, bases, ascii(fb) as ref_base_code, clip_length from w where bases <> fb
    union all select rid, 73, start + a, 0, array_to_string(list_transform(range(i), lambda k: {BASE.format(rid='rid', k='a + k')}), ''), 0, i from r
    union all select rid, 68, start + a + b, d, '', 0, 0 from r)"""


def _walk_rows(walked: DataFrame) -> DataFrame:
    rows = mismatch.mismatch_rows(walked)
    return rows.select("rid", "code", "ref_pos", "length", "bases", "ref_base_code", "clip_length")


@query(f"{WALK_SQL} select rid, code, pos as ref_pos, length, bases, ref_base_code, clip_length from m")
def m1_mismatch_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_rows(mismatch.mismatches(_walk_reads(spark, sf_dir), keep=["rid"], md=None, qual=None, reference="ref", reference_start="start"))


@query(f"{WALK_SQL} select rid, code, pos as ref_pos, length, bases, ref_base_code, clip_length from m where case when code = 68 then pos < 60000 and pos + length > 20000 else pos >= 20000 and pos < 60000 end")
def m1_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_rows(mismatch.mismatches(_walk_reads(spark, sf_dir), keep=["rid"], md=None, qual=None, reference="ref", reference_start="start", window=(20_000, 60_000)))


@query(f"{WALK_SQL} select rid, code, pos - 1000 as ref_pos, length, bases, ref_base_code, clip_length from m")
def m1_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_rows(mismatch.mismatches(_walk_reads(spark, sf_dir), keep=["rid"], md=None, qual=None, reference="ref", reference_start="start", origin=1000))


#: Reads of all operations: S M I = D X N M P H.
ALL = {"s": "1 + o_orderkey % 9", "m": "6 + o_custkey % 11", "i": "1 + o_orderkey % 4", "e": "3 + o_orderkey % 8", "d": "1 + o_custkey % 6", "x": "1 + o_custkey % 3", "n": "5 + o_orderkey % 20"}
ALL_OPS = [("s", 4), ("m", 0), ("i", 1), ("e", 7), ("d", 2), ("x", 8), ("n", 3), ("m", 0), ("i", 6), ("s", 5)]


@query(f"""with r as (select o_orderkey as rid, cast(o_orderkey * 97 % 100000 as int) as start, {', '.join(f'cast({v} as int) as {k}' for k, v in ALL.items())} from orders),
  o as (select rid, start, s as so, 0 as ro, m as n, false as stated from r union all select rid, start, s + m + i, m, e, false from r
    union all select rid, start, s + m + i + e, m + e + d, x, true from r union all select rid, start, s + m + i + e + x, m + e + d + x + n, m, false from r),
  j as (select rid, start + ro + k as pos, {BASE.format(rid='rid', k='so + k')} as b, {GENOME.format(p='start + ro + k')} as g, stated from o, (select unnest(range(60)) as k) where k < n)
  select rid, 88 as code, pos as ref_pos, 1 as length, b as bases, ascii(g) as ref_base_code, 0 as clip_length from j where stated or b <> g
  union all select rid, 83, start, 0, '', 0, s from r
  union all select rid, 73, start + m, 0, array_to_string(list_transform(range(i), lambda k: {BASE.format(rid='rid', k='s + m + k')}), ''), 0, i from r
  union all select rid, 68, start + m + e, d, '', 0, 0 from r
  union all select rid, 78, start + m + e + d + x, n, '', 0, 0 from r
  union all select rid, 72, start + m + e + d + x + n + m, 0, '', 0, s from r""")
def m1_all_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey as rid", "cast(o_orderkey * 97 % 100000 as int) as start", *(f"cast({v} as int) as {k}" for k, v in ALL.items()))
    reads = rows.selectExpr(
        "rid", "start", f"array({', '.join(f'{k} * 16 + {op}' for k, op in ALL_OPS)}) as cigar",
        f"array_join(transform(sequence(0, s + m + i + e + x + m - 1), k -> {BASE.format(rid='rid', k='k')}), '') as seq",
        f"array_join(transform(sequence(0, m + e + d + x + n + m - 1), k -> {GENOME.format(p='start + k')}), '') as ref",
    )
    return _walk_rows(mismatch.mismatches(reads, keep=["rid"], md=None, qual=None, reference="ref", reference_start="start"))


MD_READ = {"x": "o_orderkey % 11", "y": "o_custkey % 13", "z": "5 + o_orderkey % 4"}


@query(f"""with r as (select o_orderkey as rid, cast(o_orderkey * 97 % 100000 as int) as start, {', '.join(f'cast({v} as int) as {k}' for k, v in MD_READ.items())} from orders)
  select rid, 88 as code, start + x as ref_pos, 1 as length, {BASE.format(rid='rid', k='x')} as bases, 84 as ref_base_code, 0 as clip_length, cast(rid % 40 as int) as qual from r
  union all select rid, 68, start + x + 1 + y, 2, '', 0, 0, -1 from r
  union all select rid, 88, start + x + 3 + y + z, 1, {BASE.format(rid='rid', k='x + 1 + y + z')}, 71, 0, cast(rid % 40 as int) from r""")
def m1_mismatch_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey as rid", "cast(o_orderkey * 97 % 100000 as int) as start", *(f"cast({v} as int) as {k}" for k, v in MD_READ.items()))
    reads = rows.selectExpr(
        "rid", "start", "array((x + 1 + y) * 16, 2 * 16 + 2, (z + 3) * 16) as cigar", "concat(x, 'T', y, '^AC', z, 'G2') as md",
        f"array_join(transform(sequence(0, x + y + z + 3), k -> {BASE.format(rid='rid', k='k')}), '') as seq", "unhex(repeat(lpad(hex(rid % 40), 2, '0'), x + y + z + 4)) as qual",
    )
    rows = mismatch.mismatch_rows(mismatch.mismatches(reads, keep=["rid"]))
    return rows.select("rid", "code", "ref_pos", "length", "bases", "ref_base_code", "clip_length", "qual")


IO_SQL = f"""select 'r' || record_id as name, ref_id, start, cast(start + case when (flags & 4) <> 0 then 0 else span end as int) as "end", flags, nullif(raw_mq, 255) as mq, span as seq_length,
  cast(record_id % 7 as bigint) as nm from ({D.ORDER_SQL})"""


def _decoded(reads: DataFrame) -> DataFrame:
    return reads.select("name", "ref_id", "start", "end", "flags", "mq", "seq_length", T.get_tag(F.col("tags_raw"), "NM", "long").alias("nm"))


@query(IO_SQL)
def io_bam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full scan by the partitions that the index allows."""
    return _decoded(source.read_bam(spark, D.bam_file(spark, sf_dir), splitBytes=str(4 << 20)))


@query(IO_SQL)
def io_stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass without an index, in small windows."""
    return _decoded(source.read_bam(spark, D.bam_file(spark, sf_dir), useIndex="false", window="100001"))


@query(f'select * from ({IO_SQL}) where ref_id = 1 and {HIT.format(a=250000, b=260000)}')
def io_region_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region comes from the query's own filters."""
    return _decoded(region.records_for_range(source.read_bam(spark, D.bam_file(spark, sf_dir), pushdown="true"), "chrB", 250_000, 260_000))


@query(f'select * from ({IO_SQL}) where ref_id = 2 and {HIT.format(a=990000, b=2000000)}')
def io_region_bai(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = D.bam_file(spark, sf_dir)
    return _decoded(source.region_reads(spark, path, "chrC", 990_000, 2_000_000, index=path + ".bai"))


@query(f"select ref_id, count(*) filter (where (flags & 4) = 0) as mapped from ({D.ORDER_SQL}) group by ref_id union all select 3, 0")
def io_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    source.register(spark)
    return spark.read.format("bam_index").option("part", "stats").load(D.bam_file(spark, sf_dir) + ".bai")


@query(f"select * from (values {', '.join(str((i, n, s)) for i, (n, s) in enumerate(D.REFS))}) t(ref_id, ref_name, length)")
def a7_ref_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.ref_table(spark, D.bam_file(spark, sf_dir))


@query(f"select ref_id, bin, begin >> 16 as min_block, begin & 65535 as min_data, stop >> 16 as max_block, stop & 65535 as max_data, (stop >> 16) + 65536 as end_position from ({D.CHUNK_SQL})")
def b1_index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    source.register(spark)
    return spark.read.format("bam_index").load(D.bam_file(spark, sf_dir) + ".bai")


PLANS = [("csi", 1, 100_000, 900_000), ("bai", 1, 100_000, 900_000), ("csi", 0, 0, 1000), ("bai", 2, 500_000, 500_001), ("csi", 0, 990_000, 2_000_000), ("bai", 2, 0, 1 << 40)]


@query(" union all ".join(
    f"select {i} as request, begin >> 16 as min_block, begin & 65535 as min_data, stop >> 16 as max_block, stop & 65535 as max_data, end_position, end_position - (begin >> 16) as fetched,"
    f" (begin >> 16) || ':' || (begin & 65535) || '-' || (stop >> 16) || ':' || (stop & 65535) as key from ({D.plan_sql([(r, a, b)], kind)})"
    for i, (kind, r, a, b) in enumerate(PLANS)))
def b8_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads that region queries plan, by either index."""
    path, rows = D.bam_file(spark, sf_dir), []
    for i, (kind, ref, a, b) in enumerate(PLANS):
        plan = source.chunk_plan(path, D.REFS[ref][0], a, b, index=f"{path}.{kind}")
        rows += [(i, c.begin >> 16, c.begin & 0xFFFF, c.stop >> 16, c.stop & 0xFFFF, c.end_position, c.fetched_size(), c.key()) for c in plan]
    return spark.createDataFrame(rows, "request int, min_block long, min_data int, max_block long, max_data int, end_position long, fetched long, key string")


@query(f"select kind, min(begin) >> 16 as block, min(begin) & 65535 as data from ({D.CHUNK_SQL}), (values ('bai'), ('csi')) t(kind) group by kind")
def a13_first_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    source.register(spark)
    path = D.bam_file(spark, sf_dir)
    first = [spark.read.format("bam_index").option("part", "first").load(f"{path}.{k}").select(F.lit(k).alias("kind"), "block", "data") for k in ("bai", "csi")]
    return first[0].unionByName(first[1])


@query("""select 'VCF' as format, '1-based' as coordinates, 1 as ref_column, 2 as start_column, 0 as end_column, '#' as meta, cast(count(*) as int) as skip_lines, string_agg(n_name, ',' order by n_nationkey) as names from nation""")
def a10_tabix_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text-table block of an index: its columns and names."""
    source.register(spark)
    names = [r.n_name for r in D.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # as many as an index has references
    joined = b"".join(n.encode() + b"\0" for n in names)
    aux = struct.pack("<7i", 2, 1, 2, 0, ord("#"), len(names), len(joined)) + joined
    path = f"{D.bam_file(spark, sf_dir)}.names.csi"
    put(spark, path, [writer.index_bytes([], len(names), 0, "csi", aux=aux)])
    return spark.read.format("bam_index").option("part", "tabix").load(path).withColumn("names", F.array_join("names", ","))


@query("select cast(0 as int) as ref_id, cast(0 as bigint) as start, cast(0 as bigint) as \"end\", cast(0 as double) as score where false")
def e3_csi_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index without the linear part tells no densities."""
    source.register(spark)
    return spark.read.format("bam_index").option("part", "density").load(D.bam_file(spark, sf_dir) + ".csi")


@query(f"""with l as (select ref_id, w, v >> 16 as block, lead(v >> 16) over (partition by ref_id order by w) as nxt, last_value(v >> 16) over (partition by ref_id order by w rows between unbounded preceding and unbounded following) as total
    from ({D.LINEAR_SQL})), m as (select ref_id, count(*) filter (where mapped) as mapped from ({D.PLACED_SQL}) group by ref_id)
  select ref_id, w * 16384 as start, (w + 1) * 16384 as "end", case when total > 0 then cast((nxt - block) * mapped as double) / total else 0 end as score from l join m using (ref_id) where nxt is not null""")
def e2_bai_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    source.register(spark)
    return spark.read.format("bam_index").option("part", "density").load(D.bam_file(spark, sf_dir) + ".bai")


FORECASTS = [("csi", [(0, 0, 1000)]), ("csi", [(1, 0, 1 << 29)]), ("bai", [(0, 0, 500_000), (2, 0, 500_000)]), ("bai", [(1, 200_000, 260_000)]), ("csi", [(0, 100_000, 200_000), (1, 5, 6)])]


@query(" union all ".join(f"select {i} as request, coalesce(cast(sum(end_position - (begin >> 16)) as bigint), 0) as bytes from ({D.plan_sql(regions, kind, True)})" for i, (kind, regions) in enumerate(FORECASTS)))
def e4_estimated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts from either index; a name that the file doesn't have counts nothing."""
    path = D.bam_file(spark, sf_dir)
    ask = lambda regions: [*((D.REFS[r][0], a, b) for r, a, b in regions), ("none", 0, 5)]
    return spark.createDataFrame([(i, source.estimated_bytes(path, ask(regions), index=f"{path}.{kind}")) for i, (kind, regions) in enumerate(FORECASTS)], "request int, bytes long")


@query(f'select * from ({IO_SQL}) where ref_id = 0 and {HIT.format(a=100000, b=300000)}')
def io_htsget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets answered by files: the header in one part, the data in two."""
    path = D.bam_file(spark, sf_dir)
    file = bgzf.Source(path)
    cut = bgzf.block_size(file.read(0, 18), 0)
    parts = {name: f"{path}.{name}" for name in ("head", "rest")}
    if not exists(spark, parts["head"]):
        put(spark, parts["head"], [file.read(0, cut)])
    if not exists(spark, parts["rest"]):
        copy(spark, parts["rest"], path, cut)

    def ticket(*names: str) -> str:
        body = json.dumps({"htsget": {"format": "BAM", "urls": [{"url": parts[n]} for n in names]}})
        return "data:application/json;base64," + base64.b64encode(body.encode()).decode()

    base = "https://reads.example/t"
    replies = {f"{base}?class=header&format=BAM": ticket("head"), f"{base}?referenceName=chrA&start=100000&end=300000&format=BAM": ticket("head", "rest")}
    source.register(spark)
    return _decoded(spark.read.format("htsget").option("replies", json.dumps(replies)).option("region", "chrA:100000-300000").load(base))


@query(f"select flags & 16 as reverse, count(*) as n from ({D.ORDER_SQL}) group by 1")
def g9_arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming over a folder of files, drained and counted."""
    source.register(spark)
    path = D.bam_file(spark, sf_dir)
    folder = path + ".arrivals"
    if not exists(spark, f"{folder}/one.bam"):
        copy(spark, f"{folder}/one.bam", path)
    out = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    stream = spark.readStream.format("bam").option("columns", "flags,start").load(folder)
    run = stream.writeStream.format("parquet").option("path", out + "/rows").option("checkpointLocation", out + "/state").trigger(processingTime="0 seconds").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.parquet(out + "/rows").groupBy(F.col("flags").bitwiseAND(16).alias("reverse")).agg(F.count("*").alias("n"))


@query(f"""select 'header_text' as part, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:coordinate' || chr(10) || {" || ".join(f"'@SQ' || chr(9) || 'SN:{n}' || chr(9) || 'LN:{s}' || chr(10)" for n, s in D.REFS)}
  || '@CO' || chr(9) || 'derived: from orders' || chr(10) as header_text""")
def a5_header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    source.register(spark)
    return spark.read.format("bam_header").load(D.bam_file(spark, sf_dir)).select(F.lit("header_text").alias("part"), "header_text")


@query(f"select ref_name, count(*) as n from (select case ref_id when 0 then '1' when 1 then 'chrB' else 'chrC' end as ref_name from ({D.ORDER_SQL})) group by 1")
def h2_rename_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.read_bam(spark, D.bam_file(spark, sf_dir), rename="chrA=1", columns="ref_name").groupBy("ref_name").agg(F.count("*").alias("n"))


@query(f"""select record_id as id, '[' || ref_id || ',' || start || ',"r' || record_id || '",' || coalesce(cast(nullif(raw_mq, 255) as varchar), 'null') || ',"' || span || 'M","g' || record_id % 3 || '"]' as fields from ({D.ORDER_SQL})""")
def f24_record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record's JSON, and some of its fields read back from it."""
    reads = source.read_bam(spark, D.bam_file(spark, sf_dir))
    full = reads.withColumns({"cigar_string": C.cigar_string(F.col("cigar")), "seq": C.sequence(F.col("seq_packed"), F.col("seq_length")), "tags": T.decode_tags("tags_raw")})
    j = full.select(C.record_json().alias("j"))
    get = lambda path, quote: F.coalesce(F.concat(F.lit(quote), F.get_json_object("j", path), F.lit(quote)), F.lit("null"))
    parts = [get("$.ref_id", ""), get("$.start", ""), get("$.name", '"'), get("$.mq", ""), get("$.cigar_string", '"'), get("$.tags.RG.s", '"')]
    return j.select(F.substring(F.get_json_object("j", "$.name"), 2, 20).cast("long").alias("id"), F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("fields"))


@query(f"select name, count(*) as n from ({D.PAIR_SQL}) where ref_id = 1 and {HIT.format(a=400000, b=600000)} group by name")
def e5_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_stats.name_counts(region.records_for_range(D.paired_reads(spark, sf_dir), 1, 400_000, 600_000))
