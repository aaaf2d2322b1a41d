"""Alignments derived from the driver's tables by arithmetic, the same in any SQL engine."""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import ship
from readloom.codec import bgzf, index, writer
from readloom.shared import Piece, delete, exists, put, qualified, shared_dir

ship(__name__)

#: Reads from lineitem: flags and places; no unique key.
LINE_READS = [
    "l_orderkey", "l_linenumber", "cast(l_suppkey % 4 as int) as ref_id",
    "cast((l_orderkey * 37 + l_partkey * 11 + l_linenumber * 101) % 1000000 as int) as start",
    "cast(50 + (l_partkey % 101) as int) as span", "cast((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 4096 as int) as flags",
]
#: Reads from orders: unique record_id, two of a name.
ORDER_READS = [
    "o_orderkey as record_id", "cast(floor(o_orderkey / 2) as bigint) as pair_id", "cast(o_custkey % 3 as int) as ref_id",
    "cast((o_orderkey * 8191 + o_custkey * 131) % 1000000 as int) as start", "cast(50 + o_custkey % 101 as int) as span",
    "cast((o_orderkey * 13 + o_custkey * 5) % 4096 as int) as flags", "cast((o_orderkey * 3 + o_custkey) % 256 as int) as raw_mq",
]
SPAN_END = 'start + case when (flags & 4) <> 0 then 0 else span end'

LINE_SQL = f"select {', '.join(LINE_READS)} from lineitem"
LINE_SQL = f'select *, cast({SPAN_END} as int) as "end" from ({LINE_SQL})'
ORDER_SQL = f"select {', '.join(ORDER_READS)} from orders"
PAIR_SQL = f"""select a.record_id, cast(a.pair_id as varchar) as name, a.ref_id, a.start, a.flags, a.raw_mq, a.span, cast(a.start + a.span as int) as "end",
  b.ref_id as next_refid, b.start as next_pos from ({ORDER_SQL}) a join ({ORDER_SQL}) b on a.pair_id = b.pair_id and a.record_id <> b.record_id"""
REFS = [("chrA", 1_000_200), ("chrB", 1_000_200), ("chrC", 1_000_200), ("chrD", 5000)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "lineitem").selectExpr(*LINE_READS)
    return reads.selectExpr("*", f"cast({SPAN_END} as int) as `end`")


def order_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*ORDER_READS)


def paired_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = order_reads(spark, sf_dir)
    b = a.selectExpr("pair_id as _pair", "record_id as _other", "ref_id as next_refid", "start as next_pos")
    both = a.join(b, (a.pair_id == b._pair) & (a.record_id != b._other))
    return both.selectExpr("record_id", "cast(pair_id as string) as name", "ref_id", "start", "flags", "raw_mq", "span", "cast(start + span as int) as `end`", "next_refid", "next_pos")


def table_state(spark: SparkSession, path: str) -> str:
    """Name, size and modification time of each file of a table, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(out))


TEXT = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in REFS) + "@CO\tderived: from orders\n"
BLOCK = 60_000  # bytes of records in a block of the file
ROWS = 250_000  # of the table in a part of the file, at most, but for more in one window
WINDOW = 256  # places of which rows and bytes are counted together: some 12,000 sums, whatever the table's size
RECORD_BYTES = "4 + 32 + length(concat('r', record_id)) + 1 + 4 + (span + 1) div 2 + span + 13"


def _record(record_id: int, ref_id: int, start: int, n: int, flags: int, mq: int) -> dict:
    return {
        "ref_id": ref_id, "start": start, "name": f"r{record_id}", "flags": flags, "mq": mq, "cigar": [n << 4], "seq": "ACGT" * (n // 4) + "ACGT"[: n % 4],
        "qual": bytes([record_id % 40]) * n, "tags": [("NM", "i", record_id % 7), ("RG", "Z", f"g{record_id % 3}")],
    }


def _encoder(folder: str, begins: list[int]):
    """Writes each part of sorted rows to a file; a row for each, with what the index needs of it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "record_id", "ref_id", "start", "span", "flags", "raw_mq")), strict=True))
        for part, of in groupby(rows, key=itemgetter(0)):
            path, places = f"{folder}/{part}-{uuid.uuid4().hex}", writer.Gathered()  # another attempt has another name
            with bgzf.sink(path) as out:
                for piece in writer.stored_part((_record(*r[1:]) for r in of), begins[part], begins[part + 1], HEAD_SIZE, places, BLOCK):
                    out.write(piece)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "places": [pickle.dumps((places.refs, places.last))]})

    return encode


def bam_file(spark: SparkSession, sf_dir: str) -> str:
    """A coordinate-sorted file of the order reads with its indexes, made once for each state of the table.

    Its blocks are stored, not compressed, so that every offset follows from the
    sizes of the records before it, by arithmetic that SQL can do too. So executors
    encode its parts apart; the driver only joins them, by the JVM's streams.
    """
    key = hashlib.sha1(f"{sf_dir}\n{table_state(spark, f'{sf_dir}/orders.parquet')}".encode()).hexdigest()[:12]
    path = qualified(spark, f"{shared_dir(spark)}/alignments/{key}.bam")
    if exists(spark, path + ".csi"):
        return path
    reads = order_reads(spark, sf_dir).withColumn("window", F.expr(f"cast(floor(start / {WINDOW}) as int)"))
    sums = reads.groupBy("ref_id", "window").agg(F.count("*").alias("n"), F.sum(F.expr(RECORD_BYTES)).alias("size")).collect()
    dealt, begins, rows, total = [], [0], 0, 0
    for ref, window, n, size in sorted(sums):
        if rows and rows + n > ROWS:
            begins.append(total)
            rows = 0
        dealt.append((ref, window, len(begins) - 1))
        rows, total = rows + n, total + size
    begins.append(total)
    places, folder = writer.Gathered(), f"{path}.parts-{uuid.uuid4().hex}"
    try:
        made = []
        if dealt:
            put(spark, f"{folder}/begun", [])  # so that the folder is there
            parts = F.broadcast(spark.createDataFrame(dealt, "ref_id int, window int, part int"))
            ordered = reads.join(parts, ["ref_id", "window"]).repartitionById(len(begins) - 1, "part").sortWithinPartitions("part", "ref_id", "start", "record_id")
            made = sorted(ordered.mapInArrow(_encoder(folder, begins), "part int, path string, places binary").collect())
            for part, _, found in made:
                other = writer.Gathered()
                other.refs, other.last = pickle.loads(found)
                places.extend(other, writer.stored_offset(begins[part], HEAD_SIZE, BLOCK))
            if [m.part for m in made] != list(range(len(begins) - 1)):
                raise ValueError("not every part of the alignment file was written once")

        def files():
            for m in made:
                yield m.path, begins[m.part], begins[m.part + 1]
                delete(spark, m.path)

        size = put(spark, path, writer.joined_parts(TEXT, REFS, files(), Piece, BLOCK))
    finally:
        delete(spark, folder)
    for kind in ("bai", "csi"):
        put(spark, f"{path}.{kind}", [writer.index_bytes(places, len(REFS), size - len(bgzf.EOF_BLOCK) << 16, kind)])
    return path


#: Where `bam_file` puts each record: begin and stop are virtual offsets, bin that of the index.
HEAD_SIZE = len(writer.head_bytes(TEXT, REFS)) + bgzf.STORED
_VIRTUAL = f"(({HEAD_SIZE} + (p // {BLOCK}) * {BLOCK + bgzf.STORED}) << 16) | (p % {BLOCK})"
_BIN = " ".join(f"when a >> {14 + 3 * k} = (b - 1) >> {14 + 3 * k} then {((1 << 3 * (5 - k)) - 1) // 7} + (a >> {14 + 3 * k})" for k in range(5))
PLACED_SQL = f"""select ref_id, a, b, mapped, n, begin, lead(begin, 1, finish) over (order by n) as stop, cast(case {_BIN} else 0 end as bigint) as bin
  from (select *, {_VIRTUAL} as begin, ({HEAD_SIZE} + (total // {BLOCK}) * {BLOCK + bgzf.STORED} + case when total % {BLOCK} > 0 then total % {BLOCK} + {bgzf.STORED} else 0 end) << 16 as finish
    from (select *, cast(sum(size) over (order by n) - size as bigint) as p, cast(sum(size) over () as bigint) as total
      from (select cast(ref_id as bigint) as ref_id, cast(start as bigint) as a, cast(start + case when (flags & 4) <> 0 then 1 else span end as bigint) as b, (flags & 4) = 0 as mapped,
        row_number() over (order by ref_id, start, record_id) as n, 4 + 32 + length('r' || record_id) + 1 + 4 + (span + 1) // 2 + span + 13 as size from ({ORDER_SQL}))))"""
#: The index's chunks: runs of records of one bin that follow each other.
CHUNK_SQL = f"""select ref_id, bin, min(begin) as begin, max(stop) as stop from (select *, n - row_number() over (partition by ref_id, bin order by n) as island from ({PLACED_SQL})) group by ref_id, bin, island"""
#: The linear index: the first record that touches each window, or what the window before has.
LINEAR_SQL = f"""select ref_id, w, coalesce(last_value(first ignore nulls) over (partition by ref_id order by w), 0) as v from
  (select ref_id, unnest(range(max(last) + 1)) as w from (select ref_id, (b - 1) >> 14 as last from ({PLACED_SQL})) group by ref_id) left join
  (select ref_id, w, min(begin) as first from (select ref_id, begin, unnest(range(a >> 14, ((b - 1) >> 14) + 1)) as w from ({PLACED_SQL})) group by ref_id, w) using (ref_id, w)"""


def plan_sql(regions: list[tuple[int, int, int]], kind: str, forecast: bool = False) -> str:
    """The reads of regions (ref_id, start, end), by SQL: begin, stop, end_position.

    Chunks of all bins that may hold a region, close ones joined from the first to
    the last, without overlaps, each ended at the next known block boundary. With
    `forecast`, those of several regions together, and of a BAI index only the
    chunks before the block at which data beyond a region begins, but six at least.
    """
    def joined(chunks: str, name: str) -> str:
        return f"""{name}o as materialized (select begin, stop, row_number() over (order by begin, stop) as i from ({chunks})),
  {name}r as (select i, begin, stop, 1 as g from {name}o where i = 1 union all
    select o.i, case when near then r.begin else o.begin end, case when near then greatest(r.stop, o.stop) else o.stop end, case when near then g else g + 1 end
    from (select r.*, o.i as j, (o.begin >> 16) - (r.stop >> 16) < 65000 and (greatest(o.stop, r.stop) >> 16) - (r.begin >> 16) < 5000000 as near from {name}r r join {name}o o on o.i = r.i + 1) r join {name}o o on o.i = r.j),
  {name}g as (select min(begin) as begin, max(stop) as stop, g from {name}r group by g),
  {name}d as (select greatest(begin, coalesce(max(stop) over (order by g rows between unbounded preceding and 1 preceding), 0)) as begin, stop, g from {name}g),
  {name}p as (select begin, stop, g from {name}d where begin < stop)"""

    def tightened(name: str, refs: str) -> str:
        bounds = f"select begin >> 16 as x from chunks where ref_id in ({refs}) union select begin >> 16 from {name}p" + (f" union select v >> 16 from linear where ref_id in ({refs})" if kind == "bai" else "")
        return f"select begin, stop, least((stop >> 16) + 65536, coalesce((select min(x) from ({bounds}) where x > stop >> 16), (stop >> 16) + 65536)) as end_position from {name}p"

    parts = [f"chunks as materialized ({CHUNK_SQL})", f"linear as materialized ({LINEAR_SQL})"]
    picked = []
    for k, (ref, start, end) in enumerate(regions):
        bins = " or ".join(f"bin between {lo} and {hi}" for lo, hi in index.bin_ranges(start, end, kind=kind))
        floor = f"(select v from linear where ref_id = {ref} and w = least({start >> 14}, (select max(w) from linear where ref_id = {ref})))" if kind == "bai" else "0"
        parts.append(joined(f"select begin, stop from chunks where ref_id = {ref} and ({bins}) and stop > {floor}", f"c{k}"))
        bound = f"(select v >> 16 from linear where ref_id = {ref} and w = {(end >> 14) + 1})" if kind == "bai" else "cast(null as bigint)"
        parts.append(f"l{k} as (select begin, stop from (select *, {bound} as x, row_number() over (order by g) as i, count(*) filter (where begin >> 16 < {bound}) over () as before from c{k}p) where x is null or before = 0 or i <= greatest(before, 6))")
        picked.append(f"select begin, stop from l{k}")
    refs = ", ".join(str(r) for r, *_ in regions)
    if forecast:
        parts.append(joined(" union all ".join(picked), "all_"))
    return f"with recursive {', '.join(parts)} {tightened('all_' if forecast else 'c0', refs)}"
