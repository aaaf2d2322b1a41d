"""Data sources `bam`, `bam_header` and `bam_index`.

`bam` plans a read on the driver: regions become chunks of the index, one input
partition each; without a region the whole file is cut at record boundaries that
the index knows. Without an index it is cut at bytes, and each task looks for the
first record after its byte and the next one's. `columns` narrows
what the decoder makes. Options arrive in lower case.

A region comes from the option `region` (`region_reads` sets it). Filters of a
query can plan too, with option `pushdown` true: every filter is handed back, so
Spark applies it again. It is off by default, because Spark keeps what a query
pushed with the DataFrame and reuses it for a later query without filters; such
a DataFrame must serve one query only, as in `region_reads`.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from readloom import ship
from readloom.codec import bam, bgzf, index
from readloom.streaming.arrivals import ArrivalReader

ship(__name__)

#: Compressed bytes that a partition of a full scan aims at.
SPLIT_BYTES = 32 << 20


@dataclass
class Piece(InputPartition):
    path: str
    begin: int
    stop: int | None
    region: tuple[int, int, int] | None = None


@dataclass
class Span(InputPartition):
    """The records from the first one after a byte (-1: of the file) to the first one after another (None: all)."""

    path: str
    low: int
    high: int | None


def renamer(options: dict[str, str]) -> Callable[[str], str] | None:
    """Option `rename`: pairs old=new, separated by commas."""
    pairs = dict(p.split("=", 1) for p in options.get("rename", "").split(",") if "=" in p)
    return (lambda n: pairs.get(n, n)) if pairs else None


def _parsed(path: str, most: int = 5) -> index.Index:
    """The index at a path, parsed once for each state of the file; the last few are kept in this process."""
    held = sys.modules.setdefault("_readloom_indexes", types.ModuleType("_readloom_indexes")).__dict__.setdefault("by_state", {})
    source = bgzf.Source(path)
    state = source.state()
    if state is None:
        return index.parse(source.all())
    found = held.pop((path, state), None) or index.parse(source.all())
    held[path, state] = found  # the last one used comes last
    while len(held) > most:
        held.pop(next(iter(held)))
    return found


def open_index(options: dict[str, str]) -> index.Index | None:
    """Explicit index path first, then siblings of the file: CSI before BAI."""
    path = options["path"]
    if given := options.get("index"):
        return _parsed(given)
    if options.get("useindex", "true") == "false":
        return None
    for name in (path + ".csi", path + ".bai", re.sub(r"\.bam$", ".bai", path)):
        if name != path and bgzf.Source(name).exists():
            return _parsed(name)
    return None


def parse_region(text: str) -> tuple[str, int, int]:
    """`name`, or `name:start-end`, 0-based and half-open; a name may hold colons."""
    m = re.fullmatch(r"(.*):(\d+)-(\d+)", text)
    if not m:
        return text, 0, 1 << 62
    name, start, end = m[1], int(m[2]), int(m[3])
    if start > end:
        raise ValueError(f"region {text}: its start is after its end")
    return name, start, end


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        if not (want := self.options.get("columns")):
            return bam.SQL_SCHEMA
        kinds = dict(x.strip().split(" ", 1) for x in bam.FULL_SCHEMA.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in want.split(","))

    def reader(self, schema) -> DataSourceReader:
        kind = PlanningReader if self.options.get("pushdown") == "true" else BamReader
        return kind(dict(self.options), schema.fieldNames())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ArrivalReader(dict(self.options), schema.fieldNames())


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        if "path" not in options:
            raise ValueError("no source: option path is missing")
        self.options, self.columns = options, columns
        self.window = int(options.get("window", 1 << 20))
        source = bgzf.Source(options["path"])
        self.header = bam.read_header(source, renamer(options))
        self.regions = [parse_region(r) for r in options.get("region", "").split(";") if r]
        self.names = [n for n, _ in self.header.references]
        self.low, self.high, self.only = 0, 1 << 62, None

    def partitions(self) -> list[InputPartition]:
        path, found = self.options["path"], open_index(self.options)
        ids = self.header.ids()
        wanted = [(ids.get(n, -2), s, e) for n, s, e in self.regions]
        if not wanted and self.only is not None and self.only >= 0:
            wanted = [(self.only, max(0, self.low), self.high)]
        if wanted and found is not None:
            out, seen = [], set()
            for ref_id, start, end in wanted:
                for c in found.chunks(ref_id, start - 1, min(end, 1 << 60)) if ref_id >= 0 else []:
                    if len(wanted) == 1 or c.key() not in seen:
                        out.append(Piece(path, c.begin, c.stop, (ref_id, start, end) if len(wanted) == 1 else None))
                        seen.add(c.key())
            if len(wanted) > 1:  # regions may share chunks
                merged = index.disjoint(index.join([index.Chunk(p.begin, p.stop) for p in out], None))
                out = [Piece(path, c.begin, c.stop) for c in merged]
            return out or [Piece(path, 0, 0)]
        split = int(self.options.get("splitbytes", SPLIT_BYTES))
        if found is None:
            size = bgzf.Source(path).size() or 0
            cuts = [-1, *range((self.header.first_record >> 16) + split, size - split // 2, split), None]
            return [Span(path, a, b) for a, b in zip(cuts, cuts[1:])]
        marks = sorted({c.begin for r in found.refs for cs in r.bins.values() for c in cs} | {v for r in found.refs for v in r.linear if v})
        cuts = [self.header.first_record]
        for v in marks:
            if (v >> 16) - (cuts[-1] >> 16) >= split:
                cuts.append(v)
        return [Piece(path, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]

    def read(self, piece: Piece | Span) -> Iterator[pa.RecordBatch]:
        if isinstance(piece, Span):
            source, n = bgzf.Source(piece.path), len(self.names)
            begin = self.header.first_record if piece.low < 0 else bam.record_from(source, piece.low, n)
            if begin is None:
                return
            piece = Piece(piece.path, begin, None if piece.high is None else bam.record_from(source, piece.high, n))
        if piece.stop == 0:
            return
        want = self.regions and [(self.header.ids().get(n, -2), s, e) for n, s, e in self.regions]
        for buf, starts, offsets in bam.records(bgzf.Source(piece.path), piece.begin, piece.stop, self.window):
            need = [*self.columns, *(c for c in ("ref_id", "start", "end") if c not in self.columns)] if want else self.columns
            out = bam.batch(buf, starts, offsets, self.names, need)
            if want:
                keep = overlapping(out, want)
                if keep.any():
                    yield out.filter(pa.array(keep)).select(self.columns)
                ref, first, _ = want[0]
                last = out.num_rows and (out.column("ref_id")[-1].as_py(), out.column("start")[-1].as_py())
                if len(want) == 1 and piece.region and last and "SO:coordinate" in self.header.text and (last[0] > ref or last[0] == ref and last[1] >= want[0][2]):
                    return  # sorted: what follows lies beyond the region
            else:
                yield out


class PlanningReader(BamReader):
    """A reader that plans by the query's filters and hands all of them back."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            match f:
                case EqualTo(("ref_name",), v):
                    self.only = self.header.ids().get(v, -2)
                case EqualTo(("ref_id",), v):
                    self.only = v
                case LessThan(("start",), v):
                    self.high = min(self.high, v)
                case LessThanOrEqual(("start",), v):
                    self.high = min(self.high, v + 1)
                case GreaterThan(("end",), v) | GreaterThan(("start",), v):
                    self.low = max(self.low, v)
                case GreaterThanOrEqual(("start",), v) | GreaterThanOrEqual(("end",), v):
                    self.low = max(self.low, v - 1)
            yield f


def overlapping(batch: pa.RecordBatch, regions: list[tuple[int, int, int]]):
    ref, start, end = (batch.column(c).to_numpy() for c in ("ref_id", "start", "end"))
    stop = np.maximum(end, start + 1)  # a record without span counts as one base
    keep = np.zeros(len(ref), bool)
    for r, a, b in regions:
        keep |= (ref == r) & (start < b) & (stop > a)
    return keep


class HeaderSource(DataSource):
    """One row: header_text, lines and the reference table."""

    @classmethod
    def name(cls) -> str:
        return "bam_header"

    def schema(self) -> str:
        return "header_text string, lines array<struct<tag:string,data:array<struct<tag:string,value:string>>>>, references array<struct<ref_id:int,ref_name:string,length:int>>"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(dict(self.options))


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        h = bam.read_header(bgzf.Source(self.options["path"]), renamer(self.options))
        yield h.text, [(x["tag"], [(d["tag"], d["value"]) for d in x["data"]]) for x in bam.parse_header_text(h.text)], [(i, n, size) for i, (n, size) in enumerate(h.references)]


class IndexSource(DataSource):
    """Option `part`: chunks (default), linear, stats, density, first (the smallest offset of data) or tabix. Option `path`: the index file."""

    PARTS = {
        "chunks": "ref_id int, bin int, min_block long, min_data int, max_block long, max_data int, end_position long",
        "linear": "ref_id int, window int, block long, data int",
        "stats": "ref_id int, mapped long",
        "density": "ref_id int, start long, end long, score double",
        "first": "block long, data int",
        "tabix": "format string, coordinates string, ref_column int, start_column int, end_column int, meta string, skip_lines int, names array<string>",
    }

    @classmethod
    def name(cls) -> str:
        return "bam_index"

    def schema(self) -> str:
        return self.PARTS[self.options.get("part", "chunks")]

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(dict(self.options))


class IndexReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        found, part = index.parse(bgzf.Source(self.options["path"]).all()), self.options.get("part", "chunks")
        if part == "first":
            if (v := found.first_data()) is not None:
                yield index.unpack_offset(v)
            return
        if part == "tabix":
            if t := index.tabix_details(found.aux):
                c = t["columns"]
                yield t["format"], t["coordinates"], c["ref"], c["start"], c["end"], t["meta"], t["skip_lines"], t["names"]
            return
        for r, ref in enumerate(found.refs):
            if part == "chunks":
                for b in sorted(ref.bins):
                    for c in ref.bins[b]:
                        yield r, b, c.begin >> 16, c.begin & 0xFFFF, c.stop >> 16, c.stop & 0xFFFF, c.end_position
            elif part == "linear":
                for w, v in enumerate(ref.linear):
                    yield r, w, v >> 16, v & 0xFFFF
            elif part == "stats":
                yield r, ref.mapped or 0
            else:
                for a, b, score in found.density(r):
                    yield r, a, b, score


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    from readloom.sources.htsget import HtsgetSource

    for source in (BamSource, HeaderSource, IndexSource, HtsgetSource):
        spark.dataSource.register(source)


def read_bam(spark: SparkSession, path: str, record: Callable[[DataFrame], DataFrame] | None = None, **options: str) -> DataFrame:
    """The file's records. `record` turns the table into the caller's own kind of records.

    Option pushdown=true sets spark.sql.python.filterPushdown.enabled, without
    which Spark hands no filters to a source that is written in Python.
    """
    register(spark)
    if record is not None:
        return read_bam(spark, path, **options).transform(record)
    if options.get("pushdown") == "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bam").options(**options).load(path)


def region_reads(spark: SparkSession, path: str, ref_name: str, start: int, end: int, **options: str) -> DataFrame:
    """The flagship: records of a reference that overlap [start, end), read through the index."""
    from readloom.operators.region import records_for_range

    return records_for_range(read_bam(spark, path, region=f"{ref_name}:{start}-{end}", **options), ref_name, start, end)


def ref_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(ref_id, ref_name, length) of the file's references."""
    from pyspark.sql import functions as F

    register(spark)
    return spark.read.format("bam_header").options(**options).load(path).select(F.explode("references").alias("r")).select("r.*")


def chunk_plan(path: str, ref_name: str, start: int, end: int, **options: str) -> list[index.Chunk]:
    """The reads that a query would make, without making them."""
    found = open_index({"path": path, **options})
    ids = bam.read_header(bgzf.Source(path), renamer(options)).ids()
    return found.chunks(ids[ref_name], start, end) if found and ref_name in ids else []


def estimated_bytes(path: str, regions: list[tuple[str, int, int]], **options: str) -> int:
    """Forecast of the bytes that regions will fetch, from the index alone; unknown names count nothing."""
    found = open_index({"path": path, **options})
    ids = bam.read_header(bgzf.Source(path), renamer(options)).ids()
    return found.forecast([(ids[n], s, e) for n, s, e in regions if n in ids]) if found else 0


def has_ref(path: str, ref_name: str, **options: str) -> bool:
    found = open_index({"path": path, **options})
    return found is not None and found.has_ref(bam.read_header(bgzf.Source(path), renamer(options)).ids().get(ref_name))


def line_count(path: str, ref_name: str, **options: str) -> int:
    found = open_index({"path": path, **options})
    return found.line_count(bam.read_header(bgzf.Source(path), renamer(options)).ids().get(ref_name)) if found else 0
