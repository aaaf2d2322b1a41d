"""Alignment records: header, reference table, and records as Arrow batches.

Fixed fields of all records of a window are gathered at once with numpy; only
the walk over record sizes is sequential. Expensive parts (bases, qualities,
tags) leave here packed, to be decoded by column expressions above the scan.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from readloom import ship
from readloom.codec import bgzf, tags

ship(__name__)

HEADER_LIMIT = 32 << 20
#: Fixed value: bit k is set when operation k of a CIGAR consumes the reference (M, D, N, =, X).
CONSUMES_REFERENCE = 0x18D

COLUMNS: dict[str, pa.DataType] = {
    "record_id": pa.int64(), "ref_id": pa.int32(), "ref_name": pa.string(), "start": pa.int32(), "end": pa.int32(), "length_on_ref": pa.int32(),
    "name": pa.string(), "flags": pa.int32(), "mq": pa.int32(), "num_cigar_ops": pa.int32(), "cigar": pa.list_(pa.int32()), "cigar_from_cg": pa.bool_(),
    "seq_length": pa.int32(), "seq_packed": pa.binary(), "qual": pa.binary(), "next_refid": pa.int32(), "next_pos": pa.int32(),
    "template_length": pa.int32(), "bin_mq_nl": pa.int32(), "tags_raw": pa.binary(),
    "flag_nc": pa.int64(), "num_cigar_bytes": pa.int32(), "num_seq_bytes": pa.int32(), "seq_start": pa.int32(), "tags_start": pa.int32(), "raw": pa.binary(),
}
#: Columns that a read gives only if they are asked for by name.
ON_REQUEST = ("flag_nc", "num_cigar_bytes", "num_seq_bytes", "seq_start", "tags_start", "raw")
SQL_SCHEMA = (
    "record_id long, ref_id int, ref_name string, start int, end int, length_on_ref int, name string, flags int, mq int, num_cigar_ops int, "
    "cigar array<int>, cigar_from_cg boolean, seq_length int, seq_packed binary, qual binary, next_refid int, next_pos int, template_length int, "
    "bin_mq_nl int, tags_raw binary"
)
FULL_SCHEMA = SQL_SCHEMA + ", flag_nc long, num_cigar_bytes int, num_seq_bytes int, seq_start int, tags_start int, raw binary"


@dataclass
class Header:
    text: str
    references: list[tuple[str, int]]
    #: virtual offset of the first record
    first_record: int

    def ids(self) -> dict[str, int]:
        """Reference ids by name; of equal names the last one counts."""
        return {name: i for i, (name, _) in enumerate(self.references)}


def parse_header_text(text: str) -> list[dict]:
    """Header lines as {tag, data: [{tag, value}]}."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if line:
            first, *rest = line.split("\t")
            data = []
            for part in rest:
                name, colon, v = part.partition(":")
                data.append({"tag": name, "value": v if colon else ""})
            out.append({"tag": first.removeprefix("@"), "data": data})
    return out


def parse_references(buf: bytes, at: int, rename: Callable[[str], str] | None = None) -> tuple[list[tuple[str, int]], int] | None:
    """The reference table at `at` and where it ends; None when it isn't all there."""
    if len(buf) < at + 4:
        return None
    n, at = struct.unpack_from("<i", buf, at)[0], at + 4
    out = []
    for _ in range(n):
        if len(buf) < at + 4:
            return None
        size = struct.unpack_from("<i", buf, at)[0]
        if len(buf) < at + 8 + size:
            return None
        name = buf[at + 4:at + 3 + size].decode("latin-1")
        out.append((rename(name) if rename else name, struct.unpack_from("<i", buf, at + 4 + size)[0]))
        at += 8 + size
    return out, at


def read_header(source: bgzf.Source, rename: Callable[[str], str] | None = None) -> Header:
    """Read blocks until the reference table is whole, but never more than HEADER_LIMIT."""
    data, bounds = b"", []
    for at, block in bgzf.blocks(source, window=1 << 16):
        bounds.append((len(data), at, len(block)))
        data += block
        if len(data) < 8:
            continue
        if data[:4] != b"BAM\1":
            raise ValueError("not a BAM file: wrong magic")
        size = struct.unpack_from("<i", data, 4)[0]
        if len(data) >= 8 + size and (table := parse_references(data, 8 + size, rename)):
            refs, end = table
            k = max(i for i, (d, _, _) in enumerate(bounds) if d <= end)
            d, at, n = bounds[k]
            first = (at + 0 << 16) | (end - d)
            if end - d == n:  # the record begins in the next block
                raw = source.read(at, 18)
                first = (at + bgzf.block_size(raw, 0)) << 16
            return Header(data[8:8 + size].rstrip(b"\0").decode("utf-8", "replace"), refs, first)
        if len(data) > HEADER_LIMIT:
            break
    raise bgzf.Truncated("the header is cut short" if data[:4] == b"BAM\1" else "not a BAM file: wrong magic")


def record_starts(buf: bytes, at: int) -> tuple[list[int], int]:
    """Starts of the whole records from `at` on, and where the first incomplete one begins."""
    out, n = [], len(buf)
    unpack = struct.Struct("<i").unpack_from
    while at + 4 <= n:
        size = unpack(buf, at)[0]
        if size < 32:
            raise ValueError(f"a record claims {size} bytes")
        if at + 4 + size > n:
            break
        out.append(at)
        at += 4 + size
    return out, at


def _plausible(raw: np.ndarray, n_refs: int, at: np.ndarray) -> np.ndarray:
    """Which places of a buffer may begin a record, by what a record's fixed fields and name must hold."""
    at = at[at + 36 <= len(raw)]
    if not len(at):
        return at
    num = lambda o, kind: raw[(at + o)[:, None] + np.arange(np.dtype(kind).itemsize)].view(kind)[:, 0].astype(np.int64)
    size, l_name, n_ops, l_seq = num(0, "<i4"), num(12, "u1"), num(16, "<u2"), num(20, "<i4")
    ok = (size >= 33) & (l_name > 0) & (l_seq >= 0) & (32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq <= size)
    for ref, pos in ((4, 8), (24, 28)):
        ok &= (num(ref, "<i4") >= -1) & (num(ref, "<i4") < max(1, n_refs)) & (num(pos, "<i4") >= -1)
    end = at + 35 + l_name
    ok &= (end < len(raw)) & (raw[np.minimum(end, len(raw) - 1)] == 0)
    at, end = at[ok], end[ok]
    owner, k = spread(at + 36, end)
    odd = (raw[k] < 33) | (raw[k] > 126)
    return at[np.bincount(owner[odd], minlength=len(at)) == 0]


def record_from(source: bgzf.Source, at: int, n_refs: int, least: int = 1 << 17) -> int | None:
    """Virtual offset of the first record that begins in a block at or after a byte; None if none does.

    A place begins a record if that looks like one and all that follow it do, for
    `least` bytes or up to the file's end. The answer depends on the file and the
    byte alone, so neighbours that ask for the same byte agree.
    """
    first = bgzf.block_from(source, at)
    if first is None:
        return None
    data, marks, skip = b"", [], 0
    blocks = bgzf.blocks(source, first)
    whole = False
    while True:
        while not whole and len(data) < skip + bgzf.MAX_BLOCK + least:
            block = next(blocks, None)
            if block is None:
                whole = True
            else:
                marks.append((len(data), block[0]))
                data += block[1]
        raw = np.frombuffer(data, np.uint8)
        stop = len(raw) if whole else skip + bgzf.MAX_BLOCK
        for u in _plausible(raw, n_refs, np.arange(skip, stop)).tolist():
            p = u
            while p + 36 <= len(raw) and len(_plausible(raw, n_refs, np.array([p]))):
                p += 4 + int.from_bytes(data[p:p + 4], "little")
                if p >= len(raw):
                    break
            # the last one may be cut by the end of what was read, but not by the file's
            if p == len(raw) if whole else p >= min(len(raw) - 36 - 255, u + least):
                k = max(i for i, (m, _) in enumerate(marks) if m <= u)
                return marks[k][1] << 16 | (u - marks[k][0])
        if whole:
            return None
        skip = stop


def reference_span(words: np.ndarray) -> int:
    words = words.view(np.uint32) if words.dtype != np.uint32 else words
    return int(((words >> 4) * ((CONSUMES_REFERENCE >> (words & 15)) & 1)).sum())


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), each with the index of its range."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)


def batch(buf: bytes, starts: list[int], ids: np.ndarray, names: list[str], columns: list[str] | None = None) -> pa.RecordBatch:
    """Records of a buffer as a batch with the wanted columns only."""
    want = columns or [c for c in COLUMNS if c not in ON_REQUEST]
    at = np.array(starts, np.int64)
    raw = np.frombuffer(buf, np.uint8)
    fixed = raw[at[:, None] + np.arange(36)] if len(at) else np.zeros((0, 36), np.uint8)
    num = lambda o, kind: np.ascontiguousarray(fixed[:, o:o + np.dtype(kind).itemsize]).view(kind)[:, 0].astype(np.int64)
    size, ref_id, start, flags, n_ops, l_seq = num(0, "<i4"), num(4, "<i4"), num(8, "<i4"), num(18, "<u2"), num(16, "<u2"), num(20, "<i4")
    l_name, mapq = num(12, "u1"), num(13, "u1")
    name_at = at + 36
    ops_at = name_at + l_name
    seq_at = ops_at + 4 * n_ops
    qual_at = seq_at + (l_seq + 1) // 2
    tags_at = qual_at + l_seq
    end_at = at + 4 + size

    owner, k = spread(np.zeros(len(at), np.int64), n_ops)
    words = raw[(ops_at[owner] + 4 * k)[:, None] + np.arange(4)].view("<u4")[:, 0] if len(k) else np.zeros(0, np.uint32)
    begin = np.cumsum(n_ops) - n_ops
    # a long CIGAR is stored as <read length>S<span>N, with the real one in the CG tag
    placed = n_ops == 2
    first = words[begin[placed]]
    placed[placed] = ((first & 15) == 4) & (first >> 4 == l_seq[placed])
    spans = (words >> 4).astype(np.int64) * ((CONSUMES_REFERENCE >> (words & 15).astype(np.int64)) & 1)
    total = np.concatenate([[0], np.cumsum(spans)])
    span = total[begin + n_ops] - total[begin]
    counts = n_ops
    if placed.any():
        parts = np.split(words, begin[1:])
        for i in np.flatnonzero(placed):
            span[i] = parts[i][1] >> 4
            got = tags.find(buf[tags_at[i]:end_at[i]], "CG")
            parts[i] = np.array(got[1] if got and isinstance(got[1], list) else [], np.int64).astype(np.uint32)
        words, counts = np.concatenate(parts), np.array([len(w) for w in parts])
    span = np.where(flags & 4, 0, span)

    ends = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int32)

    def cut(low: np.ndarray, high: np.ndarray, kind: pa.DataType = pa.binary(), valid: np.ndarray | None = None) -> pa.Array:
        """The buffer's bytes [low, high) of each record."""
        _, places = spread(low, high)
        mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        return pa.Array.from_buffers(kind, len(low), [mask, pa.py_buffer(ends(high - low)), pa.py_buffer(raw[places].tobytes())])

    def name_texts() -> pa.Array:
        found = cut(name_at, name_at + l_name - 1)
        plain = np.frombuffer(found.buffers()[2], np.uint8)
        return found.cast(pa.string()) if not len(plain) or plain.max() < 128 else pa.array([x.decode("latin-1") for x in found.to_pylist()], pa.string())

    def ref_names() -> pa.Array:
        known = (ref_id >= 0) & (ref_id < len(names))
        return pa.array(names, pa.string()).take(pa.array(ref_id, mask=~known))

    number = lambda x: pa.array(x.astype(np.int32))
    make: dict[str, Callable[[], pa.Array]] = {
        "record_id": lambda: pa.array(ids.astype(np.int64)),
        "ref_id": lambda: number(ref_id),
        "ref_name": ref_names,
        "start": lambda: number(start),
        "end": lambda: number(start + span),
        "length_on_ref": lambda: number(span),
        "name": name_texts,
        "flags": lambda: number(flags),
        "mq": lambda: pa.array(mapq.astype(np.int32), mask=mapq == 255),
        "num_cigar_ops": lambda: number(n_ops),
        "cigar": lambda: pa.ListArray.from_arrays(pa.array(ends(counts)), pa.array(words.astype(np.uint32).view(np.int32))),
        "cigar_from_cg": lambda: pa.array(placed),
        "seq_length": lambda: number(l_seq),
        "seq_packed": lambda: cut(seq_at, qual_at),
        "qual": lambda: cut(qual_at, tags_at, valid=l_seq > 0),
        "next_refid": lambda: number(num(24, "<i4")),
        "next_pos": lambda: number(num(28, "<i4")),
        "template_length": lambda: number(num(32, "<i4")),
        "bin_mq_nl": lambda: number(num(12, "<i4")),
        "tags_raw": lambda: cut(tags_at, end_at),
        "flag_nc": lambda: pa.array(flags << 16 | n_ops),
        "num_cigar_bytes": lambda: number(4 * n_ops),
        "num_seq_bytes": lambda: number(qual_at - seq_at),
        # places are counted from the record's first byte, its size included
        "seq_start": lambda: number(seq_at - at),
        "tags_start": lambda: number(tags_at - at),
        "raw": lambda: cut(at, end_at),
    }
    return pa.RecordBatch.from_arrays([make[c]() for c in want], schema=pa.schema([(c, COLUMNS[c]) for c in want]))


def records(source: bgzf.Source, begin: int, stop: int | None, window: int = 1 << 20) -> Iterator[tuple[bytes, list[int], np.ndarray]]:
    """(buffer, record starts, virtual offsets) by window, for records that begin in [begin, stop).

    Without `stop` the file is read to its end, where a cut record is an error.
    A record that straddles blocks or windows is carried.
    """
    carry, parts, filled = b"", [], 0
    marks: list[tuple[int, int, int]] = []  # position in the buffer, block offset, position in the block

    def cut() -> tuple[bytes, list[int], np.ndarray, int, int]:
        """The buffer, its whole records, and where (in the buffer, in the file) the next one begins."""
        buf = carry + b"".join(parts)
        starts, end = record_starts(buf, 0)
        pos, block, inside = (np.array([m[j] for m in marks], np.int64) for j in range(3))
        at = np.array([*starts, end], np.int64)
        k = np.searchsorted(pos, at, side="right") - 1
        ids = (block[k] << 16) + inside[k] + at - pos[k]
        return buf, starts, ids[:-1], end, int(ids[-1])

    for at, data in bgzf.blocks(source, begin >> 16, window):
        skip = min(begin & 0xFFFF, len(data)) if at == begin >> 16 else 0
        if len(data) == skip:
            continue
        marks.append((len(carry) + filled, at, skip))
        parts.append(data[skip:])
        filled += len(data) - skip
        past = stop is not None and at << 16 >= stop
        if filled < window and not past:
            continue
        buf, starts, ids, end, following = cut()
        keep = len(starts) if stop is None else int(np.searchsorted(ids, stop))
        if keep:
            yield buf, starts[:keep], ids[:keep]
        if stop is not None and (keep < len(starts) or (past and (following >= stop or end == len(buf)))):
            return
        rest = [m for m in marks if m[0] > end]
        if end < len(buf):
            held = next(m for m in reversed(marks) if m[0] <= end)
            rest.insert(0, (end, held[1], held[2] + end - held[0]))
        marks = [(m[0] - end, m[1], m[2]) for m in rest]
        carry, parts, filled = buf[end:], [], 0
    if not marks:
        return
    buf, starts, ids, end, _ = cut()
    if stop is None and end < len(buf):
        raise bgzf.Truncated("file ends inside a record")
    keep = len(starts) if stop is None else int(np.searchsorted(ids, stop))
    if keep:
        yield buf, starts[:keep], ids[:keep]
