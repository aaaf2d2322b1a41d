"""A minimal BAM and BAI/CSI writer, for fixtures and round trips."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from readloom import ship
from readloom.codec import bgzf, tags
from readloom.codec.bam import CONSUMES_REFERENCE

ship(__name__)

#: Fixed values of the format: letters of CIGAR operations and of packed bases.
OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"


def cigar_words(text: str) -> list[int]:
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            out.append(int(n) << 4 | OPS.index(c))
            n = ""
    return out


#: Each letter's code as a hexadecimal digit; any other byte gives none.
_DIGITS = bytes(b"0123456789abcdef"[BASES.index(chr(c))] if chr(c) in BASES else ord("x") for c in range(256))


def pack_bases(seq: str) -> bytes:
    return bytes.fromhex((seq.encode("latin-1").translate(_DIGITS) + b"0" * (len(seq) % 2)).decode())


def encode_record(r: dict[str, Any]) -> bytes:
    """r: ref_id, start, name, flags, mq, cigar (words), seq, qual, next_refid, next_pos, template_length, tags [(name, type, value)]."""
    name = r.get("name", "*").encode("latin-1") + b"\0"
    words, seq = r.get("cigar", []), r.get("seq", "")
    qual = r.get("qual")
    body = struct.pack(
        "<iiBBHHHiiii", r.get("ref_id", -1), r.get("start", -1), len(name), r.get("mq", 255), 0, len(words), r.get("flags", 0), len(seq),
        r.get("next_refid", -1), r.get("next_pos", -1), r.get("template_length", 0),
    )
    body += name + struct.pack(f"<{len(words)}I", *words) + pack_bases(seq) + (bytes(qual) if qual is not None else b"\xff" * len(seq))
    body += b"".join(tags.encode(*t) for t in r.get("tags", [])) + r.get("tail", b"")
    return struct.pack("<i", len(body)) + body


Place = tuple[int, int, int, int, bool]  # ref_id, start, end, virtual offset, mapped


def place(r: dict[str, Any], at: int) -> Place:
    """A record's place, by its virtual offset."""
    mapped = not r.get("flags", 0) & 4
    start = r.get("start", -1)
    return r.get("ref_id", -1), start, start + (sum(w >> 4 for w in r.get("cigar", []) if CONSUMES_REFERENCE >> (w & 15) & 1) if mapped else 0), at, mapped


def head_bytes(text: str, references: list[tuple[str, int]]) -> bytes:
    """The file's header and reference table."""
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(references))
    for name, n in references:
        head += struct.pack("<i", len(name) + 1) + name.encode("latin-1") + b"\0" + struct.pack("<i", n)
    return head


def bam_blocks(text: str, references: list[tuple[str, int]], rows: Iterable[dict[str, Any]], places: list[Place] | Gathered, block: int = 60_000, level: int = 6) -> Iterator[bytes]:
    """The file's parts one after another; to `places` a row is appended for each record, for an index.

    The header fills blocks of its own; records fill blocks of `block` bytes each,
    the last one less.
    """
    at, pending = 0, bytearray()
    head = head_bytes(text, references)
    for i in range(0, len(head), block):
        part = bgzf.deflate(head[i:i + block], level)
        at += len(part)
        yield part
    for r in rows:
        places.append(place(r, at << 16 | len(pending)))
        pending += encode_record(r)
        while len(pending) >= block:
            part = bgzf.deflate(bytes(pending[:block]), level)
            del pending[:block]
            at += len(part)
            yield part
    if pending:
        yield bgzf.deflate(bytes(pending), level)
    yield bgzf.EOF_BLOCK


def stored_offset(p: int, base: int, block: int = 60_000) -> int:
    """The virtual offset of byte `p` of all records, in stored blocks of `block` bytes from the file's byte `base` on."""
    return base + p // block * (block + bgzf.STORED) << 16 | p % block


def stored_part(rows: Iterable[dict[str, Any]], at: int, stop: int, base: int, places: list[Place] | Gathered, block: int = 60_000) -> Iterator[bytes]:
    """The records that are bytes `at` to `stop` of all, in pieces: up to a block's end as they are, then whole stored blocks, then the rest as it is.

    `joined_parts` makes of such parts what `bam_blocks` makes of all rows at level 0.
    """
    p, pending, head = at, bytearray(), -at % block
    for r in rows:
        places.append(place(r, stored_offset(p, base, block)))
        record = encode_record(r)
        p += len(record)
        pending += record
        if head and len(pending) >= head:
            yield bytes(pending[:head])
            del pending[:head]
            head = 0
        while not head and len(pending) >= block:
            yield bgzf.deflate(bytes(pending[:block]), 0)
            del pending[:block]
    if pending:
        yield bytes(pending)
    if p != stop:
        raise ValueError(f"records of {p - at} bytes where {stop - at} were counted")


def joined_parts(text: str, references: list[tuple[str, int]], parts: Iterable[tuple[str, int, int]], piece: Callable[[str, int, int], Any], block: int = 60_000) -> Iterator[Any]:
    """The file of parts (file, at, stop) in order: bytes, and piece(file, start, size) for their whole blocks."""
    head = head_bytes(text, references)
    for i in range(0, len(head), block):
        yield bgzf.deflate(head[i:i + block], 0)
    pending = bytearray()
    for path, at, stop in parts:
        source = bgzf.Source(path)
        before = min(-at % block, stop - at)
        whole, after = divmod(stop - at - before, block)
        pending += source.read(0, before)
        if len(pending) == block:
            yield bgzf.deflate(bytes(pending), 0)
            pending.clear()
        if whole:
            yield piece(path, before, whole * (block + bgzf.STORED))
        pending += source.read(before + whole * (block + bgzf.STORED), after)
    if pending:
        yield bgzf.deflate(bytes(pending), 0)
    yield bgzf.EOF_BLOCK


def write_bam(path: str, text: str, references: list[tuple[str, int]], rows: Iterable[dict[str, Any]], block: int = 60_000, level: int = 6) -> list[Place]:
    """Write a local file; the places of its records."""
    places: list[Place] = []
    with open(path, "wb") as f:
        f.writelines(bam_blocks(text, references, rows, places, block, level))
    return places


def _bin(start: int, end: int, shift: int, depth: int) -> int:
    """The smallest bin that holds [start, end)."""
    end = max(end - 1, start)
    offset = ((1 << depth * 3) - 1) // 7
    for level in range(depth, 0, -1):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
        shift += 3
        offset -= 1 << (level - 1) * 3
    return 0


class Gathered:
    """What an index needs of sorted records, gathered as they are appended: chunks by bin and the linear offsets, not the records' places."""

    def __init__(self, shift: int = 14, depth: int = 5) -> None:
        self.shift, self.depth = shift, depth
        self.refs: dict[int, tuple[dict[int, list[list[int]]], dict[int, int], list[int]]] = {}
        self.last: Place | None = None

    def append(self, place: Place) -> None:
        if self.last is not None:
            self._add(self.last, place[3])
        self.last = place

    def end(self, offset: int) -> None:
        """No records follow; `offset` is where the last one ends."""
        if self.last is not None:
            self._add(self.last, offset)
        self.last = None

    def extend(self, other: Gathered, offset: int) -> None:
        """The records of another follow, the first one at `offset`."""
        self.end(offset)
        for ref, (bins, linear, stats) in other.refs.items():
            if ref not in self.refs:
                self.refs[ref] = bins, linear, stats
                continue
            own, windows, sums = self.refs[ref]
            for k, chunks in bins.items():
                had = own.setdefault(k, [])
                if had and had[-1][1] == chunks[0][0]:
                    had[-1][1] = chunks[0][1]
                    chunks = chunks[1:]
                had += chunks
            for w, at in linear.items():
                windows.setdefault(w, at)
            sums[1:] = stats[1], sums[2] + stats[2], sums[3] + stats[3]
        self.last = other.last

    def _add(self, place: Place, after: int) -> None:
        ref, a, b, at, mapped = place
        if ref not in self.refs:
            self.refs[ref] = {}, {}, [at, 0, 0, 0]
        bins, linear, stats = self.refs[ref]
        b = max(b, a + 1)
        chunks = bins.setdefault(_bin(a, b, self.shift, self.depth), [])
        if chunks and chunks[-1][1] == at:
            chunks[-1][1] = after
        else:
            chunks.append([at, after])
        for w in range(a >> 14, (b - 1 >> 14) + 1):
            linear.setdefault(w, at)
        stats[1] = after
        stats[2 if mapped else 3] += 1


def index_bytes(places: list[Place] | Gathered, n_refs: int, end_offset: int, kind: str = "bai", shift: int = 14, depth: int = 5, aux: bytes = b"") -> bytes:
    """A BAI or (compressed) CSI index of sorted records."""
    if isinstance(places, Gathered):
        found = places
    else:
        found = Gathered(shift, depth)
        for p in places:
            found.append(p)
    found.end(end_offset)
    shift, depth = found.shift, found.depth
    out = b"BAI\1" if kind == "bai" else b"CSI\1" + struct.pack("<iii", shift, depth, len(aux)) + aux
    out += struct.pack("<i", n_refs)
    limit = ((1 << (depth + 1) * 3) - 1) // 7
    for ref in range(n_refs):
        bins, linear, (low, high, mapped, unmapped) = found.refs.get(ref, ({}, {}, (None, 0, 0, 0)))
        out += struct.pack("<i", len(bins) + (low is not None))
        for k in sorted(bins):
            first = min(c[0] for c in bins[k])
            out += struct.pack("<I", k) + (struct.pack("<Q", first) if kind == "csi" else b"") + struct.pack("<i", len(bins[k]))
            out += b"".join(struct.pack("<QQ", *c) for c in bins[k])
        if low is not None:
            out += struct.pack("<I", limit + 1) + (struct.pack("<Q", 0) if kind == "csi" else b"") + struct.pack("<iQQQQ", 2, low, high, mapped, unmapped)
        if kind == "bai":
            n = max(linear, default=-1) + 1
            floor, row = 0, []
            for w in range(n):
                floor = linear.get(w, floor)
                row.append(floor)
            out += struct.pack("<i", n) + struct.pack(f"<{n}Q", *row)
    if kind == "csi":
        return b"".join(bgzf.deflate(out[i:i + 60_000]) for i in range(0, len(out), 60_000)) + bgzf.EOF_BLOCK
    return out
