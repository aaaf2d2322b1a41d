"""Coordinate indexes (BAI and CSI) and the plan of a region query.

A region is turned into bins, the bins into chunks of virtual offsets, and the
chunks into few disjoint reads. Reads that lie close together are joined, unless
the joined one would span too much: bounds that keep partitions balanced.
"""

from __future__ import annotations

import bisect
import struct
from dataclasses import dataclass, field

from readloom import ship
from readloom.codec import bgzf

ship(__name__)

#: Join reads with a gap below GAP while they span less than SPAN; a read's tail is TAIL at most.
GAP, SPAN, TAIL = 65_000, 5_000_000, 1 << 16
LONGEST_BAI = 1 << 29
#: Chunks that a forecast counts at least.
FORECAST_FLOOR = 6


def unpack_offset(v: int) -> tuple[int, int]:
    return v >> 16, v & 0xFFFF


@dataclass(frozen=True)
class Chunk:
    """A run of virtual offsets [begin, stop), and the byte at which reading it may end."""

    begin: int
    stop: int
    bin: int = 0
    end_position: int = 0

    def __post_init__(self) -> None:
        if not self.end_position:
            object.__setattr__(self, "end_position", (self.stop >> 16) + TAIL)

    def fetched_size(self) -> int:
        return self.end_position - (self.begin >> 16)

    def key(self) -> str:
        return "-".join(f"{b}:{d}" for b, d in map(unpack_offset, (self.begin, self.stop)))


@dataclass
class RefIndex:
    bins: dict[int, list[Chunk]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)
    mapped: int | None = None


@dataclass
class Index:
    kind: str
    refs: list[RefIndex]
    shift: int = 14
    depth: int = 5
    aux: bytes = b""

    def has_ref(self, ref_id: int | None) -> bool:
        return ref_id is not None and 0 <= ref_id < len(self.refs)

    def first_data(self) -> int | None:
        """The smallest offset of any data; 0:0 stands for none."""
        found = [c.begin for r in self.refs for cs in r.bins.values() for c in cs if c.begin] + [v for r in self.refs for v in r.linear if v]
        return min(found, default=None)

    def line_count(self, ref_id: int | None) -> int:
        """Mapped records of a reference, as the index holds them; 0 if it doesn't."""
        return (self.refs[ref_id].mapped or 0) if self.has_ref(ref_id) else 0

    def floor(self, ref_id: int, start: int) -> int | None:
        """No record that overlaps `start` or later begins before this offset."""
        if self.kind == "csi":
            return 0
        linear = self.refs[ref_id].linear
        return linear[min(start >> 14, len(linear) - 1)] if linear else None

    def ceiling(self, ref_id: int, end: int) -> int | None:
        """Block at which data beyond `end` begins, if the linear index tells."""
        linear, k = self.refs[ref_id].linear, (end >> 14) + 1
        return linear[k] >> 16 if self.kind == "bai" and k < len(linear) else None

    def boundaries(self, ref_id: int) -> list[int]:
        r = self.refs[ref_id]
        return sorted({c.begin >> 16 for cs in r.bins.values() for c in cs} | {v >> 16 for v in r.linear})

    def chunks(self, ref_id: int, start: int, end: int) -> list[Chunk]:
        """The disjoint reads that hold every record overlapping [start, end)."""
        if not self.has_ref(ref_id) or end <= 0:
            return []
        start = max(0, start)
        have = self.refs[ref_id].bins
        found = []
        for lo, hi in bin_ranges(start, end, self.shift, self.depth, self.kind):
            picked = range(lo, hi + 1) if hi - lo < len(have) else (b for b in have if lo <= b <= hi)
            found += [c for b in picked for c in have.get(b, ())]
        return tighten(disjoint(join(found, self.floor(ref_id, start))), self.boundaries(ref_id))

    def density(self, ref_id: int | None, start: int | None = None, end: int | None = None) -> list[tuple[int, int, float]]:
        """(start, end, score) by window of 16,384 bases from the linear index; [] for CSI."""
        if self.kind == "csi" or not self.has_ref(ref_id):
            return []
        r = self.refs[ref_id]
        blocks = [v >> 16 for v in r.linear]
        last = (len(blocks) - 1) << 14
        lo = 0 if start is None else start >> 14 << 14
        hi = last if end is None else min(last, -(-end >> 14) << 14)
        total = blocks[-1] if blocks else 0
        if lo >= hi or not total or not r.mapped:
            return [(w, w + (1 << 14), 0.0) for w in range(lo, hi, 1 << 14)]
        return [(w, w + (1 << 14), (blocks[(w >> 14) + 1] - blocks[w >> 14]) * r.mapped / total) for w in range(lo, hi, 1 << 14)]

    def forecast(self, regions: list[tuple[int, int, int]]) -> int:
        """Bytes that reading the regions (ref_id, start, end) will likely fetch; no data is read."""
        picked: list[Chunk] = []
        for ref_id, start, end in regions:
            if self.has_ref(ref_id):
                picked += likely(self.chunks(ref_id, start, end), self.ceiling(ref_id, end))
        bounds = sorted({b for ref_id, *_ in regions if self.has_ref(ref_id) for b in self.boundaries(ref_id)})
        return sum(c.fetched_size() for c in tighten(disjoint(join(picked, None)), bounds))


def bin_ranges(start: int, end: int, shift: int = 14, depth: int = 5, kind: str = "bai") -> list[tuple[int, int]]:
    """Ranges of bin numbers, a level each, that may hold records overlapping [start, end)."""
    most = 1 << (shift + 3 * depth)
    last = min(end, most) - 1
    if kind == "bai":
        start = min(start, most - 1)
    if last < start:
        return []
    out, offset = [], 0
    for level in range(depth + 1):
        s = shift + 3 * (depth - level)
        out.append((offset + (start >> s), offset + (last >> s)))
        offset += 1 << 3 * level
    if sum(b - a + 1 for a, b in out) > 1 << 26:
        raise ValueError(f"region {start}-{end} covers too many bins; use an index with larger bins")
    return out


def join(chunks: list[Chunk], floor: int | None) -> list[Chunk]:
    """Sorted by where they begin; what ends at or before the floor goes; close ones become one."""
    out: list[Chunk] = []
    for c in sorted((c for c in chunks if floor is None or c.stop > floor), key=lambda c: (c.begin, c.stop)):
        if out and (c.begin >> 16) - (out[-1].stop >> 16) < GAP and (max(c.stop, out[-1].stop) >> 16) - (out[-1].begin >> 16) < SPAN:
            out[-1] = Chunk(out[-1].begin, max(out[-1].stop, c.stop), out[-1].bin)
        else:
            out.append(c)
    return out


def disjoint(chunks: list[Chunk]) -> list[Chunk]:
    """Each record lies in one chunk only."""
    out: list[Chunk] = []
    reached = -1
    for c in chunks:
        begin = max(c.begin, reached)
        if begin < c.stop or not out and c.begin == c.stop:
            out.append(c if begin == c.begin else Chunk(begin, c.stop, c.bin, c.end_position))
            reached = max(reached, c.stop)
    return out


def tighten(chunks: list[Chunk], boundaries: list[int]) -> list[Chunk]:
    """A read may end at the first known block boundary after its last block."""
    bounds = sorted({*boundaries, *(c.begin >> 16 for c in chunks)})
    out = []
    for c in chunks:
        k = bisect.bisect_right(bounds, c.stop >> 16)
        out.append(Chunk(c.begin, c.stop, c.bin, min(c.end_position, bounds[k])) if k < len(bounds) else c)
    return out


def likely(chunks: list[Chunk], bound: int | None) -> list[Chunk]:
    """The chunks before the bound, a few at least; all of them when it is unknown or comes first."""
    if bound is None:
        return chunks
    n = sum(c.begin >> 16 < bound for c in chunks)
    return chunks[:max(n, FORECAST_FLOOR)] if n else chunks


def parse(data: bytes) -> Index:
    data = bgzf.inflate_all(data)
    magic, at = data[:4], 4

    def take(fmt: str) -> tuple:
        nonlocal at
        out = struct.unpack_from("<" + fmt, data, at)
        at += struct.calcsize("<" + fmt)
        return out

    if magic == b"BAI\1":
        kind, shift, depth, aux = "bai", 14, 5, b""
    elif magic in (b"CSI\1", b"CSI\2"):
        shift, depth, n = take("iii")
        kind, aux = "csi", data[at:at + n]
        at += n
    else:
        raise ValueError("neither a BAI nor a CSI index: wrong magic")
    limit = ((1 << (depth + 1) * 3) - 1) // 7
    index = Index(kind, [], shift, depth, aux)
    for _ in range(*take("i")):
        ref = RefIndex()
        for _ in range(*take("i")):
            (number,) = take("I")
            if kind == "csi":
                at += 8  # the bin's own floor
            (n,) = take("i")
            pairs = [take("QQ") for _ in range(n)]
            if number == limit + 1:  # not a bin: offsets, then counts of mapped and unmapped records
                ref.mapped = pairs[1][0] if n > 1 else None
            elif number > limit + 1 and kind == "bai":
                raise ValueError("too many bins for a BAI index, please use CSI")
            else:
                ref.bins[number] = [Chunk(a, b, number) for a, b in pairs]
        if kind == "bai":
            (n,) = take("i")
            ref.linear = list(take(f"{n}Q"))
        index.refs.append(ref)
    return index


def tabix_details(aux: bytes) -> dict | None:
    """The text-table block that a CSI index may carry: columns, meta character, lines to skip, names."""
    if len(aux) < 28:
        return None
    kind, ref, start, end, meta, skip, n = struct.unpack_from("<7i", aux)
    names = [x.decode("latin-1") for x in aux[28:28 + n].split(b"\0") if x]
    return {
        "format": {0: "generic", 1: "SAM", 2: "VCF"}.get(kind & 0xFFFF, "unknown"), "coordinates": "0-based" if kind & 0x10000 else "1-based",
        "columns": {"ref": ref, "start": start, "end": end}, "meta": chr(meta) if meta else "", "skip_lines": skip, "names": names,
    }
