"""Bloom filters built by the executors and merged segment by segment.

A partition sends the positions that it set, not whole filters; a segment's
merge holds one segment. The filter's size is set by the caller, and so is the
bound of what the driver gets and broadcasts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom import ship

ship(__name__)

SEGMENT = 1 << 15
PROBES = 3


def bits_for(items: int, most: int) -> int:
    """A power of two of at least 12 bits an item, and at most `most`."""
    return 1 << int(np.clip(np.ceil(np.log2(12 * max(1, items))), 16, np.log2(most)))


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """The filter's positions of 64-bit hashes, one row a hash."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], 1).astype(np.int64)


def may_hold(filt: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = positions(h, len(filt) * 8)
    return ((filt[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).astype(bool).all(1)


def build(hashes: DataFrame, bits: int, *, twice: bool = False) -> np.ndarray:
    """Packed bits of a filter of the one column of 64-bit hashes; with `twice`, of those seen more than once.

    A hash that two partitions saw has all its positions set in both once-seen
    filters, so it is in the twice-seen one: nothing is missed.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not sum(map(len, parts)):
            return
        seen, n = np.unique(np.concatenate(parts), return_counts=True)
        once = np.unique(positions(seen, bits))
        more = np.unique(positions(seen[n > 1], bits)) if twice else once[:0]
        seg = np.unique(once // SEGMENT)
        cut = [np.split((a % SEGMENT).astype(np.uint16), np.searchsorted(a // SEGMENT, seg[1:])) for a in (once, more)]
        for at in range(0, len(seg), 2000):
            cols = [pa.array([x.tobytes() for x in c[at:at + 2000]], pa.binary()) for c in cut]
            yield pa.RecordBatch.from_arrays([pa.array(seg[at:at + 2000], pa.int64()), *cols], names=["segment", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
        for batch in rows:
            for o, t in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                now = np.frombuffer(o, np.uint16)
                two[now[one[now]]] = True
                one[now] = True
                two[np.frombuffer(t, np.uint16)] = True
        packed = np.packbits(two if twice else one).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([packed], pa.binary())], names=["segment", "bits"])

    merged = hashes.mapInArrow(spread, "segment long, once binary, twice binary").groupBy("segment").applyInArrow(merge, "segment long, bits binary")
    out = np.zeros((max(1, bits // SEGMENT), SEGMENT // 8), np.uint8)
    for row in merged.toLocalIterator():  # bits / 8 bytes in all
        out[row.segment] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)
