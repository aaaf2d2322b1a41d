"""Candidates of a set join by prefixes, without a miss.

Under any one order of all elements, two sets of similarity num / den or more
share an element among the first n - ceil(n * num / den) + 1 of each. Rare
elements come first here, so a passage that many sets hold is in the prefix of
those only that hold little else. Frequencies are counted by hash, in a table of
bounded size; elements that share a place of it only come later in the order,
which is the same for all sets, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom import ship

ship(__name__)

SEGMENT = 1 << 15
ELEMENTS = 1 << 21  # that a task counts at a time


def places_for(elements: int, most: int) -> int:
    """A power of two of about a place an element, and at most `most`."""
    return 1 << int(np.clip(np.ceil(np.log2(max(1, elements))), 15, np.log2(most)))


def frequencies(sets: DataFrame, places: int) -> np.ndarray:
    """For each place of the table the logarithm of how often its elements are in `sets`, one binary column of 64-bit hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held) & np.uint64(places - 1), return_counts=True)
            seg, first = np.unique(at // np.uint64(SEGMENT), return_index=True)
            cut = [np.split(x, first[1:]) for x in ((at % np.uint64(SEGMENT)).astype(np.uint16), n.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(seg.astype(np.int64)), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in cut)], names=["segment", "place", "n"])

        held, n = [], 0
        for b in batches:
            for x in b.column(0):
                held.append(np.frombuffer(x.as_buffer(), np.uint64))
                n += len(held[-1])
                if n >= ELEMENTS:
                    yield counted(held)
                    held, n = [], 0
        if n:
            yield counted(held)

    def add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEGMENT, np.int64)
        for b in rows:
            for at, n in zip(b.column("place").to_pylist(), b.column("n").to_pylist(), strict=True):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        logs = np.log2(np.maximum(total, 1)).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([logs], pa.binary())], names=["segment", "logs"])

    summed = sets.mapInArrow(count, "segment long, place binary, n binary").groupBy("segment").applyInArrow(add, "segment long, logs binary")
    out = np.zeros((max(1, places // SEGMENT), SEGMENT), np.uint8)
    for row in summed.toLocalIterator():  # a byte a place in all
        out[row.segment] = np.frombuffer(row.logs, np.uint8)
    return out.reshape(-1)


def prefix(s: np.ndarray, logs: np.ndarray, num: int, den: int) -> np.ndarray:
    """The elements of which a set of similarity num / den or more has at least one in its own prefix."""
    n = len(s) + num * len(s) // -den + 1
    return s[np.lexsort((s, logs[s & np.uint64(len(logs) - 1)]))[:n]]
