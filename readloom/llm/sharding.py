"""Sharding: the minimax contiguous partition of ordered groups of equal texts.

Groups are ordered by a 64-bit hash of the text; equal texts share it and are
never parted. The smallest capacity with which the order can be cut into
`n_shards` runs is found by binary search, each step checked greedily. Among
the cuts within that capacity each shard then takes the group boundary nearest
below its even share of what is left, so that sizes are near equal too.

The driver never sees all groups. It sees sums over at most `max_segments`
segments of the hash order, runs the search with each segment taken once as
indivisible and once as fluid, and splits only the segments where the two
disagree about a cut, until every cut falls between segments. Each round is one
aggregation over the group table.

Slots are counted within salted parts of a shard, dealt by a number that each
written row has of its own, so neither a shard nor a large group of copies or of
null ids is ever gathered in one task.

Null texts count as empty (size 1, crc32 0) and form a group with those. Repeated
rows are rows of their own; null ids are allowed; other columns aren't read.
With fewer groups than shards the last shards stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm.common import Scratch

ship(__name__)

LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Segments:
    """Ordered runs of the hash order: [first, last] of the hashes, bytes, groups, largest group."""

    first: np.ndarray
    last: np.ndarray
    size: np.ndarray
    groups: np.ndarray
    largest: np.ndarray


def greedy(size: np.ndarray, fluid: np.ndarray, capacity: int, shards: int) -> list[tuple[int, int]] | None:
    """Cuts as (segment, bytes of it taken) for shards filled one after another; None if they don't do."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at, cuts = 0, []
    for _ in range(shards):
        if total - at <= capacity:
            return cuts
        k = int(np.searchsorted(ends, at + capacity, side="right"))
        before = int(ends[k - 1]) if k else 0
        at = at + capacity if fluid[k] else before
        if not fluid[k] and before <= (cuts[-1][2] if cuts else 0):
            return None
        cuts.append((k, at - before, at))
    return None


def smallest(size: np.ndarray, fluid: np.ndarray, largest: int, shards: int) -> int:
    total = int(size.sum())
    lo, hi = max(largest, -(-total // shards), 1), max(total, 1)
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(size, fluid, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def even_cuts(size: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Positions (in segments) of shards - 1 cuts with every shard within the capacity."""
    ends = np.concatenate([[0], np.cumsum(size)])
    n, total = len(size), int(ends[-1])
    least = [n] * (shards + 1)  # the first position from which the rest fits in the shards left
    for k in range(shards - 1, -1, -1):
        least[k] = int(np.searchsorted(ends, ends[least[k + 1]] - capacity, side="left"))
    cuts, at = [], 0
    for k in range(1, shards):
        share = ends[at] + (total - ends[at]) / (shards - k + 1)
        want = int(np.searchsorted(ends, share, side="right")) - 1
        if want + 1 <= n and share - ends[want] > ends[want + 1] - share:
            want += 1
        most = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        at = min(max(want, least[k], at), most)
        cuts.append(at)
    return cuts


def boundaries(groups: DataFrame, n_shards: int, max_segments: int = 1 << 16) -> tuple[list[int], int]:
    """First hash of each shard but the first, and the capacity. groups: h, size (bytes of one group)."""

    def sums(parts: list[tuple[int, int]], shift: int) -> Segments:
        """Sums over the runs of 2**shift hashes that lie in the given [first, last] parts."""
        rows = groups
        if len(parts) > 1 or parts[0] != (LEAST, MOST):
            coarse = sorted({x >> top for a, b in parts for x in range((a >> top) << top, b + 1, 1 << top)})
            rows = groups.join(F.broadcast(groups.sparkSession.createDataFrame([(x,) for x in coarse], "p long")), F.shiftright("h", top) == F.col("p"), "left_semi")
        got = rows.groupBy(F.shiftright("h", shift).alias("k")).agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")).toPandas().sort_values("a")
        firsts, lasts = (np.array(x, np.int64) for x in zip(*sorted(parts), strict=True))
        h = got["a"].to_numpy(np.int64)
        i = np.searchsorted(firsts, h, side="right") - 1
        got = got[(i >= 0) & (h <= lasts[np.maximum(i, 0)])]
        return Segments(*(got[c].to_numpy(np.int64) for c in ("a", "b", "s", "n", "m")))

    depth = int(np.log2(max_segments))
    shift = top = 64 - depth
    seg = sums([(LEAST, MOST)], shift)
    largest = int(seg.largest.max()) if len(seg.largest) else 1
    while True:
        many = seg.groups > 1
        low, high = (smallest(seg.size, f, largest, n_shards) for f in (many, np.zeros(len(many), bool)))
        unsure: set[int] = set()
        if low != high:
            early = greedy_positions(seg.size, low, n_shards)
            late = greedy_fluid(seg.size, many, high, n_shards)
            ends = np.cumsum(seg.size)
            for a, b in zip(early, late, strict=True):
                i, j = np.searchsorted(ends, [a, b], side="right")
                unsure |= {x for x in range(int(i), min(int(j), len(ends) - 1) + 1) if many[x]}
        cuts = even_cuts(seg.size, high, n_shards)
        if not unsure:  # the capacity is exact; the even shares may still fall inside a segment
            unsure = {x for c in cuts for x in (c - 1, c) if 0 <= x < len(many) and many[x]}
        if not unsure or shift == 0:
            first = [int(seg.first[c]) if c < len(seg.first) else None for c in cuts]
            return [x for x in first if x is not None], high
        todo = sorted(unsure)
        deeper = max(4, int(np.log2(max(2, max_segments // len(todo)))))
        shift = max(0, shift - deeper)
        new = sums([(int(seg.first[i]), int(seg.last[i])) for i in todo], shift)
        keep = np.setdiff1d(np.arange(len(many)), todo)
        joined = [np.concatenate([getattr(seg, c)[keep], getattr(new, c)]) for c in ("first", "last", "size", "groups", "largest")]
        order = np.argsort(joined[0], kind="stable")
        seg = Segments(*(x[order] for x in joined))


def greedy_positions(size: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Earliest bytes at which each cut can lie: segments indivisible, an oversized one taken alone."""
    ends = np.concatenate([[0], np.cumsum(size)])
    at, out = 0, []
    for _ in range(shards - 1):
        k = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        at = k
        out.append(int(ends[at]))
    return out


def greedy_fluid(size: np.ndarray, fluid: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Latest bytes of each cut: a fluid segment can be cut anywhere."""
    ends = np.cumsum(size)
    at, out = 0, []
    for _ in range(shards - 1):
        k = int(np.searchsorted(ends, at + capacity, side="right"))
        at = min(at + capacity, int(ends[-1])) if k >= len(ends) or fluid[k] else (int(ends[k - 1]) if k else 0)
        out.append(at)
    return out


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n_shards: int = 16, rows_a_part: int = 20_000) -> DataFrame:
    """One row a row: doc_id, size, text_crc32, shard and slot."""
    scratch = Scratch(df.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = scratch.keep(
        df.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("row"),  # written with the rows, so it stays what it is
        )
    )
    groups = scratch.keep(rows.groupBy("h").agg(F.sum("size").alias("size")))
    firsts, _ = boundaries(groups, n_shards)
    shard = F.lit(0)
    for b in firsts:
        shard = shard + (F.col("h") >= F.lit(b)).cast("int")
    scratch.drop(groups)
    # slots: parts of about rows_a_part rows by a salt of the row, then a running count over parts
    n_parts = max(1, -(-rows.count() // rows_a_part))
    placed = rows.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("row")
    out = placed.withColumn("k", F.row_number().over(within) - 1).join(starts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("k")).alias("slot"))
