"""Best-fit packing: bin completion by branch and bound over lengths.

Documents are tokenised whole; one longer than a sequence is cut into full
pieces after a first one that may be shorter. What matters for packing is how
many pieces there are of each length, at most one number a length, so the search
runs on the driver over that histogram whatever the corpus is. It starts with
the best-fit-decreasing packing as incumbent. A node takes the largest length
left, lists the undominated fillings of the room beside it (any number of
pieces), and applies one to as many sequences as the counts allow, or to fewer.
It is pruned when the room wasted so far, and what must be wasted yet, rules out
a packing shorter than the incumbent; best fit of what is left may become the
new incumbent. The whole tree is searched, then trees of parts of the incumbent
that waste most. The search ends at the lower bound, with the whole tree seen, or
after `max_steps` steps; the incumbent is always a whole packing, and `Plan.gap`
is the proven distance from the fewest sequences.

The plan maps the k-th piece of a length to a sequence and offset. Ranks within
a length are counted in salted parts, so a length that many copies share isn't
gathered in one task; a part is named by a number that each written piece has
of its own, so copies and null ids are dealt like any other rows.

Null and empty texts are the end token alone. Repeated rows are packed each for
itself, null ids are allowed, and other columns aren't read.
"""

from __future__ import annotations

import bisect
import itertools
import json
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm.common import Scratch, once_per_process, slices

ship(__name__)

#: Fixed value: the split pattern of this family of byte-level vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):
    """An encoder with the vocabulary file's ids. Special tokens in a text are ordinary text.

    The same merges in a faster engine: ids are tested to equal the file's own library's.
    """

    def make():
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in printable}
        to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    return once_per_process(f"encoder:{path}", make)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens; only the first may be shorter."""
    full, rest = divmod(n, capacity)
    return ([rest] if rest else []) + [capacity] * full


def tokenised(df: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and row, a number of its own. Ids themselves stay in the task."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            at, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(enc.encode_to_numpy(text or "", disallowed_special=()), np.uint32(end_id)).astype("<u4")
                start = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    at.append(i)
                    out.append((k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
                    start += n
            cols = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, j]) for j in (1, 2, 3)), pa.array(row + np.arange(len(at)))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
            )
            row += len(at)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long")


Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how many sequences, and the (length, count) of each


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: alike open sequences are handled together."""
    open_: dict[int, Counter] = {}  # room -> contents -> how many
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            rooms = [r for r in open_ if r >= size]
            room = min(rooms) if rooms else capacity
            if rooms:
                contents, many = next(iter(open_[room].items()))
            else:
                contents, many = (), -(-left // (capacity // size))
            each = min(room // size, left)
            used = min(many, left // each)
            if rooms:
                open_[room][contents] -= used
                if not open_[room][contents]:
                    del open_[room][contents]
                    if not open_[room]:
                        del open_[room]
            open_.setdefault(room - each * size, Counter())[(*contents, (size, each))] += used
            left -= used * each
    return [(n, tuple(sorted(c, reverse=True))) for room in open_.values() for c, n in room.items()]


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """Fewest sequences that counts by length (an array of capacity + 1) can need.

    For each threshold k, pieces above capacity - k are alone, those above half
    can't share, and pieces from k to half fill only the room beside the latter;
    k = 0 is the bound by volume.
    """
    sizes = np.arange(capacity + 1)
    n, v = (np.concatenate([[0], np.cumsum(x)]) for x in (left, left * sizes))  # of lengths below i
    half = capacity // 2
    k = np.arange(half + 1)
    beside = n[capacity + 1 - k] - n[half + 1]
    room = beside * capacity - (v[capacity + 1 - k] - v[half + 1])
    small = v[half + 1] - v[k]
    return int((n[-1] - n[capacity + 1 - k] + beside + np.maximum(0, -(-(small - room) // capacity))).max())


def least_waste(left: np.ndarray, capacity: int) -> int:
    """Room that must stay idle: of each sequence with a piece above half, what no pieces up to half can fill."""
    half = capacity // 2
    over = np.flatnonzero(left[half + 1:]) + half + 1
    if not len(over):
        return 0
    sums, whole = 1, (1 << (half + 1)) - 1
    for s in np.flatnonzero(left[:half + 1]).tolist():
        sums = spread(sums, s, min(int(left[s]), half // s), whole)
    bits = np.frombuffer(sums.to_bytes(half // 8 + 1, "little"), np.uint8)
    fills = np.maximum.accumulate(np.where(np.unpackbits(bits, bitorder="little")[:half + 1], np.arange(half + 1), 0))
    room = capacity - over
    return int(left[over] @ (room - fills[room]))


def spread(sums: int, s: int, n: int, whole: int) -> int:
    """Sums, as bits, with up to n pieces of length s more."""
    take = 1
    while n:
        take = min(take, n)
        sums |= sums << take * s & whole
        n, take = n - take, take * 2
    return sums


Filling = tuple[int, ...]  # lengths, shortest first


def undominated(pieces: Filling, waste: int, others: int) -> bool:
    """No piece outside (bits of `others`) could take the place of some of these, the same or more of the room filled.

    Such a swap keeps the number of sequences: what leaves fits where the piece
    was. It must win room, or put one piece in the place of several.
    """
    one, more = 0, 0  # sums of one piece, of several
    for p in pieces:
        more |= (more | one) << p
        one |= 1 << p
    if others & more:
        return False
    grown, width = (one | more | 1) << 1, 1  # sums raised by 1 .. waste
    while width < waste:
        step = min(width, waste - width)
        grown |= grown << step
        width += step
    return not waste or not others & grown


def fillings(left: np.ndarray, room: int, most: int, after: tuple[int, Filling] | None = None) -> Iterator[tuple[int, Filling] | None]:
    """The undominated fillings of a room with at most `most` of it wasted, in order.

    Any number of pieces. Least waste comes first, then fewer pieces, then those
    whose shortest piece is longest, since short ones are easy to place later. They
    are listed as they are asked for: the sums that so many of the longer lengths
    reach, as bits of a number, lead straight to each filling of a given sum. None
    stands for a filling that is dominated, so that the caller can count the work.
    Those up to `after` are left out.
    """
    sizes = np.flatnonzero(left[:room + 1]).tolist()
    have = [int(left[s]) for s in sizes]
    whole = (1 << (room + 1)) - 1
    sums = 1  # of any pieces
    for s, n in zip(sizes, have, strict=True):
        sums = spread(sums, s, min(n, room // s), whole)
    reach = [[1] * (len(sizes) + 1)]  # by number of pieces, then from which length on

    def layer(m: int) -> list[int]:
        while len(reach) <= m:
            k = len(reach)
            now = [0] * (len(sizes) + 1)
            for j in range(len(sizes) - 1, -1, -1):
                bits = now[j + 1]
                for c in range(1, min(have[j], k) + 1):
                    bits |= reach[k - c][j + 1] << c * sizes[j] & whole
                now[j] = bits
            reach.append(now)
        return reach[m]

    def exact(first: int, m: int, target: int) -> Iterator[Filling]:
        """m pieces of the lengths from `first` on that sum to the target, shortest first."""
        if not m:
            yield ()
            return
        for j in range(bisect.bisect_right(sizes, target // m) - 1, first - 1, -1):
            s = sizes[j]
            for c in range(1, min(have[j], m) + 1):
                if reach[m - c][j + 1] >> (target - c * s) & 1:
                    for rest in exact(j + 1, m - c, target - c * s):
                        yield (s,) * c + rest

    available = sum(1 << s for s in sizes)
    for waste in range(after[0] if after else 0, min(most, room) + 1):
        target = room - waste
        if not sums >> target & 1:
            continue
        for m in range(target // sizes[0] + 1 if target else 1):
            if not layer(m)[0] >> target & 1:
                continue
            for pieces in exact(0, m, target):
                if after and waste == after[0] and (m, [-p for p in pieces]) <= (len(after[1]), [-p for p in after[1]]):
                    yield None
                    continue
                others = available
                for s, n in Counter(pieces).items():
                    if n == left[s]:
                        others ^= 1 << s
                yield (waste, pieces) if undominated(pieces, waste, others) else None


@dataclass
class Plan:
    patterns: list[Pattern]
    sequences: int
    bound: int  # no packing has fewer
    steps: int = 0  # what the search took

    @property
    def gap(self) -> int:
        return self.sequences - self.bound


def plan(counts: dict[int, int], capacity: int = 1024, *, max_steps: int = 100_000, seed: int = 1) -> Plan:
    """The shortest packing found within the steps, with a proven lower bound.

    A quarter of the steps goes to the whole tree. What is left searches trees of
    parts: some sequences that waste most, enough for one to be spared, and some
    others by chance; a part that isn't longer takes the place of the old one.
    """
    best = search(counts, capacity, max_steps // 4)
    rng = random.Random(seed)
    patterns = sum((Counter({c: n}) for n, c in best.patterns), Counter())
    idle = lambda c: capacity - sum(s * k for s, k in c)
    volume = sum(s * n for s, n in counts.items())
    for k in itertools.count():
        spare = best.sequences * capacity - volume
        if not best.gap or best.steps >= max_steps or spare < capacity:
            break
        part, won, many = Counter(), 0, max(1, best.gap // 8)  # sequences to win at once
        goal = min(spare, many * capacity * (4 + k % 4 * 2) // 4)
        for c in sorted(patterns, key=lambda c: (-idle(c), c)):
            part[c] = min(patterns[c], -(-(goal - won) // max(1, idle(c))))
            won += part[c] * idle(c)
            if won >= goal:
                break
        others = sorted((patterns - part).items())
        for c, n in rng.sample(others, min(len(others), 10 + 10 * (k % 4))):
            part[c] += min(n, many)
        lengths: Counter = Counter()
        for c, n in part.items():
            lengths.update({s: m * n for s, m in c})
        found = search(lengths, capacity, min(2000, max_steps - best.steps))
        best.steps += max(1, found.steps)
        if found.sequences <= part.total():
            patterns -= part
            for n, c in found.patterns:
                patterns[c] += n
            best.sequences = patterns.total()
    best.patterns = [(n, c) for c, n in sorted(patterns.items())]
    return best


def search(counts: dict[int, int], capacity: int, max_steps: int) -> Plan:
    """Branch and bound; if the tree is searched whole, the bound is the packing's own length.

    Sequences around equal largest pieces are alike, so their fillings are taken
    in the order of `fillings`, each as often as the counts allow, then once less,
    and so on: every packing that needn't be dominated is in the tree.
    """
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] += n
    found = best_fit({int(s): int(left[s]) for s in np.flatnonzero(left)}, capacity)
    best = Plan(found, sum(n for n, _ in found), lower_bound(left, capacity))
    volume = int(left @ np.arange(capacity + 1))
    steps = 0

    def options(left: np.ndarray, waste: int, after: tuple[int, Filling] | None) -> Iterator[tuple[()] | tuple[np.ndarray, Pattern, int, tuple[int, Filling]]]:
        """(counts left, pattern, room wasted, its filling) of the children of a node; empty for work without one."""
        largest = int(np.flatnonzero(left)[-1])
        fewest = -(-int(left[largest]) // (capacity // largest))  # sequences that will hold one, none with less waste than the one before
        idle = (best.sequences - 1) * capacity - volume - waste
        left = left.copy()
        left[largest] -= 1
        for got in fillings(left, capacity - largest, idle // fewest, after):
            if got is None:
                yield ()
                continue
            c = Counter((largest, *got[1]))
            most = min((int(left[s]) + (s == largest)) // k for s, k in c.items())
            for times in range(most, 0, -1):
                rest = left.copy()
                rest[largest] += 1
                for s, k in c.items():
                    rest[s] -= times * k
                yield rest, (times, tuple(sorted(c.items(), reverse=True))), times * got[0], got

    # Passes over the same tree: a path may leave the first choice 0, 1, 2, 4 ... times, so that
    # choices near the root are reconsidered early; a pass that turned nothing away has seen all.
    turns, whole = 0, False
    while best.gap and not whole and steps < max_steps:
        whole = True
        stack, done = [[options(left, 0, None), 0, 0, turns, 0]], []  # open nodes, and the pattern that led to each but the first
        while stack and best.gap:
            if steps >= max_steps:
                whole = False
                break
            steps += 1
            more, used, waste, free, taken = stack[-1]
            if taken and not free:
                whole, got = False, None
            elif -(-(volume + waste) // capacity) >= best.sequences:
                got = None  # the room wasted so far rules out anything shorter than the incumbent
            else:
                got = next(more, None)
            if got is None:
                stack.pop()
                if done:
                    done.pop()
                continue
            if not got:
                continue
            rest, pattern, idle, filling = got
            now, idle = used + pattern[0], waste + idle
            if now + lower_bound(rest, capacity) >= best.sequences or -(-(volume + idle + least_waste(rest, capacity)) // capacity) >= best.sequences:
                continue
            stack[-1][4] += 1
            if steps % 32 == 1 or not rest.any():
                tail = best_fit({int(s): int(rest[s]) for s in np.flatnonzero(rest)}, capacity)
                total = now + sum(n for n, _ in tail)
                if total < best.sequences:
                    best = Plan([*done, pattern, *tail], total, best.bound)
            if rest.any():
                same = pattern[1][0][0] == int(np.flatnonzero(rest)[-1])
                done.append(pattern)
                stack.append([options(rest, idle, filling if same else None), now, idle, free - (taken > 0), 0])
        turns = 2 * turns or 1
    if whole:
        best.bound = best.sequences
    best.steps = steps
    return best


def places(patterns: list[Pattern], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run, first sequence, pieces of the length in a sequence, first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for times, contents in patterns:
        offset = 0
        for size, k in contents:
            rows.setdefault(size, []).append((taken[size], base, k, offset))
            taken[size] += times * k
            offset += size * k
        base += times
    rows[capacity] = [(0, base, 1, 0)]
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in rows.items()}


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 1024, end_id: int = 2,
                   rows_a_part: int = 20_000, max_steps: int = 100_000) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(df.sparkSession, "packing")
    pieces = scratch.keep(tokenised(df, vocabulary, id_col, text_col, end_id, capacity))
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    total = sum(counts.values())
    counts.pop(capacity, None)
    where = places(plan(counts, capacity, max_steps=max_steps).patterns, capacity)

    n_parts = max(1, -(-total // rows_a_part))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("row")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1).join(starts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("k"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            me = size == s
            first, base, k, offset = where[int(s)]
            i = np.searchsorted(first, r[me], side="right") - 1
            j = r[me] - first[i]
            seq[me] = base[i] + j // k[i]
            off[me] = offset[i] + (j % k[i]) * s
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = ranked.withColumn("at", place("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
