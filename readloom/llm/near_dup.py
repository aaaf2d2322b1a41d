"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct 5-word shingles. Its signature has symbols of
16 bits, each the low bits of a minimum under one hash, in chunks of 4. Two
signatures that differ in fewer than half of their symbols differ in at most one
symbol of some chunk, so each document is filed under the keys that a chunk gives
when any one of its symbols is left out: all pairs within that distance meet
under a key. There are as many symbols as the similarity asks for, so that two
sets of just that similarity are beyond the distance in fewer than 5 of a million
pairs: 32 symbols (distance 15) for 0.85, 48 (distance 23) for 0.80.

Equal sets are one class from the start, by a 128-bit hash, whatever their
number. Classes that meet under keys form families, found from links to each
key's smallest member, never from pairs. A family's sets are then brought
together and linked exactly: a document is compared only with those of other
components whose size and signature allow a link. A family larger than a tile
is first parted again, by the rarest shingles of its members (`prefixes`): linked
sets share one of those, sets that only share a passage with many others don't.
What is still larger is cut into tiles by a hash, which are solved apart. One member of each component
then meets those of other tiles, which makes one component of a family of near
copies. What can still be linked has at least one side outside of the family's
largest component: only those members are sent to all tiles, a tile's worth at a
time. So a task's memory is bounded by two tiles, the work by the members times
those outside of the largest component, and no link between different texts is
lost by any cap. Sets are recomputed from the texts for members of families only,
let through by a Bloom filter of bounded size.

Null and empty texts have no shingles and link with nothing. Repeated rows of
one doc_id share its component; a null id has no component and is kept. Other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm import bloom, prefixes
from readloom.llm.common import BLANK_BYTES, Scratch, ascii_lower, slices
from readloom.llm.components import connected_components

ship(__name__)

WIDTH, MISSED, MOST_SYMBOLS = 4, 5e-6, 512


def symbols_for(num: int, den: int) -> int:
    """The least number of symbols at which sets of similarity num / den are out of the distance in at most MISSED of the pairs."""
    differ = 1 - num / den
    for n in range(WIDTH, MOST_SYMBOLS + 1, WIDTH):
        if sum(math.comb(n, k) * differ**k * (1 - differ) ** (n - k) for k in range(distance(n) + 1, n + 1)) <= MISSED:
            return n
    raise ValueError(f"similarity {num}/{den} is too low for {MOST_SYMBOLS} symbols")


def distance(symbols: int) -> int:
    """The greatest number of differing symbols at which some chunk has at most one of them."""
    return 2 * (symbols // WIDTH) - 1


SYMBOLS = 32  # of similarity 0.85
DISTANCE = distance(SYMBOLS)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _rng_odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = np.random.default_rng(2).integers(0, 1 << 64, 256, dtype=np.uint64)  # a random number for each byte
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANK_BYTES)] = False


def hashed_words(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: the sum of its bytes' numbers, each times a power of MIX by its place."""
    raw = np.frombuffer(ascii_lower(text or ""), np.uint8)
    inside = _IS_WORD[raw]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    size = np.diff(np.append(first, len(at)))
    power = np.multiply.accumulate(np.full(int(size.max()), MIX))
    place = np.arange(len(at)) - np.repeat(first, size)
    return mixed(np.add.reduceat(_BYTE[raw[at]] * power[place], first) + size.astype(np.uint64))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of the whole sequence if it is shorter."""
    a = hashed_words(text)
    if not len(a):
        return a
    n = max(1, len(a) - size + 1)
    s = np.full(n, np.uint64(min(size, len(a))))
    for k in range(min(size, len(a))):
        s = s * MIX + a[k:k + n]
    return np.unique(mixed(s))


def signature(s: np.ndarray, odd: np.ndarray) -> np.ndarray:
    return np.array([(s * a).min() >> np.uint64(32) for a in odd], np.uint64).astype(np.uint16)


def keys(sig: np.ndarray) -> np.ndarray:
    """A key for each symbol of each row of signatures: a chunk with one symbol left out, its place mixed in."""
    out = np.empty(sig.shape, np.uint64)
    wide = sig.astype(np.uint64)
    for c in range(sig.shape[1] // WIDTH):
        for k in range(WIDTH):
            h = np.full(len(sig), np.uint64(c * WIDTH + k + 1))
            for j in range(WIDTH):
                if j != k:
                    h = (h << np.uint64(16)) | wide[:, c * WIDTH + j]
            out[:, c * WIDTH + k] = mixed(h)
    return out.view(np.int64)


def link(sets: list[np.ndarray], sigs: np.ndarray, comp: np.ndarray, side: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Exact components of the members: labels are member numbers.

    Members with equal `comp` are together from the start. With sides, only pairs
    across them are looked at; else all are.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sets = [sets[i] for i in order]
    sigs, size, side = sigs[order], size[order], None if side is None else side[order]
    _, at = np.unique(comp[order], return_inverse=True)
    label = at.astype(np.int64)
    universe, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(universe), bool)
    for x in range(n):
        last = int(np.searchsorted(size, size[x] * den / num + 1e-9, side="right"))
        y = np.arange(x + 1, last)
        y = y[label[y] != label[x]]
        if side is not None:
            y = y[side[y] != side[x]]
        if len(y):
            y = y[(sigs[y] != sigs[x]).sum(1) <= distance(sigs.shape[1])]
        if not len(y):
            continue
        mark[code[ends[x]:ends[x + 1]]] = True
        flat = np.concatenate([code[ends[i]:ends[i + 1]] for i in y])
        both = np.add.reduceat(mark[flat].astype(np.int64), np.concatenate([[0], np.cumsum(size[y])[:-1]]))
        mark[code[ends[x]:ends[x + 1]]] = False
        for j in np.unique(label[y[den * both >= num * (size[x] + size[y] - both)]]):
            label[label == j] = label[x]
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, num: int = 85, den: int = 100, shingle: int = 5,
                    tile_rows: int = 2000, tile_shingles: int = 2_000_000, max_filter_bits: int = 1 << 28, max_places: int = 1 << 24, seed: int = 11) -> DataFrame:
    """One row a row: doc_id, n_shingles, component_id and kept. Links: den * intersection >= num * union."""
    spark = df.sparkSession
    scratch = Scratch(spark, "near_dup")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    symbols = symbols_for(num, den)
    odd = _rng_odd(seed, symbols)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, hi, lo, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, shingle)
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes())
                hi.append(int.from_bytes(d[:8], "big", signed=True))
                lo.append(int.from_bytes(d[8:], "big", signed=True))
                sig.append(signature(s, odd).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "hi", "lo", "sig"])

    rows = scratch.keep(docs.mapInArrow(describe, "doc_id long, n_shingles long, hi long, lo long, sig binary"))
    some = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.keep(some.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k = keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, symbols))
            yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(np.repeat(b.column(0).to_numpy(), symbols))], names=["key", "id"])

    sizes = classes.select(F.col("rep").alias("id"), "n")
    tiles_for = lambda n, w: F.ceil(F.greatest(n / tile_rows, w / tile_shingles)).cast("int")

    def families(filed: DataFrame) -> DataFrame:
        """(id, family, tiles, tile, n) of what meets others under keys; tiles: as many as the members and their shingles need."""
        heads = scratch.keep(filed.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("top")).where(F.col("head") < F.col("top")).drop("top"))
        meets = filed.join(heads, "key").where(F.col("id") != F.col("head")).select(F.col("id").alias("a"), F.col("head").alias("b"))
        members = scratch.keep(connected_components(meets, scratch).withColumnRenamed("component", "family")).join(sizes, "id")
        scratch.drop(heads)
        tiles = scratch.keep(members.groupBy("family").agg(tiles_for(F.count("*"), F.sum("n")).alias("tiles")))
        out = scratch.keep(members.join(tiles, "family").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).select("id", "family", "tiles", "tile", "n"))
        scratch.drop(tiles)
        return out

    placed = families(classes.select("rep", "sig").mapInArrow(file, "key long, id long"))
    bits = bloom.bits_for(placed.count(), max_filter_bits)
    filt = spark.sparkContext.broadcast(bloom.build(placed.select("id").mapInArrow(_hashed_ids, "h long"), bits))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            hit = np.flatnonzero(bloom.may_hold(filt.value, mixed(ids.astype(np.uint64))))
            for at in range(0, len(hit), 500):
                take = hit[at:at + 500]
                texts = b.column(1).take(pa.array(take)).to_pylist()
                got = [shingles(t, shingle) for t in texts]
                sig = [signature(s, odd).tobytes() if len(s) else None for s in got]
                yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array([s.tobytes() for s in got], pa.binary()), pa.array(sig, pa.binary())], names=["id", "shingles", "sig"])

    found = docs.mapInArrow(sets_of, "id long, shingles binary, sig binary").join(placed.drop("n"), "id").where(F.col("sig").isNotNull())

    def solver(across: bool):
        """(id, old, comp) of each member of a group; `across` looks at pairs of different sides only."""

        def solve(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
            if across and side.min() == side.max():
                return
            order = np.lexsort((side, ids))  # repeated rows of an id: one of them
            i, k = ids[order], side[order]
            t = t.take(pa.array(order[np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])])]))
            got = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, symbols)
            old = t.column("comp").to_numpy()
            label = link(got, sig, old, t.column("side").to_numpy() if across else None, num, den)
            smallest = np.full(label.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, label, old)
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(old), pa.array(smallest[label])], names=["id", "old", "comp"])

        return solve

    out_schema = "id long, old long, comp long"

    def solved(members: DataFrame) -> DataFrame:
        single = members.withColumns({"comp": F.col("id"), "side": F.lit(0)})
        return scratch.keep(single.groupBy("family", "tile").applyInArrow(solver(False), out_schema).select("id", "comp"))

    one = solved(found.where(F.col("tiles") == 1))

    def merged(groups: DataFrame, across: bool) -> DataFrame:
        """(comp, top): components that the groups tie together."""
        keys = [c for c in ("family", "tile", "part") if c in groups.columns]
        ties = groups.groupBy(*keys).applyInArrow(solver(across), out_schema).where(F.col("old") != F.col("comp")).select(F.col("old").alias("a"), F.col("comp").alias("b")).distinct()
        return connected_components(ties, scratch).select(F.col("id").alias("comp"), F.col("component").alias("top"))

    def raised(rows: DataFrame, over: DataFrame) -> DataFrame:
        return rows.join(over, "comp", "left").withColumn("comp", F.coalesce("top", "comp")).drop("top")

    if placed.where(F.col("tiles") > 1).limit(1).count():
        # sets are written once; what is found out about their ids stays in narrow tables
        many = scratch.keep(found.where(F.col("tiles") > 1).select("id", "shingles", "sig"))
        held = placed.where(F.col("tiles") > 1).agg(F.sum("n")).first()[0]
        logs = spark.sparkContext.broadcast(prefixes.frequencies(many.select("shingles"), prefixes.places_for(held, max_places)))

        def file_rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                got = [prefixes.prefix(np.frombuffer(x, np.uint64), logs.value, num, den) for x in b.column(1).to_pylist()]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in got]))], names=["key", "id"])

        parted = families(many.select("id", "shingles").mapInArrow(file_rarest, "key long, id long"))
        of_parts = solved(many.join(parted.drop("n"), "id"))
        one = scratch.keep(one.unionByName(of_parts))
        if parted.where(F.col("tiles") > 1).limit(1).count():
            state = scratch.keep(parted.where(F.col("tiles") > 1).join(of_parts, "id"))
            # one member of each component
            heads = state.where(F.col("id") == F.col("comp"))
            parts = heads.groupBy("family").agg(tiles_for(F.count("*"), F.sum("n")).alias("parts"))
            heads = heads.join(parts, "family").select("id", "family", "comp", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"))
            over = scratch.keep(merged(many.join(scratch.keep(heads), "id"), False))
            state = scratch.keep(raised(state, over))
            # members outside of their family's largest component against all
            by_comp = state.groupBy("family", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
            largest = by_comp.groupBy("family").agg(F.max_by("comp", F.struct("m", "w", "comp")).alias("main"))
            outside = by_comp.join(largest, "family").where(F.col("comp") != F.col("main")).groupBy("family", "main").agg(tiles_for(F.sum("m"), F.sum("w")).alias("parts"))
            open_ = scratch.keep(state.join(scratch.keep(outside), "family"))
            place = lambda tile, part, side: F.struct(tile.alias("tile"), part.alias("part"), F.lit(side).alias("side"))
            here = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda part: place(F.col("tile"), part, 0))
            mine = F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int")
            there = F.when(F.col("comp") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda tile: place(tile, mine, 1)))
            dealt = open_.select("id", "family", "comp", F.explode(F.concat(here, F.coalesce(there, F.array().cast("array<struct<tile:int,part:int,side:int>>")))).alias("at"))
            last = scratch.keep(merged(many.join(dealt.select("id", "family", "comp", "at.*"), "id"), True))
            one = scratch.keep(raised(raised(one, over), last))
        scratch.drop(many)
    linked = classes.join(one, F.col("rep") == F.col("id"), "left").select("hi", "lo", F.coalesce("comp", "rep").alias("component"))
    linked = scratch.keep(linked)
    out = rows.join(linked, ["hi", "lo"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mixed(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)).view(np.int64))], names=["h"])
