"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

Pass 1 reads whole texts and fills, for each input partition, a filter of the
keys it saw and one of the keys it saw in two rows or more. Only set positions
travel, by segment of the filter; a merge marks a position as twice-seen when
two partitions, or one alone, saw it so. A key in several documents has all its
positions marked, so no repeat is missed. The merged filter has at most
`max_filter_bits` bits whatever the input is, and that is the bound of what is
broadcast; beyond it the filter only lets more lines through.

Pass 2 lets the filter's suspects through as 128-bit digests, and only they are
shuffled: exact counts of documents and the largest doc_id, per key. A hot key
is pre-aggregated before the shuffle.

Pass 3 cuts the lines. Up to `broadcast_rows` confirmed keys (some 30 bytes each)
go to every task, and no text is shuffled. Beyond that, each document that loses
a line is joined with the digests that it loses, by its id; a filter of those
ids keeps the other documents out of the shuffle, and adaptive execution can
split the joins' hot keys. Both ways give the same rows.

Definitions. A text is split at \\n; null and empty texts are one empty line. A
key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Rows
that share a doc_id count as one document, and each loses the same lines. A row
with null id never counts and loses nothing. Columns named in `carry` pass
through; others aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm import bloom
from readloom.llm.common import BLANK_BYTES, Scratch, Sent, slices

ship(__name__)

def line_keys(text: str, least: int) -> list[bytes | None]:
    """A key for each line; None where the key is shorter than `least` code points."""
    out: list[bytes | None] = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(BLANK_BYTES).lower()
        out.append(key if len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least else None)
    return out


def digest(key: bytes) -> tuple[int, int]:
    """128 bits as two signed numbers."""
    raw = xxhash.xxh3_128_digest(key)
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def row_digests(text: str | None, least: int) -> list[tuple[int, int]]:
    return list({digest(k) for k in line_keys(text or "", least) if k is not None})


def key_hashes(docs: DataFrame, least: int) -> DataFrame:
    """Half of each digest, once a row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            got = [lo for doc, text in rows if doc is not None for _, lo in row_digests(text, least)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["h"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long")


class Keys:
    """Digests with a keeper each, for look-ups of many at a time."""

    def __init__(self, table: pa.Table) -> None:
        hi, lo = (table.column(c).to_numpy() for c in ("hi", "lo"))
        order = np.lexsort((hi, lo))
        self.hi, self.lo, self.keeper = hi[order], lo[order], table.column("keeper").combine_chunks().take(pa.array(order))

    def find(self, digests: list[tuple[int, int]]) -> Iterator[tuple[int, object]]:
        """(place in the list, keeper) of those that are known."""
        want = np.array(digests, np.int64).reshape(-1, 2)
        at = np.searchsorted(self.lo, want[:, 1])
        live = np.arange(len(want))
        while len(live):  # one turn, unless different keys share a half
            live = live[at[live] < len(self.lo)]
            live = live[self.lo[at[live]] == want[live, 1]]
            same = self.hi[at[live]] == want[live, 0]
            yield from zip(live[same].tolist(), self.keeper.take(pa.array(at[live[same]])).to_pylist(), strict=True)
            live = live[~same]
            at[live] += 1


def id_hash(doc: object) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(repr(doc).encode()), "big", signed=True)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 20, copies: int = 3,
                carry: list[str] | None = None, max_filter_bits: int = 1 << 28, broadcast_rows: int = 1 << 20) -> DataFrame:
    """One row a row: doc_id, the kept text, n_lines and n_dropped, then `carry`.

    Lines whose key has at least `least` code points and is in at least `copies`
    documents go, except in the largest doc_id that holds the key.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "line_dedup")
    carry = carry or []
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)))
    wide = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema]
    bits = bloom.bits_for(10 * df.count(), max_filter_bits)  # ten lines in a usual document
    filt = spark.sparkContext.broadcast(bloom.build(key_hashes(docs, least), bits, twice=True))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, got = [], []
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if doc is not None:
                    found = row_digests(text, least)
                    at += [i] * len(found)
                    got += found
            key = np.array(got, np.int64).reshape(-1, 2)
            hit = bloom.may_hold(filt.value, key[:, 1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(at, np.int64)[hit])), pa.array(key[hit, 0]), pa.array(key[hit, 1])], names=["doc_id", "hi", "lo"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = scratch.keep(docs.select("doc_id", "text").mapInArrow(suspects, f"doc_id {kind}, hi long, lo long"))
    confirmed = scratch.keep(
        found.dropDuplicates(["hi", "lo", "doc_id"]).groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= copies).drop("n")
    )
    schema = ", ".join([*wide, "n_lines long", "n_dropped long"])
    names = [*(w.split(" ")[0] for w in wide), "n_lines", "n_dropped"]

    def with_texts(b: pa.RecordBatch, lost: list[set[int]]) -> pa.RecordBatch:
        """The batch without the lines whose places are lost, by row."""
        texts, n, dropped = [], [], []
        for text, gone in zip(b.column(1).to_pylist(), lost, strict=True):
            lines = text.split("\n")
            n.append(len(lines))
            dropped.append(len(gone))
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *(b.column(i) for i in range(2, len(wide))), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    def back(out: DataFrame) -> DataFrame:
        return out.select("doc_id", "text", "n_lines", "n_dropped", *(F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)))

    if confirmed.count() <= broadcast_rows:
        scratch.drop(found)
        known = Sent(spark, Keys(confirmed.toArrow()))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                ids, row, line, got = b.column(0).to_pylist(), [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    if ids[i] is not None:
                        for j, k in enumerate(line_keys(text, least)):
                            if k is not None:
                                row.append(i)
                                line.append(j)
                                got.append(digest(k))
                lost: list[set[int]] = [set() for _ in ids]
                for at, keeper in known.value.find(got):
                    if ids[row[at]] != keeper:
                        lost[row[at]].add(line[at])
                yield with_texts(b, lost)

        return back(docs.mapInArrow(cut, schema))

    losers = scratch.keep(
        found.join(confirmed, ["hi", "lo"]).where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("gone")).select(F.col("doc_id").alias("_loser"), "gone")
    )
    scratch.drop(found, confirmed)

    def id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(id_hash, b.column(0).to_pylist()), pa.int64())], names=["h"])

    ids = losers.select("_loser")
    lose = spark.sparkContext.broadcast(bloom.build(ids.mapInArrow(id_hashes, "h long"), bloom.bits_for(ids.count(), max_filter_bits)))

    def split(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                may = bloom.may_hold(lose.value, np.array([id_hash(d) for d in b.column(0).to_pylist()], np.int64))
                yield b.filter(pa.array((may & np.array(b.column(0).is_valid())) == want))

        return docs.mapInArrow(run, ", ".join(wide))

    def cut_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lost = []
            for text, gone in zip(b.column(1).to_pylist(), b.column(b.schema.get_field_index("gone")).to_pylist(), strict=True):
                out = {(g["hi"], g["lo"]) for g in gone or ()}
                lost.append({i for i, k in enumerate(line_keys(text, least)) if k is not None and digest(k) in out} if out else set())
            yield with_texts(b, lost)

    dirty = split(True)
    dirty = dirty.join(losers, dirty.doc_id == losers._loser, "left").drop("_loser").mapInArrow(cut_joined, schema)
    clean = (
        split(False)
        .withColumn("n_lines", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long"))
        .withColumn("n_dropped", F.lit(0).cast("long"))
    )
    return back(clean.unionByName(dirty))
