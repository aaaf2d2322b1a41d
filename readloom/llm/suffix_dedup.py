"""Suffix-array dedup over sparse suffixes: passages that other documents repeat.

Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased. Suffixes are kept only
where a minimiser starts: the least hash among `window` runs of `kmer` words, so
equal passages keep the same places. A passage of `least` words holds, in its
first `window` starts, a suffix that shares its first least - window + 1 words.

Pass 1 counts the hashes of those first words, 8 bytes each, and fills a Bloom
filter (of bounded size) with those that repeat; pass 2 lets through the suffixes
whose hash may repeat, with the words on both sides that a match of `least` words
needs. They are sorted by the
words that follow, then by the words before, over range partitions that may
split any run of equal suffixes; each suffix is compared with its sorted
neighbours of other documents, and the match is extended right and left.

What neighbours can't settle (a match that would need a third document, or one
across a partition's end) is looked up, but for a head that one document alone
has: each passage of `least` words around a
head that the neighbours don't cover is wanted, by its hash, and so is any other
document that holds it. A hash is aggregated to its least and greatest document,
so a passage that many documents hold is one row. Matches of `least` words or
more give spans, and spans that overlap are united: they cover the words of all
passages of `least` words that another document holds, and no others. Words are
compared as 32-bit hashes, first words and wanted passages as one of 64 bits.

Null and short texts have no spans. Rows of one doc_id count as one document, a
null id takes no part, and other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm import bloom
from readloom.llm.common import Scratch, slices
from readloom.llm.near_dup import MIX, hashed_words, mixed

ship(__name__)


def rolled(a: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling."""
    if len(a) < n:
        return np.zeros(0, np.uint64)
    out, shift = None, 0
    block, size, power = a, 1, int(MIX)
    left = n
    while left:
        if left & 1:
            part = block[shift:shift + len(a) - n + 1]
            out = part if out is None else out * np.uint64(power) + part
            shift += size
        left >>= 1
        if left:
            block = block[:-size] * np.uint64(power) + block[size:]
            size, power = size * 2, power * power % (1 << 64)
    return mixed(out)


def minimisers(a: np.ndarray, kmer: int, window: int) -> np.ndarray:
    h = rolled(a, kmer)
    if len(h) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + view.argmin(1))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 50, kmer: int = 8, window: int = 16,
                      max_filter_bits: int = 1 << 28, docs_a_part: int = 2000) -> DataFrame:
    """A row for each united span: doc_id, start_word, end_word (exclusive), n_words."""
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix_dedup")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    head = least - window + 1  # words that the retained suffix of a passage surely shares
    side = window - 1  # words before it that may belong to the passage
    after = least - head  # words after the head that decide
    n_parts = max(12, -(-docs.count() // docs_a_part))

    def suffixes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = hashed_words(text)
        if len(a) < least:
            return a, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = minimisers(a, kmer, window)
        at = at[at + head <= len(a)]
        return a, at, rolled(a, head)[at]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [np.unique(suffixes(t)[2]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if d is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], names=["h"])

    # only what repeats fills the filter: one of all hashes is soon full, and lets everything through
    repeated = scratch.keep(docs.mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    filt = spark.sparkContext.broadcast(bloom.build(repeated, bloom.bits_for(repeated.count(), max_filter_bits)))
    scratch.drop(repeated)
    names = ["h", "after", "before", "n_after", "n_before", "doc_id", "pos"]
    schema = "h long, after binary, before binary, n_after int, n_before int, doc_id long, pos int"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 200):
                part = b.slice(first, 200)
                cols = [[] for _ in names]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if doc is None:
                        continue
                    a, at, h = suffixes(text)
                    if not len(at):
                        continue
                    hit = bloom.may_hold(filt.value, h)
                    at, h = at[hit], h[hit]
                    if not len(at):
                        continue
                    low = (a >> np.uint64(32)).astype(np.uint32)
                    wide = np.concatenate([np.zeros(side, np.uint32), low, np.zeros(after, np.uint32)])
                    right = wide[(at + side + head)[:, None] + np.arange(after)]
                    left = wide[(at + side)[:, None] - 1 - np.arange(side)]
                    for c, x in zip(cols, (h.view(np.int64), right, left, np.minimum(after, len(a) - at - head), np.minimum(side, at), np.full(len(at), doc), at), strict=True):
                        c.append(x)
                if not cols[0]:
                    continue
                h, right, left, na, nb, doc, at = (np.concatenate(c) for c in cols)
                raw = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (right, left)]
                yield pa.RecordBatch.from_arrays([pa.array(h), *raw, pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), pa.array(doc.astype(np.int64)), pa.array(at.astype(np.int32))], names=names)

    found = scratch.keep(docs.mapInArrow(kept, schema))

    def arrays(t: pa.Table):
        wide = [np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32).reshape(t.num_rows, n) for c, n in (("after", after), ("before", side))]
        return (t.column("h").to_numpy(), *wide, *(t.column(c).to_numpy() for c in names[3:]))

    def common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        differ = x != y
        return np.minimum(np.where(differ.any(1), differ.argmax(1), x.shape[1]), most)

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best right and left extension of each row with its neighbours of other documents."""
        h, right, left, na, nb, doc, _ = arrays(t)
        n = len(h)
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, int)
        run = np.searchsorted(edge, np.arange(n), side="right") - 1
        before = edge[run] - 1
        behind = np.concatenate([edge[1:], [n]])[run] if n else run
        best_r, best_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for other in (before, behind):
            i = np.flatnonzero((other >= 0) & (other < n))
            j = other[i]
            same = h[i] == h[j]
            i, j = i[same], j[same]
            r = head + common(right[i], right[j], np.minimum(na[i], na[j]))
            k = common(left[i], left[j], np.minimum(nb[i], nb[j]))
            ok = r + k >= least
            for best, x in ((best_r, r), (best_l, k)):
                best[i[ok]] = np.maximum(best[i[ok]], x[ok])
        return best_r, best_l, best_r > 0

    def alone(t: pa.Table) -> np.ndarray:
        """Rows whose head no other document has: the whole run of their hash is here, and of one document."""
        h, doc = (t.column(c).to_numpy() for c in ("h", "doc_id"))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        one = np.minimum.reduceat(doc, first) == np.maximum.reduceat(doc, first)
        one[[0, -1]] = False  # these may go on in other partitions
        return np.repeat(one, np.diff(np.append(first, len(h))))

    def windows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the passages of `least` words around each head, a column for each number of words before it, and which of them the text holds."""
        h, right, left, na, nb, _, _ = arrays(t)
        ahead, behind = (np.zeros((len(h), side + 1), np.uint64) for _ in range(2))
        for k in range(side):  # `after` is as long as `side`
            ahead[:, k + 1] = ahead[:, k] * MIX + right[:, k] + np.uint64(1)
            behind[:, k + 1] = behind[:, k] * MIX + left[:, k] + np.uint64(1)
        out = mixed(mixed(h.view(np.uint64)[:, None] ^ mixed(behind)) * MIX + ahead[:, ::-1])
        s = np.arange(side + 1)
        return out, (s <= nb[:, None]) & (side - s <= na[:, None])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        r, k, ok = compare(t)
        open_ = ~alone(t)
        del got
        s = np.arange(side + 1)
        for at in range(0, t.num_rows, 5000):
            part = t.slice(at, 5000)
            here = slice(at, at + part.num_rows)
            na, nb = (part.column(c).to_numpy() for c in ("n_after", "n_before"))
            want = (s <= nb[:, None]) & (side - s <= na[:, None]) & ((s > k[here, None]) | (least - s > r[here, None])) & open_[here, None]
            some = np.flatnonzero(want.any(1))  # the others are settled, and most are
            hash_, _ = windows(part.take(pa.array(some)))
            pos = part.column("pos").to_numpy()
            ends = pa.array(np.concatenate([[0], np.cumsum(want.sum(1))]).astype(np.int32))
            cols = [part.column("doc_id").combine_chunks(), *(pa.array(x.astype(np.int32)) for x in (pos, pos - k[here], pos + r[here])), pa.array(ok[here])]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hash_[want[some]].view(np.int64), np.broadcast_to(s.astype(np.int32), want.shape)[want])]
            out = pa.RecordBatch.from_arrays([*cols, *lists], names=["doc_id", "pos", "start", "end", "ok", "hash", "left"])
            yield out.filter(pa.array(ok[here] | want.any(1)))

    order = ["h", "after", "before", "doc_id", "pos"]
    out_schema = "doc_id long, pos int, start int, end int, ok boolean, hash array<long>, left array<int>"
    first = scratch.keep(found.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(scan, out_schema))

    # what the neighbours left open: wanted passages that two documents hold
    pairs = F.explode(F.arrays_zip("hash", "left")).alias("w")
    wanted = first.where(F.size("hash") > 0).select("doc_id", "pos", pairs).select("doc_id", "pos", F.col("w.hash").alias("hash"), F.col("w.left").alias("left"))
    n_wanted = first.agg(F.sum(F.size("hash"))).first()[0] or 0
    open_filt = spark.sparkContext.broadcast(bloom.build(wanted.select("hash"), bloom.bits_for(n_wanted, max_filter_bits)))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = pa.Table.from_batches([b.slice(at, 5000)])
                hash_, fits = windows(part)
                row = np.nonzero(fits)[0]
                hash_ = hash_[fits]
                hit = bloom.may_hold(open_filt.value, hash_)
                doc = part.column("doc_id").to_numpy()[row[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(hash_[hit].view(np.int64)), pa.array(doc)], names=["hash", "doc_id"])

    held = found.mapInArrow(holders, "hash long, doc_id long").groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where(F.col("a") < F.col("b")).select("hash")
    more = wanted.join(held, "hash").select("doc_id", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") - F.col("left") + least).alias("end"))
    spans = first.where("ok").select("doc_id", "start", "end").unionByName(more)
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(w))
    return island.groupBy("doc_id", "g").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words")
    )
