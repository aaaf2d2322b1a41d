"""How a record differs from its reference, as rows.

One walk along the operations keeps a place in the read and one on the
reference. Substitutions come from the MD tag if there is one, else from the
reference, else only from X operations. `differences` is that walk for one
record; `batch_differences` makes the same rows for an Arrow batch at once, with
running sums instead of steps, and calls `differences` only where an MD tag
doesn't fit its operations. The result is an array of structs, to be exploded
natively. A base past the end of the stored sequence has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.codec.bam import spread
from readloom.functions.columns import length_on_ref

ship(__name__)

#: The kinds of difference are told by the character code of their letter.
SUBSTITUTION, INSERTION, DELETION, SKIP, SOFT_CLIP, HARD_CLIP = map(ord, "XIDNSH")
BASES = "=ACMGRSVTWYHKDBN"
ROW = "struct<code:int,ref_pos:int,length:int,bases:string,qual:int,ref_base_code:int,clip_length:int>"
FAR = 1 << 62


class MdReader:
    """The MD tag as a stream: counts of equal bases, reference letters, deletions."""

    def __init__(self, text: bytes) -> None:
        self.text, self.at, self.equal = text, 0, 0

    def _numbers(self) -> None:
        while not self.equal and self.at < len(self.text) and 48 <= self.text[self.at] <= 57:
            end = self.at
            while end < len(self.text) and 48 <= self.text[end] <= 57:
                end += 1
            self.equal, self.at = int(self.text[self.at:end]), end

    def equals(self, most: int) -> int:
        """How many bases, at most `most`, the tag says are equal next; they are used up."""
        self._numbers()
        n = min(self.equal, most)
        self.equal -= n
        return n

    def letter(self) -> int:
        """The reference base that is replaced next; 0 if the tag doesn't name one."""
        if not self.equal and self.at < len(self.text) and 65 <= self.text[self.at] <= 90:
            self.at += 1
            return self.text[self.at - 1]
        return 0

    def deletion(self) -> None:
        self._numbers()
        if not self.equal and self.at < len(self.text) and self.text[self.at] == 94:
            self.at += 1
            while self.at < len(self.text) and 65 <= self.text[self.at] <= 90:
                self.at += 1


def codes(seq: str) -> np.ndarray:
    """4-bit codes of a reference text: case ignored, unknown letters as N."""
    return CODE_OF[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def differences(ops, seq: str, md: bytes | None, qual: bytes | None, start: int, ref: str | None = None, ref_start: int = 0,
                window: tuple[int, int] | None = None, origin: int = 0) -> list[tuple[int, int, int, str, int, int, int]]:
    """(code, ref_pos, length, bases, qual, ref_base_code, clip_length) in the order of the walk.

    The window is in absolute positions and half-open; ref_pos counts from `origin`.
    """
    low, high = (window[0] - start, window[1] - start) if window else (-FAR, FAR)
    tag = MdReader(md) if md else None
    known = codes(ref) if ref and (tag is None or any((w & 15) == 8 for w in ops)) else None
    shift = start - ref_start  # place of the read's start in the reference text
    mine = codes(seq) if known is not None else None
    out: list[tuple[int, int, int, str, int, int, int]] = []
    r = s = 0

    def substitution(i: int, j: int, code: int) -> None:
        if low <= j < high and i < len(seq):
            out.append((SUBSTITUTION, start - origin + j, 1, seq[i], qual[i] if qual and i < len(qual) else -1, code, 0))

    def reference_letter(j: int) -> int:
        k = j + shift
        return ord(BASES[known[k]]) if known is not None and 0 <= k < len(known) else 0

    for word in ops:
        if r >= high:
            break
        word &= 0xFFFFFFFF
        n, op = word >> 4, word & 15
        if op in (0, 7):  # M and =
            if not seq:
                pass
            elif tag is not None:
                done = 0
                while done < n:
                    done += tag.equals(n - done)
                    if done < n:
                        letter = tag.letter()
                        if not letter:
                            break  # the tag says nothing about the rest of this run
                        substitution(s + done, r + done, letter)
                        done += 1
            elif known is not None:
                a, b = max(0, -(r + shift)), min(n, len(known) - (r + shift), len(seq) - s)
                if a < b:
                    here, there = mine[s + a:s + b], known[r + shift + a:r + shift + b]
                    for k in np.flatnonzero((here != there) | (here == 0)).tolist():
                        substitution(s + a + k, r + a + k, ord(BASES[there[k]]))
            r, s = r + n, s + n
        elif op == 8:  # X
            if seq:
                for k in range(n):
                    letter = 0
                    if tag is None:
                        letter = reference_letter(r + k)
                    elif not tag.equals(1):
                        letter = tag.letter() or reference_letter(r + k)
                    substitution(s + k, r + k, letter)
            r, s = r + n, s + n
        elif op == 1:  # I
            if low <= r < high:
                out.append((INSERTION, start - origin + r, 0, seq[s:s + n], -1, 0, n))
            s += n
        elif op in (2, 3):  # D and N
            if tag is not None and op == 2:
                tag.deletion()
            if r < high and r + n > low:
                out.append((DELETION if op == 2 else SKIP, start - origin + r, n, "", -1, 0, 0))
            r += n
        elif op in (4, 5):  # S and H
            if low <= r < high:
                out.append((SOFT_CLIP if op == 4 else HARD_CLIP, start - origin + r, 0, "", -1, 0, n))
            s += n if op == 4 else 0
    return out


FIELDS = [("code", pa.int32()), ("ref_pos", pa.int32()), ("length", pa.int32()), ("bases", pa.string()), ("qual", pa.int32()), ("ref_base_code", pa.int32()), ("clip_length", pa.int32())]
CODE_OF = np.full(256, 15, np.uint8)
for _i, _c in enumerate(BASES):
    CODE_OF[ord(_c)] = CODE_OF[ord(_c.lower())] = _i
LETTER = np.frombuffer(BASES.encode(), np.uint8)
ON_REF, ON_READ = (np.isin(np.arange(16), ops) for ops in ((0, 2, 3, 7, 8), (0, 1, 4, 7, 8)))
ALIGNED = np.isin(np.arange(16), (0, 7, 8))
AT_ONCE = 1 << 22  # bases that are laid out side by side


def _bytes(a: pa.Array, kind: pa.DataType, none: str | bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins (and the last one ends), and the bytes."""
    a = a.cast(kind).fill_null(none)
    ends, data = a.buffers()[1], a.buffers()[2]
    at = np.frombuffer(ends, np.int32)[a.offset:a.offset + len(a) + 1].astype(np.int64) if ends is not None and len(a) else np.zeros(len(a) + 1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _before(n: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The sum of what comes before each element, within its owner; `first` is where owners begin."""
    c = np.concatenate([[0], np.cumsum(n)])
    return c[:-1] - c[first][owner]


def _md_tokens(at: np.ndarray, text: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, ...]:
    """Letters and deletions of the MD tags of the records in `use`.

    (letter's record, aligned place, letter), (deletion's record, aligned place),
    bases that each record's tag tells of, and which records hold anything else.
    """
    n = len(use)
    owner, i = spread(at[:-1], np.where(use, at[1:], at[:-1]))
    b = text[i]
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    ahead = np.concatenate([same[1:], [False]])
    digit, upper, caret = (b >= 48) & (b <= 57), (b >= 65) & (b <= 90), b == 94
    before = lambda x: np.concatenate([[False], x[:-1]]) & same
    begins = upper & ~before(upper)
    run = np.cumsum(begins) - 1
    gone = upper & before(caret)[np.flatnonzero(begins)][run] if begins.any() else upper  # letters of a deletion
    odd = np.zeros(n, bool)
    odd[owner[~(digit | upper | caret) | (caret & ~(ahead & np.concatenate([upper[1:], [False]])))]] = True
    told = (upper & ~gone).astype(np.int64)
    last = np.flatnonzero(digit & ~(ahead & np.concatenate([digit[1:], [False]])))
    first = np.flatnonzero(digit & ~before(digit))
    for k in range(int((last - first).max(initial=-1)) + 1):  # one turn for each digit of the longest number
        live = last - k >= first
        told[last[live]] += (b[last[live] - k].astype(np.int64) - 48) * 10**min(k, 18)
    begin = np.searchsorted(owner, np.arange(n))
    place = _before(told, begin, owner)
    total = np.bincount(owner, told, n).astype(np.int64)
    letters = np.flatnonzero(upper & ~gone)
    cuts = np.flatnonzero(caret)
    return owner[letters], place[letters], b[letters], owner[cuts], place[cuts], total, odd


def batch_differences(walk: list[pa.Array], window: tuple[int, int] | None = None, origin: int = 0) -> pa.ListArray:
    """`differences` of each record of a batch: cigar, seq, md, qual, start, reference and its start."""
    cigar, seq_text, md_text, qual_text, starts, ref_text, ref_starts = walk
    n = len(starts)
    start, ref_start = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, ref_starts))
    seq_at, seq = _bytes(seq_text, pa.string(), "")
    md_at, md = _bytes(md_text, pa.binary(), b"")
    qual_at, qual = _bytes(qual_text, pa.binary(), b"")
    ref_at, ref = _bytes(ref_text, pa.string(), "")
    seq_n, md_n, qual_n, ref_n = (np.diff(x) for x in (seq_at, md_at, qual_at, ref_at))
    low, high = (window[0] - start, window[1] - start) if window else (np.full(n, -FAR), np.full(n, FAR))
    shift = start - ref_start

    counts = cigar.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = cigar.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF
    size, op = words >> 4, words & 15
    rec = np.repeat(np.arange(n), counts)
    first = np.cumsum(counts) - counts
    r, s, q = (_before(np.where(which[op], size, 0), first, rec) for which in (ON_REF, ON_READ, ALIGNED))
    aligned = np.bincount(rec, np.where(ALIGNED[op], size, 0), n).astype(np.int64)

    has_md = (md_n > 0) & (seq_n > 0)
    letter_rec, letter_q, letter, cut_rec, cut_q, told, odd = _md_tokens(md_at, md, has_md)
    # a deletion of the tag must meet one of the operations; the bases of all records count through
    base = np.cumsum(aligned + 1) - aligned - 1
    cut_key, cut_n = np.unique(base[cut_rec] + np.minimum(cut_q, aligned[cut_rec] + 1), return_counts=True)
    dels = (op == 2) & (size >= 0)
    del_key = np.sort((base[rec] + q)[dels])
    short = cut_n > np.searchsorted(del_key, cut_key, "right") - np.searchsorted(del_key, cut_key, "left")
    bad = np.concatenate([cut_key[short], (base[cut_rec] + aligned[cut_rec] + 1)[cut_q > aligned[cut_rec]]])
    odd[np.searchsorted(base, bad, "right") - 1] = True
    odd[cut_rec[cut_q > aligned[cut_rec]]] = True
    slow = has_md & odd
    if (len(seq) and seq.max() > 127) or (len(ref) and ref.max() > 127):
        slow[:] = True
    plain = ~slow

    parts: list[tuple[np.ndarray, ...]] = []  # (operation, place in it, code, reference offset, length, first base, bases, reference letter, clip)

    def put(i: np.ndarray, k: np.ndarray, code, length, b_at, b_n, fb, clip) -> None:
        parts.append(tuple(np.broadcast_to(x, len(i)) for x in (i, k, code, r[i] + k, length, b_at, b_n, fb, clip)))

    near = (r >= low[rec]) & (r < high[rec]) & plain[rec]
    zero = np.zeros(1, np.int64)
    i = np.flatnonzero((op == 1) & near)
    put(i, zero, INSERTION, 0, seq_at[rec[i]] + s[i], np.clip(seq_n[rec[i]] - s[i], 0, size[i]), 0, size[i])
    for c, code in ((4, SOFT_CLIP), (5, HARD_CLIP)):
        i = np.flatnonzero((op == c) & near)
        put(i, zero, code, 0, 0, 0, 0, size[i])
    for c, code in ((2, DELETION), (3, SKIP)):
        i = np.flatnonzero((op == c) & plain[rec] & (r < high[rec]) & (r + size > low[rec]))
        put(i, zero, code, size[i], 0, 0, 0, 0)

    def reference_letter(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        at = r[i] + shift[rec[i]] + k
        ok = (at >= 0) & (at < ref_n[rec[i]])
        if not len(ref):
            return np.zeros(len(i), np.int64)
        return np.where(ok, LETTER[CODE_OF[ref[np.where(ok, ref_at[rec[i]] + at, 0)]]], 0).astype(np.int64)

    # letters of the MD tags
    fits = plain[letter_rec] & (letter_q < aligned[letter_rec])
    letter_rec, letter_q, letter = letter_rec[fits], letter_q[fits], letter[fits].astype(np.int64)
    runs = np.flatnonzero(ALIGNED[op] & (size > 0))
    run_key = (base[rec] + q)[runs]
    key = base[letter_rec] + letter_q
    i = runs[np.searchsorted(run_key, key, "right") - 1] if len(runs) else np.zeros(0, np.int64)
    k = letter_q - q[i]
    j = r[i] + k
    m = (op[i] != 8) & (j >= low[rec[i]]) & (j < high[rec[i]]) & (s[i] + k < seq_n[rec[i]])
    put(i[m], k[m], SUBSTITUTION, 1, (seq_at[rec[i]] + s[i] + k)[m], 1, letter[m], 0)

    def ranges(i: np.ndarray, known: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Operations and places in them that lie in the window, the sequence and, if `known`, the reference."""
        of = rec[i]
        a, b = np.maximum(0, low[of] - r[i]), np.minimum(np.minimum(size[i], seq_n[of] - s[i]), high[of] - r[i])
        if known:
            a, b = np.maximum(a, -(r[i] + shift[of])), np.minimum(b, ref_n[of] - r[i] - shift[of])
        some = a < b
        i, a, b = i[some], a[some], b[some]
        out, at = [], 0
        ends = np.cumsum(b - a)
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            of, k = spread(a[at:to], b[at:to])
            out.append((i[at:to][of], k))
            at = to
        return out

    for i, k in ranges(np.flatnonzero((op == 8) & plain[rec]), False):
        fb = reference_letter(i, k)
        tagged = has_md[rec[i]]
        if tagged.any():
            at = np.searchsorted(key, base[rec[i]] + q[i] + k)
            hit = np.zeros(len(i), bool)
            if len(key):
                hit = key[np.minimum(at, len(key) - 1)] == base[rec[i]] + q[i] + k
            named = letter[np.minimum(at, len(key) - 1)] if len(key) else fb
            fb = np.where(tagged & hit, named, np.where(tagged & (q[i] + k < told[rec[i]]), 0, fb))
        put(i, k, SUBSTITUTION, 1, seq_at[rec[i]] + s[i] + k, 1, fb, 0)
    for i, k in ranges(np.flatnonzero(((op == 0) | (op == 7)) & plain[rec] & ~has_md[rec] & (ref_n[rec] > 0)), True):
        mine = CODE_OF[seq[(seq_at[rec] + s)[i] + k]]
        there = CODE_OF[ref[(ref_at[rec] + r + shift[rec])[i] + k]]
        m = np.flatnonzero((mine != there) | (mine == 0))
        i, k, fb = i[m], k[m], LETTER[there[m]].astype(np.int64)
        put(i, k, SUBSTITUTION, 1, seq_at[rec[i]] + s[i] + k, 1, fb, 0)

    i, k, code, j, length, b_at, b_n, fb, clip = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(i << 32 | k, kind="stable")
    i, k, code, j, length, b_at, b_n, fb, clip = (x[order] for x in (i, k, code, j, length, b_at, b_n, fb, clip))
    of = rec[i]
    q_at = s[i] + k
    has = (code == SUBSTITUTION) & (q_at < qual_n[of])
    q_of = np.where(has, qual[np.where(has, qual_at[of] + q_at, 0)].astype(np.int64), -1) if len(qual) else np.full(len(i), -1)
    _, at = spread(b_at, b_at + b_n)
    ends = np.concatenate([[0], np.cumsum(b_n)]).astype(np.int32)
    bases = pa.StringArray.from_buffers(len(i), pa.py_buffer(ends), pa.py_buffer(seq[at].tobytes()))
    number = lambda x: pa.array(x.astype(np.int32))
    cells = pa.StructArray.from_arrays([number(code), number(start[of] - origin + j), number(length), bases, number(q_of), number(fb), number(clip)], names=[f for f, _ in FIELDS])
    per = np.bincount(of, minlength=n)
    if not slow.any():
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), cells)
    at = np.flatnonzero(slow)
    take = pa.array(at)
    got = [
        differences(c or [], b or "", m, x, p or 0, f, o or 0, window, origin)
        for c, b, m, x, p, f, o in zip(*(x.take(take).to_pylist() for x in walk), strict=True)
    ]
    rows = [x for g in got for x in g]
    more = pa.StructArray.from_arrays([pa.array([x[c] for x in rows], kind) for c, (_, kind) in enumerate(FIELDS)], names=[f for f, _ in FIELDS])
    owner = np.concatenate([of, np.repeat(at, [len(g) for g in got])])
    cells = pa.concat_arrays([cells, more]).take(pa.array(np.argsort(owner, kind="stable")))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)), cells)


def mismatches(reads: DataFrame, *, keep: list[str], cigar: str = "cigar", seq: str = "seq", md: str | None = "md", qual: str | None = "qual",
               reference: str | None = None, reference_start: str | None = None, window: tuple[int, int] | None = None, origin: int = 0) -> DataFrame:
    """Columns `keep` and a column `mismatches`: an array of ROW for each record.

    With a window only records that reach it go on, and of the reference only
    what lies in it is sent to Python.
    """
    null = F.lit(None)
    ref_text = F.col(reference) if reference else null.cast("string")
    ref_from = F.col(reference_start).cast("long") if reference_start else F.lit(0).cast("long")
    if window:
        low, high = (F.lit(x).cast("long") for x in window)
        # a clip at the record's end stands at its end position
        reads = reads.where((F.col("start") < high) & (F.col("start") + length_on_ref(F.col(cigar)) >= low))
        cut_from = F.greatest(ref_from, low)
        size = F.greatest(F.least(ref_from + F.length(ref_text), high) - cut_from, F.lit(0).cast("long"))
        ref_text, ref_from = F.substring(ref_text, (cut_from - ref_from + 1).cast("int"), size.cast("int")), cut_from
    columns: list[Column] = [
        F.col(cigar).alias("c"), F.coalesce(F.col(seq), F.lit("")).alias("s"), (F.col(md).cast("binary") if md else null.cast("binary")).alias("m"),
        (F.col(qual) if qual else null.cast("binary")).alias("q"), F.col("start").cast("int").alias("p"), ref_text.alias("r"), ref_from.alias("o"),
    ]
    rows = reads.select(*keep, F.struct(*columns).alias("_walk"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = batch_differences(b.column(b.num_columns - 1).flatten(), window, origin)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), lists], names=[*keep, "mismatches"])

    return rows.mapInArrow(run, f"{kinds}, mismatches array<{ROW}>")


def mismatch_rows(with_mismatches: DataFrame, *, outer: bool = False) -> DataFrame:
    """A row for each difference; with `outer` also one, all null, for records without any."""
    explode = F.explode_outer if outer else F.explode
    others = [c for c in with_mismatches.columns if c != "mismatches"]
    return with_mismatches.select(*others, explode("mismatches").alias("m")).select(*others, "m.*")
