"""Benchmark decontamination: CGK embedding, bit sampling, exact edit distance.

Texts and items become words: ASCII punctuation removed, A-Z lower-cased, runs
of [^\\x20\\x09-\\x0D]. A document leaks an item if some run of its words is
within edit distance `rate` x (words of the item) of the item.

Long items are cut into parts of `part` words or more; if the whole item has few
edits, one part has no more than its share. From every start in a document the
words walk through the CGK random walk: at step j the current word is put out
and bit j of the word's hash says whether to move on. Edit distance becomes
Hamming distance, and the walk has one length for all items, so a document is
walked once a seed. Repeated samples of a few positions are looked up among the
items' own samples. The number of repeats is chosen when the items are prepared:
repeats are added until the wanted share of edited copies of the items' parts, of
each length, is found again; where `most_repeats` don't do, that is an error. An edit takes at most three of the word pairs that a part shares with its
place, so a start whose next words hold too few pairs of any item isn't walked:
it can't be within the distance. Hits are confirmed by the exact edit distance
between the item and its best place in the surrounding words.

The work is one pass over whole texts without a shuffle. Items come in blocks of
at most `block_items`, a bound of what is broadcast; the documents are read once
a block. Null texts and items, and those without words, leak nothing. Repeated
rows give repeated results; a null doc_id is passed on as null. Other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm.common import Sent

ship(__name__)

PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).lower().split()


@dataclass
class Index:
    """Items of one block and their samples."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]
    part: int
    rate: float
    bits: list[np.ndarray]  # a walk's bits of each word code
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted codes of the items' word pairs
    fewest: int = 0  # pairs that any part keeps under its edits
    samples: list[np.ndarray] = field(default_factory=list)  # positions, by repeat; repeat r uses walk r % len(bits)
    keys: list[np.ndarray] = field(default_factory=list)
    owner: list[np.ndarray] = field(default_factory=list)  # (item, offset of the part), in the order of keys
    recall: float = 0.0  # share of the edited copies that some repeat found, of the length with the least

    def allowed(self, item: int) -> int:
        return int(self.rate * len(self.words[item]))


def walk(code: np.ndarray, start: np.ndarray, bits: np.ndarray, steps: int) -> np.ndarray:
    """The embedding from each start: the words put out, one column a step. Past its end a text reads 0."""
    code = np.concatenate([code, np.zeros(1, code.dtype)])
    end = len(code) - 1
    out = np.empty((len(start), steps), code.dtype)
    at = start.copy()
    for j in range(steps):
        out[:, j] = code[at]
        at = np.minimum(at + ((bits[out[:, j]] >> np.uint64(j)) & np.uint64(1)).astype(np.int64), end)
    return out


def sample_key(put_out: np.ndarray, positions: np.ndarray) -> np.ndarray:
    h = np.zeros(len(put_out), np.uint64)
    for p in positions:
        h = (h + put_out[:, p].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def prepare(items: list[tuple[int, str]], *, part: int, rate: float, recall: float, walks: int, picks: int, most: int, seed: int, tries: int = 12) -> Index | None:
    """Embed the items' parts and add repeats until `recall` of edited copies of each length are found; an error if `most` don't do.

    Of `tries` random choices of positions a repeat takes the one that finds most of what is still missed.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    ids, coded = [], []
    for i, text in items:
        if w := tokens(text):
            ids.append(i)
            coded.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int32))
    if not ids:
        return None
    hashed = np.array([0, *map(xxhash.xxh3_64_intdigest, vocabulary)], np.uint64)
    bits = [(hashed ^ np.uint64(s)) * np.uint64(0xD6E8FEB86659FD93) for s in rng.integers(1, 1 << 62, walks)]
    bits = [b ^ (b >> np.uint64(32)) for b in bits]
    bits = [b * np.uint64(0xD6E8FEB86659FD93) ^ (b >> np.uint64(17)) for b in bits]
    index = Index(ids, coded, vocabulary, part, rate, bits)
    index.pairs = np.unique(np.concatenate([w[:-1].astype(np.int64) << 32 | w[1:] for w in coded]))
    sizes = {min(part, len(w)) for w in coded}
    index.fewest = min(n - 1 - 3 * int(rate * n) for n in sizes) if len(index.pairs) else 0
    owner, parts = [], []
    for k, w in enumerate(coded):
        for o in sorted({*range(0, max(1, len(w) - part + 1), part), max(0, len(w) - part)}):
            owner.append((k, o))
            parts.append(w[o:o + part])
    owners = np.array(owner)
    steps = 3 * part

    def embed(runs: list[np.ndarray], b: np.ndarray) -> np.ndarray:
        flat = np.concatenate([np.append(r, 0) for r in runs])
        starts = np.cumsum([0, *(len(r) + 1 for r in runs[:-1])])
        out = np.empty((len(runs), steps), np.int32)
        at, end = starts.copy(), starts + np.array([len(r) for r in runs])
        for j in range(steps):
            out[:, j] = flat[at]
            at = np.minimum(at + ((b[out[:, j]] >> np.uint64(j)) & np.uint64(1)).astype(np.int64), end)
        return out

    # edited copies of the parts, as many of each length: as many random insertions, deletions or
    # changes as a part may have, then words of the items by chance, which stand for what follows
    lengths = np.array([min(part, len(p)) for p in parts])
    classes = np.unique(lengths)
    trial_of = np.concatenate([rng.choice(np.flatnonzero(lengths == n), 2000 // len(classes)) for n in classes])
    after = rng.integers(0, len(vocabulary) + 1, (len(trial_of), steps))
    trials = []
    for t, rest in zip(trial_of, after, strict=True):
        n = int(lengths[t])
        r = coded[owners[t][0]][owners[t][1]:].tolist()
        for _ in range(int(rate * n)):
            p, kind = int(rng.integers(0, n)), rng.integers(0, 3)
            if kind == 0:
                r.insert(p, 0)
            elif kind == 1 and len(r) > 1:
                del r[min(p, len(r) - 1)]
            else:
                r[min(p, len(r) - 1)] = 0
        trials.append(np.array([*r, *rest], np.int32))
    whole = [coded[k][o:] for k, o in owner]
    put_items, put_trials = [embed(whole, b) for b in bits], [embed(trials, b) for b in bits]
    missed = np.ones(len(trials), bool)
    of = lengths[trial_of]
    while True:
        # a repeat for the length that is found least: it reads the first positions, which so many words feed in most walks
        found = [1 - float(missed[of == n].mean()) for n in classes]
        index.recall = min(found)
        if index.recall >= recall:
            return index
        r = len(index.samples)
        if r >= most:
            raise ValueError(f"only {index.recall:.3f} of edited copies are found after {r} repeats, not {recall}: allow more repeats or fewer edits")
        n = int(classes[int(np.argmin(found))])
        reach = min(steps, n + n // 2 if n < part else 2 * part)
        b = r % walks
        # a word is put out twice in the mean: positions with room between them read different words
        some = min(picks, n)
        apart = max(1, reach // (2 * some))
        tried = [np.sort(rng.choice(reach - (apart - 1) * (some - 1), some, replace=False)) + (apart - 1) * np.arange(some) for _ in range(tries)]
        hits = [sample_key(put_trials[b], p) == sample_key(put_items[b], p)[trial_of] for p in tried]
        best = int(np.argmax([(h & missed & (of == n)).sum() for h in hits]))
        index.samples.append(tried[best])
        k = sample_key(put_items[b], tried[best])
        order = np.argsort(k, kind="stable")
        index.keys.append(k[order])
        index.owner.append(owners[order])
        missed &= ~hits[best]


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance between the item and a run of the text: (distance, start, end)."""
    n = len(text)
    cost = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, w in enumerate(item, 1):
        sub = cost[:-1] + (text != w)
        new, src = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], src[0] = i, origin[0]
        up = cost[1:] + 1
        take = sub <= up
        new[1:], src[1:] = np.where(take, sub, up), np.where(take, origin[:-1], origin[1:])
        # insertions run along the row: a prefix minimum of new - column
        low = np.minimum.accumulate(new - steps)
        from_ = np.maximum.accumulate(np.where(new - steps == low, steps, 0))
        cost, origin = low + steps, src[from_]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


def starts_of(code: np.ndarray, index: Index) -> np.ndarray:
    """Where a part of an item may begin: the next words hold enough of the items' word pairs."""
    start = np.flatnonzero(code > 0)
    if index.fewest <= 0 or len(code) < 2:
        return start
    seen = np.flatnonzero((code[:-1] > 0) & (code[1:] > 0))
    pair = code[seen].astype(np.int64) << 32 | code[seen + 1]
    at = np.minimum(np.searchsorted(index.pairs, pair), len(index.pairs) - 1)
    here = np.zeros(len(code) + 1, np.int64)
    here[seen[index.pairs[at] == pair] + 1] = 1
    here = np.cumsum(here)
    return start[here[np.minimum(start + index.part - 1, len(code) - 1)] - here[start] >= index.fewest]


def leaks_in(texts: list[str | None], index: Index) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text: (item_id, distance, item words, start word, end word) of each item's best place."""
    get = index.vocabulary.get
    ends, flat = [0], []
    for text in texts:
        flat.extend([get(w, 0) for w in tokens(text)])
        flat.append(0)  # no run of words goes on into the next text
        ends.append(len(flat))
    code, bounds = np.array(flat, np.int32), np.array(ends)
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    start = starts_of(code, index)
    if not len(start):
        return out
    put_out = [walk(code, start, b, 3 * index.part) for b in index.bits]
    hits = []
    for r, pos in enumerate(index.samples):
        k = sample_key(put_out[r % len(index.bits)], pos)
        lo, hi = (np.searchsorted(index.keys[r], k, side=side) for side in ("left", "right"))
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        own = index.owner[r][np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        hits.append(np.stack([np.repeat(start[hit], n), own[:, 0], np.repeat(start[hit], n) - own[:, 1]], 1))
    found = np.concatenate(hits)
    doc = np.searchsorted(bounds, found[:, 0], side="right") - 1
    places = np.unique(np.stack([doc, found[:, 1], found[:, 2] - bounds[doc]], 1), axis=0)
    mark = np.zeros(len(index.vocabulary) + 1, bool)
    best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    for d, item, begin in places.tolist():
        words, most = index.words[item], index.allowed(item)
        m, text = len(words), code[bounds[d]:bounds[d + 1] - 1]
        got = best.get((d, item))
        if got and got[1] == 0:
            continue
        if begin >= 0 and np.array_equal(text[begin:begin + m], words):
            best[d, item] = (index.ids[item], 0, m, begin, begin + m)
            continue
        lo, hi = max(0, begin - 2 * most - 1), min(len(text), begin + m + 2 * most + 1)
        mark[text[lo:hi]] = True
        shared = int(mark[words].sum())
        mark[text[lo:hi]] = False
        if m - shared > most:
            continue  # every word of the item that isn't there costs an edit
        cost, a, b = best_place(words, text[lo:hi])
        if cost <= most and (not got or cost < got[1]):
            best[d, item] = (index.ids[item], cost, m, lo + a, lo + b)
    for (d, _), x in best.items():
        out[d].append(x)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
               part: int = 12, rate: float = 0.2, recall: float = 0.99, walks: int = 8, picks: int = 4, most_repeats: int = 256, block_items: int = 20_000, seed: int = 5) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, distance, item_words, start_word, end_word."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, distance int, item_words int, start_word int, end_word int"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"]
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in _indexes(items, item_id_col, item_text_col, block_items, part=part, rate=rate, recall=recall, walks=walks, picks=picks, most=most_repeats, seed=seed):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, got = [], []
                for i, found in enumerate(_in_steps(b.column(1), sent.value)):
                    at += [i] * len(found)
                    got += found
                cols = np.array([x[1:] for x in got], np.int32).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array([x[0] for x in got], pa.int64()), *(pa.array(cols[:, j]) for j in range(4))], names=names
                )

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def _in_steps(texts: pa.Array, index: Index) -> Iterator[list]:
    for first in range(0, len(texts), 250):
        yield from leaks_in(texts.slice(first, 250).to_pylist(), index)


def _indexes(items: DataFrame, id_col: str, text_col: str, block_items: int, **how) -> Iterator:
    """A broadcast index for each block of items."""
    one_each = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct().orderBy("i", "t")
    for block in batched(one_each.toLocalIterator(), block_items):
        index = prepare([(r.i, r.t) for r in block], **how)
        if index is not None:
            yield Sent(items.sparkSession, index)


def clean_documents(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                    part: int = 12, rate: float = 0.2, recall: float = 0.99, walks: int = 8, picks: int = 4, most_repeats: int = 256, block_items: int = 20_000, seed: int = 5) -> DataFrame:
    """The rows of the documents that leak no item, with all their columns, without a shuffle."""
    for sent in _indexes(items, item_id_col, item_text_col, block_items, part=part, rate=rate, recall=recall, walks=walks, picks=picks, most=most_repeats, seed=seed):

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=docs.columns.index(text_col)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not found for found in _in_steps(b.column(at), sent.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
