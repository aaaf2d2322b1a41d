import random

import numpy as np

from readloom.llm import near_dup, prefixes
from readloom.llm.components import connected_components
from readloom.llm.common import Scratch
from readloom.llm.near_dup import near_duplicates


def sets(rows):
    out = {}
    for doc, text, *_ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if doc is not None:
            out[doc] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows, num=85):
    s = sets(rows)
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= num * (len(s[a]) + len(s[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def check(got, rows):
    want = brute(rows)
    have = got.collect()
    assert len(have) == len(rows)
    for r in have:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert sum(i != c for i, (_, c) in want.items()) >= 10


def test_equals_brute_force(docs, rows):
    check(near_duplicates(docs), rows)


def test_families_of_many_tiles(docs, rows):
    check(near_duplicates(docs, tile_rows=2), rows)


def test_large_families_of_several_components(spark):
    """Near copies of one text, others between them and the next, and some that only share keys."""
    rng = random.Random(12)
    word = lambda: f"w{rng.getrandbits(40)}"
    rows, base = [], [word() for _ in range(200)]
    for k in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 6, 8, 10, 14])):
            w[rng.randrange(200)] = word()
        rows.append((1000 - k, " ".join(w)))
        if k % 9 == 0:
            base[rng.randrange(200)] = word()
    rows += [(2000 + k, " ".join(word() for _ in range(60))) for k in range(20)] + rows[:5]
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile_rows=6), rows)
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile_shingles=900), rows)


def test_words_are_told_apart_by_their_hashes(rows):
    words = sorted({w for r in rows for w in (r[1] or "").encode().lower().split()} | {b"x%d" % i for i in range(100_000)} | {bytes([97 + i % 2]) * n for i in range(2) for n in range(1, 400)})
    text = b" \t\n\x0b".join(words).decode()
    h = near_dup.hashed_words(text)
    assert len(h) == len(words) == len(set(h.tolist()))
    assert near_dup.hashed_words("Aé\x1cB  aÉ aé\x1cb").tolist()[0] == near_dup.hashed_words("\naé\x1cb\r")[0] and len(near_dup.hashed_words("\x1c é")) == 2
    assert len(near_dup.hashed_words(None)) == len(near_dup.hashed_words(" \n")) == 0


def test_empty_table(empty):
    assert near_duplicates(empty).count() == 0


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, near_dup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for i in range(len(b)):
        at = rng.choice(near_dup.SYMBOLS, near_dup.DISTANCE, replace=False)
        b[i, at] ^= 1
    assert ((near_dup.keys(a) == near_dup.keys(b)).any(1)).all()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 260)]}
    assert {r.id: r.component for r in got.collect()} == want


def test_symbols_follow_the_similarity():
    assert near_dup.symbols_for(85, 100) == near_dup.SYMBOLS == 32 and near_dup.symbols_for(80, 100) == 48
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, 48), dtype=np.uint16)
    b = a.copy()
    for i in range(len(b)):
        b[i, rng.choice(48, near_dup.distance(48), replace=False)] ^= 1
    assert ((near_dup.keys(a) == near_dup.keys(b)).any(1)).all()


def test_a_common_passage_makes_no_large_family(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    common = [word() for _ in range(40)]
    rows = [(i, " ".join(common + [word() for _ in range(20)])) for i in range(60)]
    rows += [(100 + i, text.rsplit(" ", 1)[0]) for i, text in rows[:12]]
    compared, keep = [], Scratch.keep

    def kept(self, df):
        out = keep(self, df)
        if "main" in out.columns:  # what is compared with all tiles of its family
            compared.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_duplicates(df, tile_rows=5), rows)
    assert sum(compared) == 0
    check(near_duplicates(df, tile_rows=5, max_places=1 << 15), rows)


def test_linked_sets_share_an_element_of_their_prefixes(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for n in [1, 2, 6, 7, 20, 41, 300] * 20:
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        common = a[:n * 2 // 3] % np.uint64(50)  # held by many
        a = np.unique(np.concatenate([common, a[n * 2 // 3:]]))
        out = int(rng.integers(0, max(1, int(len(a) * 0.16))))
        pairs.append((a, np.unique(rng.permutation(a)[out:])))
    sets = [x for p in pairs for x in p]
    df = spark.createDataFrame([(x.tobytes(),) for x in sets], "s binary").repartition(3)
    logs = prefixes.frequencies(df, 1 << 15)
    at = np.concatenate(sets) & np.uint64((1 << 15) - 1)
    assert (logs == np.log2(np.maximum(np.bincount(at.astype(np.int64), minlength=1 << 15), 1)).astype(np.uint8)).all()
    linked = 0
    for a, b in pairs:
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            linked += 1
            assert len(np.intersect1d(prefixes.prefix(a, logs, 85, 100), prefixes.prefix(b, logs, 85, 100)))
    assert linked > 50
