import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import packing
from readloom.llm.packing import pack_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_named_library(text):
    from tokenizers import Tokenizer

    t = packing.once_per_process("test", lambda: Tokenizer.from_file(PATH))
    t.encode_special_tokens = True
    text = text.encode("utf-8", "ignore").decode()
    assert packing.encoder(PATH).encode_to_numpy(text, disallowed_special=()).tolist() == t.encode(text, add_special_tokens=False).ids


def test_equals_tokens_and_packs_whole(docs, rows, tokenizer):
    got = pack_documents(docs, PATH).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 1024) + 2


def test_salted_ranks_pack_as_well(docs):
    a, b = (pack_documents(docs, PATH, rows_a_part=n).select("sequence_id", "offset") for n in (3, 10_000))
    assert a.distinct().count() == a.count()
    assert a.select("sequence_id").distinct().count() == b.select("sequence_id").distinct().count()


def best(sizes, capacity):
    """Fewest bins, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    found = len(sizes)

    def go(i, bins):
        nonlocal found
        if len(bins) >= found:
            return
        if i == len(sizes):
            found = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= sizes[i] and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] - sizes[i], *bins[j + 1:]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return found


def is_whole(plan, sizes, capacity):
    used = Counter()
    for times, contents in plan.patterns:
        assert times > 0 and sum(s * k for s, k in contents) <= capacity
        for s, k in contents:
            used[s] += times * k
    return used == Counter(sizes) and plan.sequences == sum(n for n, _ in plan.patterns)


def test_plans_are_whole_and_shortest():
    rng = random.Random(3)
    searched = 0
    for i in range(400):
        sizes = [rng.randint(8, 30) for _ in range(rng.randint(8, 12))] if i % 2 else [rng.randint(1, 60) for _ in range(rng.randint(1, 10))]
        plan = packing.plan(Counter(sizes), 60)
        assert is_whole(plan, sizes, 60)
        assert plan.sequences == plan.bound == best(sizes, 60)
        searched += plan.steps > 0
    assert searched >= 20


def test_best_fit_alone_would_be_longer():
    sizes = [9, 10, 10, 14, 15, 18, 19, 25]
    assert sum(n for n, _ in packing.best_fit(Counter(sizes), 60)) == 3
    assert packing.plan(Counter(sizes), 60).sequences == 2


def test_parts_shorten_what_the_steps_leave_open():
    rng = random.Random(8)
    sizes = Counter(rng.choice([rng.randint(1, 1023), rng.randint(100, 600)]) for _ in range(3000))
    few, more = (packing.plan(sizes, 1024, max_steps=n) for n in (40, 20_000))
    assert is_whole(few, sizes, 1024) and is_whole(more, sizes, 1024)
    assert more.bound <= more.sequences <= few.sequences <= sum(n for n, _ in packing.best_fit(sizes, 1024))
    many = packing.plan({s: 10**6 * n for s, n in sizes.items()}, 1024, max_steps=3000)
    assert is_whole(many, {s: 10**6 * n for s, n in sizes.items()}, 1024)


def test_fillings_are_all_that_nothing_dominates():
    rng = random.Random(5)
    for _ in range(60):
        counts = Counter(rng.randint(2, 15) for _ in range(7))
        room = rng.randint(8, 30)
        left = np.zeros(room + 20, np.int64)
        for s, n in counts.items():
            left[s] = n
        pieces = sorted(counts.elements())
        sets = {c for k in range(len(pieces) + 1) for c in combinations(pieces, k) if sum(c) <= room}

        def swapped(c):
            spare = room - sum(c)
            parts = [p for k in range(len(c) + 1) for p in combinations(c, k)]
            return any(sum(p) < x <= sum(p) + spare or sum(p) == x and len(p) > 1 for x in counts - Counter(c) for p in parts)

        want = {c for c in sets if not swapped(c)}
        got = [f for f in packing.fillings(left, room, room) if f]
        assert {f for _, f in got} == want and len(got) == len(want)
        assert [w for w, _ in got] == sorted(room - sum(f) for f in want)
        for after in got:
            assert [f for f in packing.fillings(left, room, room, after) if f] == got[got.index(after) + 1:]


def test_bounds_never_exceed_the_shortest():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 9))]
        left = np.bincount(sizes, minlength=41)
        least = -(-(sum(sizes) + packing.least_waste(left, 40)) // 40)
        assert max(packing.lower_bound(left, 40), least) <= best(sizes, 40)


def test_empty_table(empty):
    assert pack_documents(empty, PATH).count() == 0
