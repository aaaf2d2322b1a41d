import random
import zlib
from collections import Counter, defaultdict

import pytest

from readloom.llm import sharding
from readloom.llm.sharding import shard_documents


def smallest(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        n, room = 1, mid
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("segments", [16, 256, 1 << 16])
def test_capacity_is_the_least_whatever_the_driver_may_hold(spark, segments):
    rng = random.Random(segments)
    groups = sorted((rng.randrange(-(1 << 63), 1 << 63), rng.choice([3, 50, 700, 9000])) for _ in range(400))
    table = spark.createDataFrame(groups, "h long, size long")
    firsts, capacity = sharding.boundaries(table, 16, segments)
    assert capacity == smallest([s for _, s in groups], 16)
    sums = Counter()
    for h, s in groups:
        sums[sum(h >= f for f in firsts)] += s
    assert max(sums.values()) <= capacity


def test_contract(docs, rows):
    got = shard_documents(docs, rows_a_part=7).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, places = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        places[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert all(len(p) == 1 for p in places.values())


def test_one_group_and_no_group(spark, empty):
    same = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string")
    got = shard_documents(same, rows_a_part=9).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(50))
    assert shard_documents(empty).count() == 0
