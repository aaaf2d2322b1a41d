import hashlib
from collections import defaultdict

import pyarrow as pa
from readloom.llm import bloom
from readloom.llm.line_dedup import Keys, dedup_lines
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute_texts(rows):
    """(doc_id, lines, lines kept) of each row."""
    seen = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 20:
                seen[key(line)].add(doc)
    keeper = {k: max(v) for k, v in seen.items() if len(v) >= 3}
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        yield doc, lines, [x for x in lines if doc is None or keeper.get(key(x), doc) == doc]


def brute(rows):
    return sorted(((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for doc, lines, kept in brute_texts(rows)), key=str)


def test_equals_brute_force(docs, rows):
    got = dedup_lines(docs, carry=["lang", "n_chars"])
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "lang", "n_chars"]
    have = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256)).collect()
    assert sorted(map(tuple, have), key=str) == brute(rows)


def test_a_filter_that_is_too_small_changes_nothing(docs, rows):
    have = dedup_lines(docs, max_filter_bits=1 << 16).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256)).collect()
    assert sorted(map(tuple, have), key=str) == brute(rows)


def test_joined_lines_equal_brute_force(docs, rows):
    have = dedup_lines(docs, carry=["lang"], broadcast_rows=0).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256)).collect()
    assert sorted(map(tuple, have), key=str) == brute(rows)


def test_keys_that_share_a_half_stay_apart():
    known = Keys(pa.table({"hi": [5, 1, 3, 9], "lo": [7, 7, 7, 8], "keeper": ["five", "one", "three", "nine"]}))
    assert sorted(known.find([(3, 7), (9, 8), (9, 7), (5, 7), (1, 99)])) == [(0, "three"), (1, "nine"), (3, "five")]


def test_empty_table(empty):
    assert dedup_lines(empty, broadcast_rows=-1).count() == 0
    assert dedup_lines(empty).count() == 0


def test_bloom_holds_all_it_was_given(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h")).repartition(3)
    twice = hashes.unionByName(hashes.limit(100))
    filt = bloom.build(twice, 1 << 16)
    import numpy as np

    h = np.array([r.h for r in hashes.collect()], np.int64)
    assert bloom.may_hold(filt, h).all()
    again = bloom.build(hashes.unionByName(hashes), 1 << 20, twice=True)
    assert bloom.may_hold(again, h).all()
    assert bloom.may_hold(bloom.build(hashes, 1 << 20, twice=True), h).mean() < 0.1
