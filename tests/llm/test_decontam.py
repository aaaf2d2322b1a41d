from collections import Counter

import numpy as np
import pytest

from readloom.llm import decontam
from readloom.llm.decontam import clean_documents, find_leaks, tokens


def distance(item, text):
    """Edit distance of the item to its best run of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(rows, items):
    out = Counter()
    for r in rows:
        w = tokens(r[1])
        for i, text in items:
            item = tokens(text)
            if item and w and len(w) < 5000 and (d := distance(item, w)) <= int(0.2 * len(item)):
                out[r[0], i, d] += 1
    return out


def test_equals_brute_force(spark, docs, rows, passages):
    items = spark.createDataFrame(passages["items"], "item_id long, text string")
    got = find_leaks(docs, items).collect()
    want = brute(rows, passages["items"])
    assert Counter((r.doc_id, r.item_id, r.distance) for r in got) == want
    assert sum(want.values()) >= 4
    by_block = find_leaks(docs, items, block_items=2).collect()
    assert Counter((r.doc_id, r.item_id, r.distance) for r in by_block) == want


def test_clean_documents_stay(spark, docs, rows, passages):
    items = spark.createDataFrame(passages["items"], "item_id long, text string")
    dirty = {d for d, *_ in brute(rows, passages["items"])}
    kept = clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in dirty)


def edited(rng, w, most):
    w = list(w)
    for _ in range(most):
        k, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
        if kind == 0:
            w.insert(k, "zzz")
        elif kind == 1 and len(w) > 1:
            del w[k]
        else:
            w[k] = "zzz"
    return w


@pytest.mark.parametrize("lengths", [(40,), (15, 18), (8,), (5,), (2,), (1,), (1, 5, 8, 12, 40, 59)])
def test_recall_is_reached(lengths):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in range(3000)]
    items = [(i, " ".join(rng.choice(words, lengths[i % len(lengths)]))) for i in range(120)]
    index = decontam.prepare(items, part=12, rate=0.2, recall=0.99, walks=8, picks=4, most=256, seed=5)
    assert index.recall >= 0.99
    found = 0
    for i, text in items:  # with all the edits that are allowed, between words that items hold too
        w = edited(rng, text.split(), int(0.2 * len(text.split())))
        around = rng.choice(words, 60).tolist()
        found += i in {x[0] for x in decontam.leaks_in([" ".join(around[:30] + w + around[30:])], index)[0]}
    assert found >= 118


def test_recall_that_is_not_reached_is_an_error():
    items = [(0, " ".join(f"w{x}" for x in range(40)))]
    with pytest.raises(ValueError, match="edited copies"):
        decontam.prepare(items, part=12, rate=0.2, recall=0.99, walks=8, picks=4, most=2, seed=5)


def test_best_place_equals_cells():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        d, lo, hi = decontam.best_place(a, b)
        assert d == distance(a.tolist(), b.tolist())
        assert distance(a.tolist(), b[lo:hi].tolist()) == d


def test_empty_tables(spark, docs, empty, passages):
    items = spark.createDataFrame(passages["items"], "item_id long, text string")
    assert find_leaks(empty, items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0
    assert clean_documents(docs, items.limit(0)).count() == docs.count()
