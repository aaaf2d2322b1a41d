from collections import defaultdict

import numpy as np
import pytest

from readloom.llm import suffix_dedup
from readloom.llm.suffix_dedup import repeated_passages


def brute(rows, least=50):
    words = {r[0]: [w.lower() for w in (r[1] or "").encode().split()] for r in rows if r[0] is not None}
    own = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            own[tuple(w[i:i + least])].add(d)
    out = {}
    for d, w in words.items():
        hit = [False] * len(w)
        for i in range(len(w) - least + 1):
            if len(own[tuple(w[i:i + least])]) > 1:
                hit[i:i + least] = [True] * least
        if any(hit):
            out[d] = hit
    return out


def test_covers_what_brute_force_covers(docs, rows):
    want = brute(rows)
    got = {d: [False] * len(h) for d, h in want.items()}
    for r in repeated_passages(docs).collect():
        assert r.n_words == r.end_word - r.start_word >= 50
        got[r.doc_id][r.start_word:r.end_word] = [True] * r.n_words
    assert got == want and len(want) >= 15


def test_a_partner_that_third_documents_hide_is_found(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    rows = []
    for family in range(8):  # cuts of one passage, 36 to 60 words of it, in texts of their own
        passage = prose(75)
        for k in range(30):
            n = int(rng.integers(36, 61))
            at = int(rng.integers(0, 75 - n + 1))
            rows.append((family * 100 + k, " ".join(prose(20) + passage[at:at + n] + prose(20))))
    want = brute(rows)
    got = {d: [False] * len(h) for d, h in want.items()}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id][r.start_word:r.end_word] = [True] * r.n_words
    assert got == want and len(want) >= 50


@pytest.mark.parametrize("times", [20, 150, 400])
def test_a_passage_that_one_document_repeats(spark, times):
    """Rows of one document fill whole partitions between those of the other one that holds the passage."""
    rng = np.random.default_rng(times)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = prose(60)
    rows = [(1, " ".join(w for _ in range(times) for w in passage + prose(30))), (2, " ".join(prose(20) + passage + prose(20)))]
    rows += [(10 + k, " ".join(prose(200))) for k in range(30)]
    want = brute(rows)
    got = {d: [False] * len(h) for d, h in want.items()}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id][r.start_word:r.end_word] = [True] * r.n_words
    assert got == want and sum(want[1]) == 60 * times


def test_partition_ends_hide_nothing(docs):
    spans = lambda n: sorted(map(tuple, repeated_passages(docs, docs_a_part=n).collect()))
    assert spans(2) == spans(10_000)


def test_empty_table(empty):
    assert repeated_passages(empty).count() == 0


def test_rolled_hashes_tell_runs_apart():
    a = np.random.default_rng(0).integers(0, 9, 300).astype(np.uint64)
    for n in (1, 2, 5, 8, 35):
        h = suffix_dedup.rolled(a, n)
        runs = [tuple(a[i:i + n]) for i in range(len(a) - n + 1)]
        assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs))


def test_equal_runs_share_a_minimiser():
    rng = np.random.default_rng(0)
    run = rng.integers(0, 1 << 60, 23).astype(np.uint64)
    places = []
    for _ in range(20):
        a = np.concatenate([rng.integers(0, 1 << 60, 50).astype(np.uint64), run, rng.integers(0, 1 << 60, 50).astype(np.uint64)])
        at = suffix_dedup.minimisers(a, 8, 16)
        places.append({int(x) - 50 for x in at if 50 <= x < 66})
    assert set.intersection(*places)


def test_a_small_filter_lets_little_through_that_does_not_repeat(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [[f"w{i}" for i in rng.integers(0, 50_000, 200)] for _ in range(3000)]
    for i in range(0, 60, 2):
        texts[i + 1][20:100] = texts[i][20:100]
    sizes = {}
    monkeypatch.setattr(suffix_dedup.Scratch, "keep", lambda self, df, real=suffix_dedup.Scratch.keep: sizes.setdefault(tuple(df.columns), real(self, df)))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = repeated_passages(df, max_filter_bits=1 << 16).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == [(i, 20, 100) for i in range(60)]
    found, first = (next(t.count() for c, t in sizes.items() if name in c) for name in ("after", "hash"))
    assert found < 3000 and first < 2000  # 23 suffixes a text, 69,000 in all; some 600 repeat
