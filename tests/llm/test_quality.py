import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import quality_classifier, quality_rules, stats, trees


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_equal_brute_force(rows):
    for r in rows:
        assert tuple(map(int, stats.describe(r[1])[:5])) == brute(r[1])


def test_rules(docs, rows, labels):
    model = quality_rules.fit_rules(docs, labels)
    got = quality_rules.apply_rules(docs, model).collect()
    want = Counter()
    for r in rows:
        n = brute(r[1])
        want[r[0], *n, n[0] < 50 or 100 * n[4] > 50 * n[0]] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def slow_margin(t, x):
    """One row and one node at a time."""
    total = t.base
    for root in t.roots:
        at = root
        while t.feature[at] >= 0:
            at = t.left[at] if x[t.feature[at]] <= t.threshold[at] else t.right[at]
        total += t.value[at]
    return total


def test_verdict_equals_brute_force(docs, rows, labels):
    model = quality_rules.fit_rules(docs, labels)
    assert len(model.roots) > 0
    want = Counter()
    for r in rows:
        n = brute(r[1])
        base = n[0] < 50 or 100 * n[4] > 50 * n[0]
        score = 1 / (1 + np.exp(-slow_margin(model, np.array(stats.describe(r[1])[5:]))))
        want[r[0], base, not base and score >= 0.3] += 1
    assert Counter((r.doc_id, r.base_failed, r.kept) for r in quality_rules.apply_rules(docs, model).collect()) == want
    assert len({k[2] for k in want}) == 2


def test_verdict_on_held_out_rows_of_the_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, labels)).join(labels, "doc_id").where(stats.is_held_out(F.col("doc_id")) & ~F.col("base_failed"))
    right, n = got.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert n >= 20 and right >= 0.95 * n


def test_marked_texts_never_score_higher(docs, labels):
    model = quality_rules.fit_rules(docs, labels)
    x = np.array([stats.describe(r.text)[5:] for r in docs.select("text").collect()])
    for name in quality_rules.FALLING:
        up = x.copy()
        up[:, quality_rules.INPUTS.index(name)] += 0.2
        assert (model.score(up) <= model.score(x) + 1e-12).all()


def test_accepted_rows_keep_all_columns(docs, rows, labels):
    rules = quality_classifier.fit_rules(docs, labels)
    out = quality_classifier.accepted(docs, rules)
    assert out.columns == docs.columns
    want = Counter(r.doc_id for r in quality_classifier.score_quality(docs, rules).where("predicted = 1").collect())
    assert Counter(r.doc_id for r in out.collect()) == want and 0 < sum(want.values()) < len(rows)


def test_trees_obey_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.1, 2000) > 0.6).astype(float)
    t = trees.fit(x, y, monotone={0: 1, 1: -1})
    for j, s in ((0, 1), (1, -1)):
        grid = np.repeat(rng.random((50, 3)), 40, 0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (s * np.diff(t.margin(grid).reshape(50, 40), axis=1) >= -1e-12).all()
    free = trees.fit(x, y)
    assert ((free.score(x) > 0.5) == y).mean() > 0.85


def test_column_equals_rules_by_hand(docs, labels):
    rules = quality_classifier.fit_rules(docs, labels)
    got = quality_classifier.score_quality(docs, rules).collect()
    for r in got:
        x = [r[c] for c in quality_classifier.INPUTS]
        m = rules.bias + sum(w for w, t in zip(rules.weights, rules.terms) if all((x[f] <= c) == below for f, c, below in t))
        assert abs(r.score - 1 / (1 + np.exp(-m))) < 1e-9
        assert r.predicted == int(r.score >= 0.3)


def test_learns_nothing_from_held_out_rows(spark, docs, labels):
    flipped = labels.withColumn("quality", F.when(stats.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.fit_rules(docs, labels) == quality_classifier.fit_rules(docs, flipped)


def test_held_out_accuracy_on_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.score_quality(docs, quality_classifier.fit_rules(docs, labels)).where("held_out").join(labels, "doc_id")
    right, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * n


def test_empty_tables(spark, empty, labels):
    rules = quality_classifier.fit_rules(empty, labels)
    assert quality_classifier.score_quality(empty, rules).count() == 0
    assert quality_rules.apply_rules(empty, quality_rules.fit_rules(empty, labels.limit(0))).count() == 0
