import re
import textwrap

import pytest

from readloom.llm import license_scan
from readloom.llm.license_scan import OTHERS, TEMPLATES, grams, plain_sample, scan_licenses, scan_text, train, words_of


@pytest.fixture(scope="module")
def model(docs):
    return train(plain_sample(docs))


def test_templates_are_known_in_other_words_too(model):
    for family, texts in TEMPLATES.items():
        for t in texts:
            for text in (t, t.upper(), f"lorem ipsum {t} dolor sit amet"):
                got = scan_text(text, model)
                assert len(got) == 1 and got[0][2] == family and got[0][5], (family, text, got)


@pytest.mark.parametrize("width", [30, 50, 72])
def test_wrapped_notices_are_one_paragraph(model, width):
    for family, texts in TEMPLATES.items():
        for t in texts:
            lines = textwrap.wrap(t, width, break_on_hyphens=False, break_long_words=False)
            if len(words_of(lines[0])) < 2:
                continue
            text = "\n".join(["Some prose goes here before", *("# " + x for x in lines), "And prose comes after it"])
            got = scan_text(text, model)
            assert [(g[:3], g[5]) for g in got] == [((1, len(lines), family), True)], (family, t, got)


def test_neighbouring_notices_stay_apart(model):
    text = "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nAll rights reserved.\n\nLicensed under CC BY-NC 4.0."
    assert [(g[0], g[1], g[2], g[5]) for g in scan_text(text, model)] == [(0, 1, "Apache-2.0", True), (1, 1, "MIT", True), (2, 1, "all-rights-reserved", True), (4, 1, "CC-BY-NC", True)]


def test_other_talk_of_licences_is_not_confirmed(model):
    for t in [*OTHERS, "The license of the fishing boat had expired in version two.", "free of charge", "the rights of the people"]:
        assert not any(g[5] for g in scan_text(t, model)), t


def test_probabilities_are_calibrated(model):
    p, right = model.held_out
    assert len(p) >= 150 and right.mean() >= 0.9
    assert abs(p.mean() - right.mean()) < 0.05
    sure = p > 0.9
    assert right[sure].mean() >= 0.95


def test_lines_without_a_key_have_no_feature(model, rows):
    for r in rows:
        for line in (r[1] or "").split("\n")[:50]:
            w = words_of(line)[:400]
            if model.keys.isdisjoint(w):
                assert not any(g in model.features for g in grams(w))


def brute(text):
    """(line, family) of lines that hold 70 % of the word pairs of templates of one family only, and no other line."""
    out = set()
    for i, line in enumerate((text or "").split("\n")):
        w = re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", line.lower())
        mine = set(zip(w, w[1:]))
        found = set()
        for family, ts in TEMPLATES.items():
            for t in ts:
                v = re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", t.lower())
                want = set(zip(v, v[1:]))
                if want and len(want & mine) >= 0.7 * len(want):
                    found.add((len(want & mine), family))
        if found:
            out.add((i, max(found)[1]))
    return out


def test_driver_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.paragraph, r.family) for r in scan_licenses(docs, train(plain_sample(docs))).where("confirmed").collect()}
    want = {(r.doc_id, i, f) for r in docs.collect() for i, f in brute(r.text)}
    assert got == want and len(want) >= 30


def test_scan(docs, rows, model, empty):
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in scan_licenses(docs, model).collect()}
    want = {}
    for r in rows:
        for i, line in enumerate((r[1] or "").split("\n")):
            if line.startswith("Licensed under the Apache"):
                want[r[0], i] = ("Apache-2.0", True)
            if line.startswith("Released under the MIT"):
                want[r[0], i] = ("MIT", True)
    assert got == want
    assert scan_licenses(empty, model).count() == 0


def test_trains_without_prose(empty):
    assert scan_text("Released under the MIT License.", train(plain_sample(empty)))[0][2] == "MIT"


def test_sample_is_bounded(spark):
    docs = spark.range(50_000).selectExpr("id as doc_id", "concat('line ', id, ' of text\n', 'more') as text")
    got = license_scan.plain_sample(docs, max_rows=40)
    assert len(got) == 40 == len(set(got))
