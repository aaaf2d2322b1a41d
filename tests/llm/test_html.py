import html
import re
import time

import numpy as np
import pytest

from readloom.llm import html_extract
from readloom.llm.html_blocks import blocks
from readloom.llm.html_extract import extract_pages, labelled_pages, train


@pytest.fixture(scope="module")
def model():
    return train(labelled_pages())


def test_blocks_of_broken_markup():
    page = "<body><p>a<b>b</b> &amp;c<p>d<ul><li>e<li>f</ul><table><tr><td>g<td>h</table><script>x<p></script><!-- no --><div class='Ad box'>i < j</div>k"
    got = blocks(page)
    assert [b.text for b in got] == ["ab &c", "d", "e", "f", "g", "h", "i < j", "k"]
    assert "c:ad" in got[6].path and "c:ad" not in got[7].path
    assert blocks(None) == blocks("") == [] and blocks("<p") is not None


def test_held_out_blocks(model):
    wrong = total = 0
    for page, labels in labelled_pages(150, seed=77):
        got = model.labels(page)
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_of_all_labellings(model):
    from itertools import product

    for page, _ in labelled_pages(30, seed=3):
        page = page[:8]
        e = [sum(model.weight.get(f, 0.0) for f in [*b.path, *html_extract.place_features(b.place), *html_extract.text_features(b, page[i - 1] if i else None, page[i + 1] if i + 1 < len(page) else None)]) for i, b in enumerate(page)]

        def score(y):
            return model.begin[y[0]] + sum(e[i] * y[i] for i in range(len(y))) + sum(model.step[a, b] for a, b in zip(y, y[1:]))

        best = max(score(y) for y in product((0, 1), repeat=len(page)))
        assert np.isclose(score([int(x) for x in model.labels(page)]), best)


def test_driver_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages, model).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def say(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(n))


@pytest.mark.parametrize("dot", [".", ""])
def test_articles_without_the_rest_of_the_page(model, dot):
    for seed in range(20):
        a, b, t = say(seed, 50) + dot, say(seed + 100, 30) + dot, say(seed + 200, 6)
        cases = [
            (f"<article><p>{a}</p></article>", a), (f"<p>{a}</p>", a), (a, a), (f"<main>{a}</main>", a),
            (f"<article><p>{a}</p><blockquote>{b}</blockquote><ul><li>{t}</li></ul></article>", f"{a} {b} {t}"),
            (f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{a}</p><p>{b}</p></article></body></html>", f"{t} {a} {b}"),
        ]
        for page, want in cases:
            assert html_extract.extract_text(page, model) == want


@pytest.mark.parametrize("dot", [".", ""])
def test_parts_inside_an_article_go(model, dot):
    for seed in range(20):
        a, b, other, t = say(seed, 50) + dot, say(seed + 100, 30) + dot, say(seed + 300, 40) + dot, say(seed + 200, 6)
        parts = [
            f"<section id='user-comments'><h3>{t}</h3><p>{other}</p><p>{t}</p></section>", f"<div class='comments'><div class='comment'><b>{t}</b><p>{other}</p></div></div>",
            f"<div class='notice'><p>{other}</p></div>", f"<form><label>{t}</label><p>{other}</p><input></form>", f"<aside><p>{other}</p></aside>", f"<div class='ad'>{other}</div>", f"<nav><a href='/'>{t}</a></nav>",
        ]
        for part in parts:
            assert html_extract.extract_text(f"<article><h1>{t}</h1><p>{a}</p>{part}<p>{b}</p></article>", model) == f"{t} {a} {b}"
            assert html_extract.extract_text(f"<body><header><h2>{t}</h2></header><main><p>{a}</p><p>{b}</p>{part}</main><footer>{other}</footer>", model) == f"{a} {b}"


def test_pages_without_an_article_are_empty(model):
    for page in ("<nav><ul><li><a href='/'>home</a></li></ul></nav>", "<nav>only</nav><footer>&copy; 2020 example</footer>", "<html><head><title>t</title></head><body></body></html>"):
        assert html_extract.extract_text(page, model) == ""


HOSTILE = {
    "nested": lambda k: "<div>" * k + "x", "open tags": lambda k: '<a "' * k, "unmatched": lambda k: "<b>" * k + "</i></div>" * k, "crossed": lambda k: "<i>" * k + "<b>" * k + "</i>" * k,
    "items": lambda k: "<div>" * k + "<li></li>" * k, "classes": lambda k: "".join(f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}'>" for i in range(k)) + "x",
    "quotes": lambda k: '<a x="' * k + '>"', "angles": lambda k: "<" * k, "comments": lambda k: "<!--" * k, "scripts": lambda k: "<script>" * k, "spaces": lambda k: "<a " + "= " * k + ">",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_in_proportion_to_the_page(name, model):
    took = []
    for k in (25_000, 100_000):
        began = time.process_time()
        html_extract.extract_text(HOSTILE[name](k), model)
        took.append(time.process_time() - began)
    assert took[1] < 1 + 8 * took[0] and took[1] < 4


def test_tags_and_heads():
    text = lambda page: [b.text for b in blocks(page)]
    assert text('<p title="a > b">x</p>') == ["x"] and text("<p title='never ends>x</p><p>y") == ["x", "y"]
    assert text("<head><title>t</title><meta a=b><p>x") == ["x"] and text("<head>x</head><p>y") == ["x", "y"]
    assert text("1 < 2 <3 </ 4") == ["1 < 2 <3 </ 4"]
    assert [b.linked for b in blocks("<p><a>ab</a> c<p>d<a>e<p>f</a>g")] == [2, 1, 0]
    shared: dict = {}
    assert blocks("<div><p>a", shared)[0].place is blocks("<div><p>b", shared)[0].place


def test_odd_rows(spark, model):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, None, "<p>" * 5000 + "deep", "x"), (3, "u", "<nav>only</nav>", "x"), (3, "u", "<nav>only</nav>", "x")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_pages(t, model).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(t.limit(0), model).count() == 0
