"""HTML extraction: a linear-chain CRF over the leaf blocks of a page.

Each block is main text or not. Its features are the tags and the class, id and
role words of its ancestors, and facts about its text; the chain adds a weight
for each pair of labels in a row. The model is trained on the driver from pages
that `labelled_pages` builds from a seed, whose blocks are labelled because the
builder knows what it put where; decoding is Viterbi. The kept blocks are joined
in page order by one space.

Scoring reads a page at a time in one pass, without a shuffle. A null, empty or
textless page gives an empty text. Repeated rows are extracted each for itself,
null ids pass through, and further columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm.common import Sent
from readloom.llm.html_blocks import Block, Place, blocks

ship(__name__)

MAIN = "@@"  # marks main text in a labelled page


def text_features(b: Block, before: Block | None, after: Block | None) -> list[str]:
    n = b.text.count(" ") + 1
    dense = b.linked / len(b.text)
    size = min(7, n.bit_length())
    ends = b.text[-1] in ".!?…:\"”»)"
    marks = sum(b.text.count(c) for c in ".,;")
    return [
        "bias", f"size:{size}", f"link:{0 if dense < 0.05 else 1 if dense < 0.5 else 2}", f"ends:{ends}", f"size-ends:{min(size, 4)}:{ends}",
        f"marks:{min(3, marks)}", f"copy:{b.text[0] == '©' or '©' in b.text[:20]}", f"same:{before is not None and before.place is b.place}",
        f"next:{after is not None and after.place is b.place}", f"first:{before is None}", f"last:{after is None}",
    ]


@dataclass
class Crf:
    weight: dict[str, float]  # of each feature, for main against not
    step: np.ndarray  # by (label before, label)
    begin: np.ndarray

    def at(self, place: Place) -> float:
        """What the ancestors add, each place's sum kept with it."""
        get, todo = self.weight.get, []
        while place is not None and place.score is None:
            todo.append(place)
            place = place.around
        total = place.score if place is not None else 0.0
        for place in reversed(todo):
            total = place.score = total + sum(get(f, 0.0) for f in place.own)
        return total

    def labels(self, page: list[Block]) -> list[bool]:
        """Viterbi over the blocks of one page; their places keep the sums, so they serve one model."""
        if not page:
            return []
        get = self.weight.get
        a, b = float(self.begin[0]), None
        back: list[tuple[int, int]] = []
        (s00, s01), (s10, s11) = self.step.tolist()
        for i, block in enumerate(page):
            e = self.at(block.place) + sum(get(f, 0.0) for f in place_features(block.place))
            e += sum(get(f, 0.0) for f in text_features(block, page[i - 1] if i else None, page[i + 1] if i + 1 < len(page) else None))
            if b is None:
                b = float(self.begin[1]) + e
                continue
            back.append((int(b + s10 > a + s00), int(b + s11 >= a + s01)))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + e
        out = [int(b >= a)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return [bool(x) for x in reversed(out)]


def place_features(place: Place) -> tuple[str, ...]:
    return f"leaf:{place.leaf}", f"main:{place.main}", f"zone:{place.zone}:{place.main}"


def train(pages: list[tuple[list[Block], list[bool]]], *, rounds: int = 220, ridge: float = 0.5, rate: float = 0.15) -> Crf:
    """Maximise the conditional likelihood (Adam on exact gradients from forward and backward sums)."""
    names: dict[str, int] = {}
    flat, starts, y, at, first = [], [], [], [], []
    for page, labels in pages:
        for i, (b, label) in enumerate(zip(page, labels, strict=True)):
            fs = [*b.path, *place_features(b.place), *text_features(b, page[i - 1] if i else None, page[i + 1] if i + 1 < len(page) else None)]
            starts.append(len(flat))
            flat += [names.setdefault(f, len(names)) for f in fs]
            y.append(label)
            at.append(len(first))
        first.append(len(y) - len(page))
    flat, starts, y, first = np.array(flat), np.array(starts), np.array(y, int), np.array(first)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
    length = np.diff(np.append(first, len(y)))
    longest, n = int(length.max()), len(first)
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pos = first[:, None] + np.minimum(np.arange(longest), length[:, None] - 1)
    live = np.arange(longest) < length[:, None]
    truth = y[pos]
    add = np.logaddexp
    for t in range(1, rounds + 1):
        w, step, begin = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        emit = np.add.reduceat(w[flat], starts)
        e = np.stack([np.zeros((n, longest)), emit[pos]], 2)
        f = np.zeros((n, longest, 2))
        g = np.zeros((n, longest, 2))
        f[:, 0] = begin + e[:, 0]
        for i in range(1, longest):
            s = f[:, i - 1, :, None] + step
            f[:, i] = np.where(live[:, i, None], add(s[:, 0], s[:, 1]) + e[:, i], f[:, i - 1])
        z = add(f[:, -1, 0], f[:, -1, 1])
        for i in range(longest - 2, -1, -1):
            s = step + (e[:, i + 1] + g[:, i + 1])[:, None, :]
            g[:, i] = np.where(live[:, i + 1, None], add(s[..., 0], s[..., 1]), 0.0)
        p = np.exp(f + g - z[:, None, None])
        diff = np.where(live, p[:, :, 1] - truth, 0.0)
        by_block = np.zeros(len(y))
        by_block[pos[live]] = diff[live]
        grad = np.zeros_like(theta)
        grad[:-6] = np.bincount(flat, by_block[owner], len(names))
        both = np.exp(f[:, :-1, :, None] + step + (e[:, 1:] + g[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        grad[-6:-2] = both.sum((0, 1)).reshape(-1)
        pair = (truth[:, :-1] * 2 + truth[:, 1:])[live[:, 1:]]
        grad[-6:-2] -= np.bincount(pair, minlength=4)
        grad[-2:] = p[:, 0].sum(0) - np.bincount(truth[:, 0], minlength=2)
        grad = grad / n + ridge * theta / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf({f: float(theta[i]) for f, i in names.items()}, theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy())


# What the builder of labelled pages chooses from: (opening tag, tag) of parts that aren't main text.
PARTS: dict[str, list[str]] = {
    "menu": ["<nav>", '<nav class="main-nav">', '<div class="menu">', '<ul class="navbar">', '<div id="navigation">', '<div class="breadcrumb">', '<div role="navigation">', '<div class="topbar">'],
    "header": ["<header>", '<div id="header">', '<div class="site-header">', '<div class="masthead">', '<header class="page-header">', '<div class="logo">', '<div role="banner">'],
    "footer": ["<footer>", '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div role="contentinfo">', '<div class="bottom legal">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="secondary">', '<aside class="widget">', '<div class="related">', '<div class="recommended">', '<div class="popular posts">', '<section class="more stories">', '<div role="complementary">', '<div class="tags">'],
    "notice": ['<div class="notice">', '<div class="cookie-notice">', '<div id="cookie-consent">', '<div class="gdpr banner">', '<div class="alert">', '<div role="alert">', '<div class="warning message">', '<div role="dialog">', '<div class="modal popup">', '<div class="paywall">', '<div class="disclaimer">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="advertisement">', '<div class="sponsored">', '<div class="promo">', '<aside class="ad">', '<div class="banner">', '<section class="promotion">', '<div class="sponsor">'],
    "form": ["<form>", '<form class="newsletter">', '<div class="subscribe">', '<form id="search">', '<div class="signup form">', '<form class="login">', '<div class="newsletter">', '<fieldset>'],
    "comment": ['<section class="comments">', '<section id="user-comments">', '<div class="user comment">', '<div id="comments">', '<div class="comment">', '<ol class="comment-list">', '<div id="disqus_thread">', '<div class="replies">', '<article class="comment">', '<section id="respond">', '<div class="discussion">', '<div class="reviews">'],
    "share": ['<div class="share">', '<ul class="social">', '<div class="social-links">', '<div class="byline meta">', '<div class="pagination">', '<div class="author-bio">'],
}
BODIES = ["<article>", "<article>", "<article>", "<main>", "<main>", '<main id="main">', "<main><article>", '<div class="content">', '<div id="content">', '<div class="post-content">', '<div class="entry">', '<div class="article-body">', '<section class="story">', '<div itemprop="articleBody">', '<article class="post">', '<div role="main">', "<div>"]


INSIDE = ["ad", "ad", "form", "notice", "side", "share", "comment", "comment", "menu"]  # parts that stand between the blocks of an article


def _closing(opened: str) -> str:
    return "".join(f"</{x.split('>')[0].split(' ')[0]}>" for x in reversed(opened.split("<")[1:]))


def word_pool(rng: np.random.Generator, n: int = 3000) -> list[str]:
    letters = "abcdefghijklmnoprstuvwyzäéñß"
    return ["".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(1, 10)))) for _ in range(n)]


def labelled_page(rng: np.random.Generator, pool: list[str]) -> str:
    """A page whose main text blocks begin with MAIN."""
    word = lambda: pool[int(rng.integers(0, len(pool)))]

    dotted = rng.random() < 0.6  # so that marks and lengths alone tell little

    def prose(low: int, high: int) -> str:
        w = [pool[i] for i in rng.integers(0, len(pool), int(rng.integers(low, high)))]
        for i in range(0, len(w) if dotted else 1, 9):
            w[i] = w[i].capitalize()
            if dotted:
                w[i - 1 if i else -1] += "." if rng.random() < 0.9 else ","
        return " ".join(w)

    def part(kind: str) -> str:
        open_ = PARTS[kind][int(rng.integers(0, len(PARTS[kind])))]
        if rng.random() < 0.3:  # it reads like an article
            return open_ + "".join(f"<p>{prose(5, 90)}</p>" for _ in range(int(rng.integers(1, 3)))) + _closing(open_)
        link = lambda: f'<a href="/x">{prose(1, 4)}</a>'
        if kind in ("menu", "share"):
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(1, 7)))) + "</ul>" if rng.random() < 0.8 else " ".join(link() for _ in range(3))
        elif kind == "footer":
            inner = f"&copy; {word()}.example.com &middot; {prose(3, 20)}" if rng.random() < 0.7 else f"<p>&copy; 2020 {word()}</p>{link()}"
        elif kind == "form":
            inner = f"<label>{prose(1, 4)}</label><input><button>{word()}</button>" + (f"<p>{prose(3, 20)}</p>" if rng.random() < 0.5 else "")
        elif kind == "comment":
            inner = "".join(f"<div><b>{word()}</b><p>{prose(3, 60)}</p></div>" for _ in range(int(rng.integers(1, 5))))
            inner = f"<h3>{prose(1, 3)}</h3>{inner}" if rng.random() < 0.5 else inner
        elif kind == "header":
            inner = f"<h2>{prose(1, 5)}</h2><p>{prose(1, 12)}</p>" if rng.random() < 0.5 else prose(1, 8)
        elif kind == "side":
            inner = f"<h3>{prose(1, 4)}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>" if rng.random() < 0.5 else f"<p>{prose(4, 50)}</p>"
        else:
            inner = prose(3, 30) if rng.random() < 0.6 else f"<p>{prose(3, 40)}</p>"
        return open_ + inner + _closing(open_)

    body = BODIES[int(rng.integers(0, len(BODIES)))]
    heading = f"<h1>{MAIN}{prose(2, 12)}</h1>"
    items = [f"<header>{heading}</header>" if rng.random() < 0.25 and ("<article" in body or "<main" in body) else heading] if rng.random() < 0.9 else []
    if rng.random() < 0.4:
        items.append(f"<p><b>{MAIN}{prose(1, 30)}<br>" + "<p>" * (rng.random() < 0.5))
    for _ in range(int(rng.integers(0, 3) if rng.random() < 0.25 else rng.integers(1, 14))):
        r = rng.random()
        if r < 0.62:
            items.append(f"<p>{MAIN}{prose(1 if rng.random() < 0.2 else 8, 90)}" + ("</p>" if rng.random() < 0.9 else ""))
        elif r < 0.68:
            items.append(f"<h2>{MAIN}{prose(1, 7)}</h2>")
        elif r < 0.72:
            items.append("<ul>" + "".join(f"<li>{MAIN}{prose(1, 25)}</li>" for _ in range(3)) + "</ul>")
        elif r < 0.75:
            items.append(f"<blockquote>{MAIN}{prose(5, 30)}</blockquote>")
        elif r < 0.77:
            items.append(f"<table><tr><td>{MAIN}{prose(1, 4)}<td>{MAIN}{prose(1, 4)}</table>")
        else:
            items.append(part(INSIDE[int(rng.integers(0, len(INSIDE)))]))
    for kind in ("share", "form", "side", "comment", "comment", "footer"):  # what often ends an article
        if rng.random() < 0.1:
            items.append(part(kind))
    kinds = lambda some: "".join(part(k) for k in some if rng.random() < 0.6)
    top = kinds(["notice", "header", "menu", "ad", "side", "form"])
    end = kinds(["share", "side", "ad", "form", "comment", "comment", "menu", "footer", "notice"])
    wrap, shape = rng.random() < 0.3, rng.random()
    if shape < 0.2:  # an article and nothing else, down to one block, or to text without markup
        top = end = ""
        if shape < 0.12:
            items = [f"<p>{MAIN}{prose(2, 90)}</p>" if shape < 0.08 else MAIN + prose(8, 90)]
            body = body if shape < 0.06 or shape > 0.1 else "<body>"
    elif shape < 0.28:
        top = ""
    elif shape < 0.36:
        end = ""
    elif shape < 0.39:  # no article
        items, body = [], "<div>"
    head = f"<html><head><title>{prose(1, 6)}</title></head><body>" if rng.random() < 0.8 else ""
    return f"{head}{'<div class=wrap>' * wrap}{top}{body}{''.join(items)}{_closing(body)}{end}{'</div>' * wrap}"


def labelled_pages(count: int = 1600, seed: int = 1) -> list[tuple[list[Block], list[bool]]]:
    rng = np.random.default_rng(seed)
    out, pool = [], word_pool(rng)
    for _ in range(count):
        page = blocks(labelled_page(rng, pool))
        if page:
            labels = [MAIN in b.text for b in page]
            out.append(([Block(b.place, b.text.replace(MAIN, "") or "x", b.linked) for b in page], labels))
    return out


@functools.cache
def default_model() -> Crf:
    """The model of the builder's pages, trained once a driver process."""
    return train(labelled_pages())


def extract_text(page: str | None, model: Crf, places: dict | None = None) -> str:
    found = blocks(page, places)
    return " ".join(b.text for b, main in zip(found, model.labels(found), strict=True) if main)


def extract_pages(df: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text and n_chars."""
    sent = Sent(df.sparkSession, model or default_model())
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places: dict = {}  # pages of one batch share places; a batch bounds what is kept
            texts = [extract_text(x, sent.value, places) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
