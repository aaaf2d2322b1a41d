"""Leaf blocks of a page: runs of text between block boundaries, with their ancestors.

A forgiving reader of markup. Unknown and unclosed tags are fine; a new block
closes an open paragraph, and a list item, row or cell the one before it.
Scripts, styles, templates, titles and comments aren't text; text that stands
in an open head begins the body, as in browsers.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

from readloom import ship

ship(__name__)

#: Elements of the markup standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style template noscript title textarea iframe svg math object canvas noframes xmp".split())
CLOSES_LIKE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PIECE = re.compile(r"[a-z]+")


#: Elements that an open head may hold; anything else begins the body.
IN_HEAD = frozenset("head html title meta link base script style noscript template".split())
ZONES = frozenset("article main header footer nav aside form section".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
IN_TAG = re.compile(r">|=\s*([\"'])")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in HIDDEN}


class Place:
    """Where a block stands: the features that its own element adds to those of the place around it."""

    __slots__ = ("around", "leaf", "main", "own", "score", "zone")

    def __init__(self, around: Place | None, own: tuple[str, ...]) -> None:
        self.around, self.own, self.score = around, own, None
        tags = [f for f in own if f[:2] == "a:"]
        self.leaf = tags[-1] if tags else around.leaf if around else ""
        zones = [f for f in tags if f[2:] in ZONES]
        self.zone = zones[-1] if zones else around.zone if around else ""
        self.main = (around is not None and around.main) or "a:article" in own or "a:main" in own

    @property
    def path(self) -> tuple[str, ...]:
        """Ancestors' features, root first, each once."""
        parts, at = [], self
        while at is not None:
            parts.append(at.own)
            at = at.around
        return tuple(f for own in reversed(parts) for f in own)


@dataclass
class Block:
    place: Place
    text: str
    linked: int  # code points inside links

    @property
    def path(self) -> tuple[str, ...]:
        return self.place.path


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    out = [f"a:{tag}"]
    if attrs:
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
                out.append("hidden")
            elif name != "style":
                out += [f"c:{p}" for p in PIECE.findall(value)]
    return tuple(dict.fromkeys(out))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of each tag and text, in one pass over the page.

    Kinds are open, close and text. A quoted value that never ends doesn't hide
    what follows, and a `<` that begins no tag is text.
    """
    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            yield "text", page[at:stop], ""
            at = stop
            continue
        if page.startswith(("<!--", "<![CDATA["), at):
            mark = "-->" if page[at + 2] == "-" else "]]>"
            stop = page.find(mark, at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), at):
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        closing = page.startswith("</", at)
        name = NAME.match(page, at + 1 + closing) if at < last else None
        if name is None:
            yield "text", "<", ""
            at += 1
            continue
        stop = p = name.end()
        if closing:
            stop = page.find(">", p)
        else:
            while found := IN_TAG.search(page, p):
                stop = found.end() - 1
                p = page.find(found[1], stop + 1) + 1 if found[1] else 0
                if not p:
                    break
            if not found or found[1]:  # a value has no end
                stop = page.find(">", name.end())
        if stop < 0:
            yield "text", "<", ""
            at += 1
            continue
        tag, at = name[0].lower(), stop + 1
        yield ("close" if closing else "open"), tag, page[name.end():stop]
        if not closing and tag in HIDDEN and page[stop - 1] != "/":
            found = ENDS[tag].search(page, at)
            at = found.end() if found else end


def blocks(page: str | None, places: dict | None = None) -> list[Block]:
    """The page's blocks. `places` may be shared by pages, so that equal places are one object.

    The time is in proportion to the page: each element is put on the stack and
    taken off once, and no step walks the stack.
    """
    places = {} if places is None else places
    root = places.get((None, ()))
    if root is None:
        root = places[None, ()] = Place(None, ())
    stack: list[tuple[str, tuple[str, ...], int]] = []  # element, its new features, links open when it began
    heights: dict[str, list[int]] = {}  # by element, where it is on the stack
    live: set[str] = set()  # features of the stack
    around = [root]
    out: list[Block] = []
    words: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                out.append(Block(around[-1], text, linked))
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        while len(stack) > k:
            tag, own, in_link = stack.pop()
            heights[tag].pop()
            live.difference_update(own)
            around.pop()

    def height(*tags: str) -> int:
        return max((heights[t][-1] for t in tags if heights.get(t)), default=-1)

    def leave_head() -> None:
        if (k := height("head")) >= 0:
            flush()
            pop_to(k)

    for kind, tag, attrs in tokens(page or ""):
        if kind == "text":
            if not tag.strip():
                words.append(tag)
                continue
            leave_head()
            text = html.unescape(tag)
            words.append(text)
            if in_link:
                linked += len(text.strip())
        elif kind == "open":
            if tag not in IN_HEAD:
                leave_head()
            if tag in HIDDEN:
                continue
            if tag == "br":
                words.append(" ")
                continue
            if tag in INLINE:
                in_link += tag == "a"
                continue
            flush()
            if tag in CLOSES_LIKE:
                k = height("p", tag, *({"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",)}.get(tag, ())))
                if k > height(*CLOSES_LIKE[tag]):
                    pop_to(k)
            elif stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if tag not in VOID:
                own = tuple(f for f in _names(tag, attrs) if f not in live)
                live.update(own)
                heights.setdefault(tag, []).append(len(stack))
                stack.append((tag, own, in_link))
                here = around[-1]
                if own:
                    key = (here, own)
                    here = places.get(key)
                    if here is None:
                        here = places[key] = Place(*key)
                around.append(here)
        elif tag in INLINE:
            if tag == "a" and in_link > (stack[-1][2] if stack else 0):
                in_link -= 1
        else:
            flush()
            if (k := height(tag)) >= 0:
                pop_to(k)
    flush()
    return out
