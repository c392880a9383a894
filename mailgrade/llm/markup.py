"""Blocks of an HTML page, and what its markup says about each: article, chrome, or open."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

CHROME, OPEN, ARTICLE = 0, 1, 2

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORD = re.compile(r"[a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp noframes svg math canvas object audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold article text.
_CHROME_TAGS = frozenset("nav footer aside form button select label dialog menu head datalist fieldset".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id that mark chrome. Fixed values.
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notification alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation"
    " breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations trending popular pagination pager"
    " toolbar skip paywall disclaimer copyright login".split()
)
_COMMENT_WORDS = frozenset("comment comments disqus respond reply replies discussion commentlist usercomments".split())
#: Words that only name a box or its place. Fixed values.
_BOX_WORDS = frozenset(
    "area articles bar block bottom box btn button buttons center container content form header icons inline inner item items left line link"
    " links list main message module nav outer page panel post posts primary right row secondary section site slot small stories top unit view"
    " wrap wrapper zone".split()
)
_BODY_WORDS = (frozenset(("article", "body")), frozenset(("article", "content")), frozenset(("post", "content")), frozenset(("entry", "content")),
               frozenset(("articlebody",)), frozenset(("post", "body")), frozenset(("story", "body")))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    role: int
    region: int  # which article element, from 1; 0 outside
    linked: int  # characters inside links


def _facts(attributes: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of each tag; name empty for comments and declarations.

    One walk from left to right: a tag ends at the first ``>`` outside quotes, or at the first
    one at all if a quote is left open. Where no ``>`` is left, what begins like a tag goes on to
    the end of the page.
    """
    at, size = page.find("<"), len(page)
    unquoted = {'"': False, "'": False}  # no such quote is left
    while 0 <= at < size:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, False, "", ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            end = size if end < 0 else end + 1
            yield at, end, False, "", ""
        elif (name := _NAME.match(page, at + 1)) is not None:
            place = name.end()
            while True:
                stop = _STOP.search(page, place)
                if stop is None:
                    end = size
                    break
                if stop[0] == ">":
                    end = stop.end()
                    break
                closing = -1 if unquoted[stop[0]] else page.find(stop[0], stop.end())
                if closing < 0:
                    unquoted[stop[0]] = True
                    place = stop.end()
                else:
                    place = closing + 1
            if page[end - 1] != ">":
                yield at, size, False, "", ""  # a tag that never ends is no text
            else:
                yield at, end, bool(name[1]), name[2].lower(), page[name.end() : end - 1]
        else:
            end = at + 1
        at = page.find("<", end)


class _Stack:
    """Open elements, with what they make of their text counted as they come and go."""

    def __init__(self):
        self.open: list[tuple[str, int, int]] = []  # element, what it makes of its text (-1: chrome, -2: comments, 0: nothing, 1: article), region
        self.named: Counter[str] = Counter()
        self.chrome = 0
        self.layout: list[int] = []  # places of the chrome elements that an article may lift
        self.articles: list[int] = []

    @staticmethod
    def _lifted(element: str, kind: int) -> bool:
        return kind == -1 and element not in ("aside", "footer")

    def push(self, element: str, kind: int, region: int) -> None:
        self.open.append((element, kind, region))
        self.named[element] += 1
        self.chrome += kind < 0
        if self._lifted(element, kind):
            self.layout.append(len(self.open) - 1)
        if kind == 1:
            self.articles.append(region)

    def pop(self) -> tuple[str, int, int]:
        element, kind, region = self.open.pop()
        self.named[element] -= 1
        self.chrome -= kind < 0
        if self._lifted(element, kind):
            self.layout.pop()
        if kind == 1:
            self.articles.pop()
        return element, kind, region

    def lift(self) -> None:
        """A declared article is no part of a layout region that was left open."""
        for k in self.layout:
            self.open[k] = (self.open[k][0], 0, self.open[k][2])
        self.chrome -= len(self.layout)
        self.layout.clear()

    def state(self) -> tuple[int, int]:
        if self.chrome:
            return CHROME, 0
        return (ARTICLE, self.articles[-1]) if self.articles else (OPEN, 0)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, white space collapsed, character references decoded."""
    out: list[Block] = []
    stack = _Stack()
    words: list[str] = []
    linked = regions = links = at = 0
    now = stack.state()

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            out.append(Block(text, *now, linked))
        words.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        words.append(text)
        if links:
            linked += len(text.strip())

    lower = None
    for begin, end, closes, name, attributes in tags(page):
        if begin < at:
            continue  # inside a script or the like
        if begin > at:
            say(page[at:begin])
        at = end
        if not name:
            continue
        if not closes:
            if name in _RAW:
                lower = page.lower() if lower is None and len(page.lower()) == len(page) else lower
                at = _raw_end(page if lower is None else lower, name, at)
                continue
            if name in _BLOCK:
                close()
                if name != "br":
                    _end_open_paragraph(stack, name)
                    now = stack.state()
            if name in _VOID:
                continue
            kind = _kind(name, _facts(attributes), now[0])
            if kind == 1:
                stack.lift()
                if not stack.articles:
                    regions += 1
            if kind and name not in _BLOCK:
                close()
            stack.push(name, kind, regions if kind == 1 else 0)
            links += name == "a"
            if kind:
                now = stack.state()
        else:
            if name in _BLOCK:
                close()
            closed = False
            while stack.named[name] and not closed:
                element, kind, _ = stack.open[-1]
                if kind:
                    close()
                stack.pop()
                links -= element == "a" and links > 0
                closed = element == name
            if closed:
                now = stack.state()
    if at < len(page):
        say(page[at:])
    close()
    return out


def _raw_end(page: str, name: str, at: int) -> int:
    """Behind the tag that closes a script or the like; the page's end if there is none."""
    while (found := page.find(f"</{name}", at)) >= 0:
        end = page.find(">", found)
        if end < 0:
            break
        if not page[found + 2 + len(name) : end].strip():
            return end + 1
        at = found + 2
    return len(page)


def _end_open_paragraph(stack: _Stack, name: str) -> None:
    """A block ends a paragraph left open, and an item the item before it."""
    ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(name, ())
    for k in range(len(stack.open) - 1, -1, -1):
        element = stack.open[k][0]
        if element == "p" or element in ends:
            while len(stack.open) > k:
                stack.pop()
            return
        if element in _BLOCK:
            return


def _made_of(token: str, words: frozenset[str]) -> bool:
    """Whether a class or id consists of such words, at most beside names of a box: ``related-posts``, not ``related-work``."""
    parts = _WORD.findall(token)
    return any(p in words for p in parts) and all(p in words or p in _BOX_WORDS or p.isdigit() for p in parts)


def _kind(name: str, facts: dict[str, str], role: int) -> int:
    if name in ("html", "body"):
        return 0
    # Ids inside an article name its sections; elsewhere they name the page's parts.
    tokens = [*facts.get("class", "").lower().split(), *(facts.get("id", "").lower().split() if role != ARTICLE else ())]
    seen = set(_WORD.findall(" ".join(tokens)))
    if any(t in _COMMENT_WORDS or _made_of(t, _COMMENT_WORDS) for t in tokens) and not (seen & {"content"} and name in ("article", "main")):
        return -2
    if "hidden" in facts or facts.get("aria-hidden") == "true" or _HIDDEN.search(facts.get("style", "").lower()):
        return -2
    if name in _CHROME_TAGS:
        return -1
    if facts.get("role", "").lower() in _CHROME_ROLES and not (name == "header" and role == ARTICLE):
        return -1
    declared = name in ("article", "main") or facts.get("role", "").lower() in ("main", "article") or "articlebody" in facts.get("itemprop", "").lower()
    if declared:
        return -1 if seen & _CHROME_WORDS & {"related", "recommended", "promo", "sponsored", "ad", "advert", "trending", "popular"} else 1
    if name == "header":
        return 0 if role == ARTICLE else -1
    if any(_made_of(t, _CHROME_WORDS) for t in tokens):
        return -1
    if name in ("div", "section", "td") and role == OPEN and any(w <= seen for w in _BODY_WORDS):
        return 1
    return 0


def declared_article(found: list[Block]) -> list[Block] | None:
    """The blocks of the elements that the page declares as its articles; None without one.

    A page may hold several posts. One that is mostly links, beside one that is not, is a list
    of other pages.
    """
    sizes: dict[int, list[int]] = {}
    for b in found:
        if b.role == ARTICLE:
            size = sizes.setdefault(b.region, [0, 0])
            size[0] += len(b.text)
            size[1] += b.linked
    if not sizes:
        return None
    written = {r for r, (n, linked) in sizes.items() if linked < 0.5 * n}
    return [b for b in found if b.role == ARTICLE and b.region in (written or sizes)]
