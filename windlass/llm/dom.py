"""A small DOM: elements, their texts in page order, and features of each element."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

# As browsers read tags: quotes count only where an attribute's value begins; elsewhere they are plain characters.
_VALUE = r"(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))"
_NAMED = r"(=?[^\s/>=]*+)(?:\s*+=\s*+" + _VALUE + r"?)?"
_UNNAMED = re.sub(r"\((?=[\[=])", "(?:", _NAMED)
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?=[^>])" + _UNNAMED + r")*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?=[^\s/>])" + _NAMED)
_TOKEN = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An element of the key's kind ends open elements of these kinds, up to the nearest of the scopes.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = frozenset("html body table ul ol dl select article section div nav aside header footer main form".split())
_ENDS_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}


@dataclass
class Page:
    """Elements in page order: tag, parent, attribute tokens; and pieces of text with the element that holds each."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    markup: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    #: For each piece of text, how many blocks have begun or ended before it.
    edges: list[int] = field(default_factory=list)


def parse(html: str) -> Page:
    """Read a page; nothing in it is an error.

    Missing end tags close where the next element of the kind begins, a block closes an
    open paragraph, an end tag without its start is skipped, and whatever is open at the
    page's end ends there. The text of scripts, styles and the like is no text. A quote
    holds a ``>`` only in a quoted value; a stray one is part of a name or a value.
    """
    page, stack = Page(), [0]
    places: dict[str, list[int]] = {}  # where in the stack each kind's open elements are
    page.tags.append("#page")
    page.parents.append(-1)
    page.tokens.append(())
    page.markup.append(0)
    at = edge = 0

    def text(piece: str) -> None:
        if piece:
            page.texts.append(unescape(piece) if "&" in piece else piece)
            page.owners.append(stack[-1])
            page.edges.append(edge)

    def close(kinds: frozenset | set, scope: frozenset) -> None:
        k = max((places[t][-1] for t in kinds if places.get(t)), default=0)
        if not k or any(places[t][-1] > k for t in scope if places.get(t)):
            return
        for node in stack[k:]:
            places[page.tags[node]].pop()
        del stack[k:]

    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        edge += tag in BLOCK
        if m[1]:
            # A stray end tag of an inline element never closes a block.
            scope = frozenset() if tag in BLOCK else BLOCK
            close({tag}, scope)
            page.markup[stack[-1]] += at - m.start()
            continue
        if tag in BLOCK:
            close({"p"}, _SCOPE)
        if tag in _ENDS:
            for _ in _ENDS[tag]:
                close(_ENDS[tag], _SCOPE - _ENDS[tag])
        node = len(page.tags)
        names = {a.lower(): b or c or d or "" for a, b, c, d in reversed(_ATTRIBUTE.findall(m[3]))} if m[3] else {}
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.tokens.append(tuple(x for k in ("class", "id", "role", "itemprop") if k in names for x in _TOKEN.findall(names[k].lower())))
        page.markup.append(at - m.start())
        if tag in RAW and not m[0].endswith("/>"):
            end = _ENDS_OF[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag == "br":
            text("\n")
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    text(html[at:])
    return page


def main_text(page: Page, kept: np.ndarray) -> str:
    """The blocks of text whose element is kept, white space made one space, joined by newlines.

    A block ends where any element of kind BLOCK begins or ends.
    """
    blocks: dict[int, list[str]] = {}
    for piece, owner, edge in zip(page.texts, page.owners, page.edges, strict=True):
        if kept[owner]:
            blocks.setdefault(edge, []).append(piece)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x)


NUMBERS = ("depth", "siblings", "index", "place", "text", "own", "markup", "density", "links", "elements", "signs", "words", "alike", "share", "position")


def features(page: Page, vocabulary: dict[str, int]) -> np.ndarray:
    """A row for each element: NUMBERS, then which tags and attribute tokens it has, then which its ancestors have."""
    n, size = len(page.tags), len(vocabulary)
    parent = np.array(page.parents)
    own, links, signs, words = (np.zeros(n) for _ in range(4))
    for piece, owner in zip(page.texts, page.owners, strict=True):
        if piece.isspace():
            continue
        own[owner] += len(piece)
        words[owner] += piece.count(" ") + 1
        signs[owner] += piece.count(".") + piece.count(",")
    total, markup, count = own.copy(), np.array(page.markup, float), np.ones(n)
    depth = np.zeros(n)
    marks = np.zeros((n, 2 * size), np.float32)
    for k in range(n):
        if k:
            p = page.parents[k]
            depth[k] = depth[p] + 1
            marks[k, size:] = np.maximum(marks[p, size:], marks[p, :size])
        for t in (page.tags[k], *page.tokens[k]):
            if (i := vocabulary.get(t)) is not None:
                marks[k, i] = 1
        if page.tags[k] == "a":
            links[k] = 1
    linked = own * links
    for k in range(n - 1, 0, -1):
        p = page.parents[k]
        if links[k]:
            linked[k] = total[k]
        for x in (total, markup, count, linked, signs, words):
            x[p] += x[k]
    siblings = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    index, alike, seen, kinds = np.zeros(n), np.zeros(n), np.zeros(n), {}
    for k in range(1, n):
        p = page.parents[k]
        index[k] = seen[p]
        seen[p] += 1
        kinds[p, page.tags[k]] = kinds.get((p, page.tags[k]), 0) + 1
    for k in range(1, n):
        alike[k] = kinds[page.parents[k], page.tags[k]]
    brothers = np.where(parent >= 0, siblings[parent], 1)
    numbers = [
        depth, brothers, index, index / np.maximum(brothers, 1), np.log1p(total), np.log1p(own), np.log1p(markup), total / (total + markup + 1), linked / (total + 1), np.log1p(count), signs / (total + 1), words / (total + 1),
        alike / np.maximum(brothers, 1), total / (np.where(parent >= 0, total[parent], total) + 1), np.arange(n) / n,
    ]
    return np.concatenate((np.stack(numbers, 1).astype(np.float32), marks), 1)
