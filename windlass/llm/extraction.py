"""Main text of web pages by boosted trees over DOM elements and hierarchical decoding."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .bytesops import batches
from .dom import Page, features, main_text, parse
from .sampling import hash_sample

#: Pages, and characters of all of them, that fit the classifier (whole pages chosen by hash; not a limit on what is extracted).
SAMPLE, SAMPLE_CHARS = 160, 3_200_000
#: Tags and attribute tokens that are features.
VOCABULARY = 160
#: What the teacher goes by: an element of these tags or with these attribute tokens is no main text.
_ASIDE_TAGS = "nav header footer aside form script style noscript iframe template button select menu dialog head title textarea svg object".split()
_ASIDE_TOKENS = (
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie consent notice alert popup modal overlay newsletter subscribe signup login search form "
    "comment comments reply replies disqus share sharing social related recommended tags pagination pager copyright legal skip toolbar"
).split()
_MAIN_TAGS, _MAIN_TOKENS = ["article", "main"], "article content main post entry story body text".split()


def teacher(page: Page) -> np.ndarray:
    """Weak labels of the elements: 1 main text, 0 not, -1 unknown (no text, or neither marked)."""
    n = len(page.tags)
    label, holds = np.full(n, -1), np.zeros(n, bool)
    marked = any(t in _MAIN_TAGS for t in page.tags) or any(x in _MAIN_TOKENS for t in page.tokens for x in t)
    inside = np.zeros(n, bool)
    aside = np.zeros(n, bool)
    for k in range(n):
        p = page.parents[k]
        bad = page.tags[k] in _ASIDE_TAGS or any(x in _ASIDE_TOKENS for x in page.tokens[k])
        main = page.tags[k] in _MAIN_TAGS or any(x in _MAIN_TOKENS for x in page.tokens[k])
        aside[k] = bad or (p >= 0 and aside[p])
        inside[k] = (main or (p >= 0 and inside[p])) and not aside[k]
    for piece, owner in zip(page.texts, page.owners, strict=True):
        holds[owner] |= not piece.isspace()
    for k in range(n - 1, 0, -1):
        holds[page.parents[k]] |= holds[k]
    label[aside] = 0
    label[inside & holds] = 1
    if marked:
        label[(label < 0) & holds] = 0
        for k in range(n - 1, 0, -1):  # what holds main text is kept on the way to it
            if label[k] == 1:
                label[page.parents[k]] = 1 if not aside[page.parents[k]] else 0
    return label


def _variant(html: str, pieces: list[str], rng: random.Random) -> str:
    """The page with its article in another wrapping and with further parts that are no main text."""
    piece = lambda: " ".join(rng.choice(pieces).split()[: rng.randrange(3, 40)])
    kinds = [
        lambda: f'<div class="{rng.choice(_ASIDE_TOKENS)}">{piece()}</div>',
        lambda: f'<div id="{rng.choice(_ASIDE_TOKENS)}-{rng.choice(_ASIDE_TOKENS)}"><p>{piece()}</p><p>{piece()}</p></div>',
        lambda: f"<aside><h3>{piece()}</h3><p>{piece()}</p></aside>",
        lambda: f"<header><h2>{piece()}</h2></header>",
        lambda: f"<form><label>{piece()}</label><input><button>{piece()}</button></form>",
        lambda: f'<section class="comments"><div class="comment"><p>{piece()}</p></div><div class="comment"><p>{piece()}</p></div></section>',
        lambda: f'<footer><p>{piece()}</p></footer>',
        lambda: "<ul class='menu'>" + "".join(f"<li><a href='#'>{piece()}</a></li>" for _ in range(4)) + "</ul>",
    ]
    extra = lambda: "".join(rng.choice(kinds)() for _ in range(rng.randrange(3)))
    open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post">', "</div></div>"), ('<article class="post entry">', "</article>")])
    html = html.replace("<article>", extra() + open_, 1)
    end = html.rfind("</article>")
    if end >= 0:
        html = html[:end] + (extra() if rng.random() < 0.5 else "") + close + extra() + html[end + 10 :]
    return html


@dataclass
class Extractor:
    vocabulary: dict[str, int]
    model: Boosted

    def kept(self, pages: list[Page]) -> list[np.ndarray]:
        """The choice of most probability among those in which whatever a dropped element holds is dropped too."""
        x = [features(p, self.vocabulary) for p in pages]
        odds = self.model(np.concatenate(x))
        log_keep, log_drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        out, at = [], 0
        for p in pages:
            n = len(p.tags)
            keep, drop = log_keep[at : at + n].copy(), log_drop[at : at + n].copy()
            at += n
            for k in range(n - 1, 0, -1):  # drop: the sum over all inside; keep: the better choice for each child
                keep[p.parents[k]] += max(keep[k], drop[k])
                drop[p.parents[k]] += drop[k]
            kept = np.ones(n, bool)
            for k in range(1, n):
                kept[k] = kept[p.parents[k]] and keep[k] >= drop[k]
            out.append(kept)
        return out


def fit_extractor(pages: list[str], *, variants: int = 2, seed: int = 5) -> Extractor:
    """Fit on pages labelled by the teacher, and on variants of them."""
    rng = random.Random(seed)
    pages = [h for h in pages if h] or ["<html><body><article><p>text</p></article><nav>menu</nav></body></html>"]
    pieces = [t for h in pages for t in parse(h).texts if len(t) > 20] or ["some text of a page"]
    parsed = [parse(h) for h in pages + [_variant(h, pieces, rng) for h in pages for _ in range(variants)]]
    seen = Counter(x for p in parsed for k, t in enumerate(p.tags) for x in {t, *p.tokens[k]})
    vocabulary = {x: i for i, (x, _) in enumerate(sorted(seen.items(), key=lambda v: (-v[1], v[0]))[:VOCABULARY])}
    labels = [teacher(p) for p in parsed]
    x, y = np.concatenate([features(p, vocabulary) for p in parsed]), np.concatenate(labels)
    return Extractor(vocabulary, fit(x[y >= 0], (y[y >= 0] == 1).astype(float)))


def _extract(shared) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = shared.value
        for b in batches(it, 128):
            pages = [parse(h or "") for h in b["html"].to_pylist()]
            out = [main_text(p, kept) for p, kept in zip(pages, extractor.kept(pages), strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def sample_pages(pages: DataFrame, sample: int, chars: int) -> list[str]:
    """Distinct whole pages in order of hash, without those that would take the sample beyond so many characters."""
    html = pages.where("html IS NOT NULL").select("html", F.xxhash64("html").alias("key"))
    sizes, some = hash_sample(html.select("key", F.length("html").alias("n")).distinct(), F.col("key"), sample).collect(), []
    for r in sizes:
        if r.n <= chars:
            some.append(r.key)
            chars -= r.n
    found = {r.key: r.html for r in html.where(F.col("key").isin(some)).dropDuplicates(["key"]).collect()}
    return [found[k] for k in dict.fromkeys(some)]


def extract_text(pages: DataFrame, *, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; n_chars counts code points.

    A bounded sample of whole pages (by hash of the html: ``sample`` pages that together
    have ``sample_chars`` characters at most) fits the trees at each run; a teacher
    labels its elements by tag and attribute, and variants of the pages add wrappings and
    parts that the sample may lack. Each page is then parsed whole, its elements are scored
    by subtree density, links, attribute tokens, depth, siblings and ancestors, and the
    most probable choice in which no element is kept inside a dropped one is decoded.

    Null and empty html give the empty text. Broken markup is read as browsers do, as far
    as main text goes: see dom.parse. Repeated pages each have their row; a null page_id
    or url stays null; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    shared = spark.sparkContext.broadcast(fit_extractor(sample_pages(rows, sample, sample_chars)))
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")
