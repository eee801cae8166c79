"""License scans: winnowed template fingerprints, then banded alignment."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import batches, packs, span_hashes, spans, texts, window_hashes
from .license_set import long_templates, short_templates

#: Words of a fingerprint, fingerprints of which one is kept, and words that an alignment may shift.
GRAM, WINNOW, BAND = 3, 4, 8
#: Templates of fewer words keep every fingerprint.
WHOLE = 40
#: Share of a template's words that must match.
COVERAGE = 0.8
#: Templates of fewer words are lines, of which all telling words must match; up to the second number they are notices, whose version must.
LINE, NOTICE = 20, 200
#: Words of a line that do not tell one license from another.
GENERIC = frozenset("this work program software library is are was licensed released distributed available made provided published under the a an of in at to and with for terms conditions license licence public general version v international unported generic".split())
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))
_WORD = np.zeros(256, np.uint8)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:0x100] = 1

# License notices and texts, as published.
TEMPLATES = short_templates() | {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
}


def word_hashes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case alphanumeric words, and each value's first word (with the number of words last)."""
    low = [v.translate(_LOWER) for v in values]
    buf = b"\n".join(low)
    start, end = spans(buf, _WORD)
    return span_hashes(buf, start, end), np.searchsorted(start, np.cumsum([0] + [len(v) + 1 for v in low]))


def winnow(h: np.ndarray) -> list[int]:
    """Positions of the least fingerprint of every WINNOW in a row, the rightmost of equals."""
    out = {lo + len(h[lo : lo + WINNOW]) - 1 - int(h[lo : lo + WINNOW][::-1].argmin()) for lo in range(max(1, len(h) - WINNOW + 1))} if len(h) else set()
    return sorted(out)


def _telling(template: str) -> list[str]:
    """A line's words that name its license; of longer notices the version's numbers, once each."""
    words = [w.decode("utf-8") for w in _words(template.encode())]
    if len(words) < LINE:
        return [w for w in words if w not in GENERIC]
    if len(words) < NOTICE:
        return sorted({n for m in re.findall(r"\bv(?:ersion|\.)\s+([\d.]+)", template.lower()) for n in m.split(".") if n})
    return []


def _words(value: bytes) -> list[bytes]:
    low = value.translate(_LOWER)
    return [low[a:b] for a, b in zip(*spans(low, _WORD), strict=True)]


class Index:
    """The templates' words, and an inverted index of their fingerprints: all of short templates, winnowed ones of others.

    A text's own fingerprints are all looked up, so a template that it holds whole is
    always a candidate. ``needed`` are the words without which a match would be another
    license: a line's words but for GENERIC ones, as often as they occur, and the numbers
    of a notice's version.
    """

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        h, first = word_hashes([templates[n].encode() for n in self.names])
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.needed = [Counter(word_hashes([x.encode()])[0][0].item() for x in _telling(templates[n])) for n in self.names]
        postings: dict[int, list[tuple[int, int]]] = {}
        for t, w in enumerate(self.words):
            grams = window_hashes(w, min(GRAM, len(w))) if len(w) else w
            for k in [] if len(w) < GRAM else range(len(grams)) if len(w) < WHOLE else winnow(grams):
                postings.setdefault(int(grams[k]), []).append((t, k))
        self.keys = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(k)] for k in self.keys]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """The best local alignment near a diagonal: matched words, and the span in the text.

    Match 2, mismatch and gap -1; only cells within ``band`` of the diagonal (text position
    less template position) are filled.
    """
    best, nothing = (0, 0, 0, 0), (0, 0, -1, -1)  # score, matched, first and last text position
    before = {}
    for i in range(len(template)):
        row = {}
        for j in range(max(0, i + diagonal - band), min(len(text), i + diagonal + band + 1)):
            up = before.get(j, nothing)
            side = row.get(j - 1, nothing)
            s, m, a, b = before.get(j - 1, nothing)
            if template[i] == text[j]:
                cell = (s + 2, m + 1, a if s > 0 else j, j)
            else:
                cell = (s - 1, m, a, b)
            cell = max(cell, (up[0] - 1, *up[1:]), (side[0] - 1, *side[1:]), key=lambda c: c[0])
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = cell
        before = row
    return best[1], best[2], best[3] + 1


def most(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> int:
    """How many of the template's words any alignment in the band can match at most."""
    hit = np.zeros(len(template), bool)
    for o in range(diagonal - band, diagonal + band + 1):
        lo, hi = max(0, -o), min(len(template), len(text) - o)
        if lo < hi:
            hit[lo:hi] |= template[lo:hi] == text[lo + o : hi + o]
    return int(hit.sum())


def occurrences(template: np.ndarray, text: np.ndarray, hits: list[tuple[int, int]], least: float) -> Iterator[tuple[int, int, int]]:
    """Matched words and span of each place where at least so many of a template's words match, given (position, place in the template) of its fingerprints.

    An occurrence takes the hits inside it; the text before it and the text after it are
    searched again with the hits that are left, so that one that follows another at once
    is found as well.
    """
    todo = [(0, len(text), sorted(hits))]
    while todo:
        begin, end, left = todo.pop()
        tried: set[int] = set()
        while left:
            d = left[0][0] - left[0][1]
            lo, hi = max(begin, d - BAND), min(end, d + len(template) + 2 * BAND)
            part = text[lo:hi]
            if d in tried or len(part) < least or most(template, part, d - lo) < least:
                left = left[1:]
                continue
            tried.add(d)
            m, a, b = align(template, part, d - lo)
            if m < least:
                left = left[1:]
                continue
            a, b = lo + a, lo + b
            yield m, a, b
            todo.append((b, end, [h for h in left[1:] if h[0] >= b]))
            end, left = a, [h for h in left[1:] if h[0] < a]
            tried.clear()


def best_fits(found: list[tuple[int, tuple[str, int, int, int, float]]]) -> list[tuple[str, int, int, int, float]]:
    """Of spans that share more than half of the shorter one, the best; compared only within pieces of 64 words."""
    found = sorted(found, key=lambda f: (-f[0], -f[1][4], f[1][1], f[1][0]))
    kept: list[tuple[str, int, int, int, float]] = []
    pieces: dict[int, list[tuple[str, int, int, int, float]]] = {}
    for _, f in found:
        here = range(f[1] >> 6, (f[2] - 1 >> 6) + 1)
        if not any(2 * (min(f[2], g[2]) - max(f[1], g[1])) > min(f[2] - f[1], g[2] - g[1]) for k in here for g in pieces.get(k, ())):
            kept.append(f)
            for k in here:
                pieces.setdefault(k, []).append(f)
    return sorted(kept, key=lambda f: (f[1], f[0]))


def matches(index: Index, text: np.ndarray, at: np.ndarray, keys: np.ndarray, coverage: float) -> list[tuple[str, int, int, int, float]]:
    """Templates found in a text's words, given the hits of its fingerprints: name, span, matched words, coverage.

    Of found spans that share more than half of the shorter one, the template stays that has
    most matched words less those missed, in the template and in the span.
    """
    hits: dict[int, list[tuple[int, int]]] = {}
    present = set(text.tolist())
    for p, k in zip(at.tolist(), keys.tolist(), strict=True):
        for t, q in index.postings[k]:
            if index.needed[t].keys() <= present:
                hits.setdefault(t, []).append((p, q))
    found = []
    for t, places in hits.items():
        template = index.words[t]
        for m, a, b in occurrences(template, text, places, coverage * len(template)):
            if index.needed[t] <= Counter(text[a:b].tolist()):
                found.append((3 * m - len(template) - (b - a), (index.names[t], a, b, m, m / len(template))))
    return best_fits(found)


def _scanner(shared, coverage: float) -> Callable:
    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches(it):
            values, ids, rows = texts(b["text"]), b["doc_id"].to_pylist(), []
            for i, j in packs(values):
                h, first = word_hashes(values[i:j])
                grams = window_hashes(h, GRAM)
                slot = np.minimum(np.searchsorted(index.keys, grams), max(0, len(index.keys) - 1))
                at = np.flatnonzero(index.keys[slot] == grams) if len(index.keys) else np.empty(0, np.int64)
                doc = np.searchsorted(first, at, "right") - 1
                at, doc = at[at + GRAM <= first[doc + 1]], doc[at + GRAM <= first[doc + 1]]
                for d in np.unique(doc):
                    hits = at[doc == d]
                    for f in matches(index, h[first[d] : first[d + 1]], hits - first[d], slot[hits], coverage):
                        rows.append((ids[i + d], *f))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "license", "first_word", "last_word", "matched", "coverage"])

    return scan


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, first_word, last_word, matched, coverage``: a row for each template found.

    Words are lower-case runs of letters and digits. Each text's fingerprints of GRAM words
    are looked up in the templates' index; each candidate diagonal is aligned within a band,
    and reported if enough of the template's words match. first_word counts from 0 and
    last_word is one past the end. Of a line, all words that tell its license must match, and
    of a notice its version, so that a license or version without a template is not taken
    for another; of spans that overlap by half, the template that fits best stays. The default
    templates are those of license_set. The index (a few kilobytes a template) is broadcast;
    texts are scanned once and never shuffled.

    Null and empty texts, and templates under GRAM words, match nothing. Repeated rows are
    reported each; a null doc_id stays null; other columns are ignored; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES | long_templates() if templates is None else templates))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanner(shared, coverage), "doc_id long, license string, first_word long, last_word long, matched long, coverage double")
