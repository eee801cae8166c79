"""Properties of the pure functions below the operators."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from windlass.llm import bytesops, decontam, dom, licenses, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.sampled_from("ab Z\n\t\x0b.é日-1 "), max_size=80)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_tokens_are_the_words(texts):
    values = [t.encode() for t in texts]
    buf, start, end, first = bytesops.tokens(values)
    for d, t in enumerate(texts):
        got = [buf[s:e].decode() for s, e in zip(start[first[d] : first[d + 1]], end[first[d] : first[d + 1]])]
        assert got == WORD.findall(t)
    h = bytesops.span_hashes(buf, start, end)
    words = [buf[s:e] for s, e in zip(start, end)]
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words)))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_normal_texts(text):
    assert substrings.normal(text.encode()).decode() == " ".join(WORD.findall(text))
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert simhash.normal(text.encode()).decode() == " ".join(WORD.findall(lower))
    assert [w.decode() for w in decontam.words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 7))
def test_windows_hash_alike_if_equal(values, n):
    h = bytesops.mix(np.array(values, np.uint64) + np.uint64(1))
    got = bytesops.window_hashes(h, n).tolist()
    windows = [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
    assert len(got) == len(windows) and len(set(got)) == len(set(windows)) == len(set(zip(got, windows)))


@given(st.lists(st.integers(0, 100_000)))
def test_gaps_round_trip(values):
    values = np.sort(np.array(values, np.int64))
    assert bytesops.decode_gaps(bytesops.encode_gaps(values)).tolist() == values.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/!-=\"' &;apbdivul1\n"), max_size=120))
def test_any_markup_is_read(html):
    page = dom.parse(html)
    assert all(p < k for k, p in enumerate(page.parents)) and len(page.texts) == len(page.owners) == len(page.edges)
    x = dom.features(page, {"p": 0, "div": 1})
    assert x.shape == (len(page.tags), len(dom.NUMBERS) + 4) and np.isfinite(x).all()
    assert "\n\n" not in dom.main_text(page, np.ones(len(page.tags), bool))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
def test_winnowing_leaves_no_gap(values):
    h = np.array(values, np.uint64)
    kept = licenses.winnow(h)
    assert kept and all(any(lo <= k < lo + licenses.WINNOW for k in kept) for lo in range(len(h) - licenses.WINNOW + 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=3, max_size=20), st.lists(st.integers(7, 12), max_size=10), st.lists(st.integers(7, 12), max_size=10))
def test_alignment_finds_whole_templates(template, before, after):
    t, text = np.array(template), np.array(before + template + after)
    assert licenses.align(t, text, len(before)) == (len(t), len(before), len(before) + len(t))


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), max_size=20))
def test_intervals_merge(spans):
    spans = sorted((a, a + n) for a, n in spans)
    s, e = decontam._merged(np.array([x[0] for x in spans], np.int64), np.array([x[1] for x in spans], np.int64))
    assert {k for a, b in zip(s, e) for k in range(a, b)} == {k for a, b in spans for k in range(a, b)}
    assert all(b < a for b, a in zip(e[:-1], s[1:]))
