"""Cases in which an operator once did less than the whole job."""

import random
import re

import corpus_pipeline
from windlass.llm import decontam, dom, extraction, licenses, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NOISE = "the river and the stone under a light of morning walks home again "


def scan(spark, texts):
    rows = [(i, NOISE * 3 + t + " " + NOISE * 3, "en", "s", len(t)) for i, t in enumerate(texts)]
    found = [set() for _ in texts]
    for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect():
        found[r.doc_id].add(r.license)
    return found


def test_licenses_and_their_versions_are_told_apart(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
    cases = {
        "This work is licensed under the GNU General Public License, version 2.": {"gpl-2.0-line"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0-line"},
        "This work is licensed under the GNU General Public License, version 7.": set(),
        "This work is licensed under the GNU Affero General Public License, version 3.": {"agpl-3.0-line"},
        gnu.format("General Public License", 2): {"gpl-2.0-notice"},
        gnu.format("General Public License", 3): {"gpl-3.0-notice"},
        gnu.format("Lesser General Public License", "2.1"): {"lgpl-2.1-notice"},
        gnu.format("Affero General Public License", 3): {"agpl-3.0-notice"},
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0-line"},
        "Licensed under CC BY-NC 3.0.": {"cc-by-nc-3.0-line"},
        "Licensed under CC BY-SA 4.0.": {"cc-by-sa-4.0-line"},
        "Licensed under CC BY-NC-ND 9.0.": set(),
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"cc-by-sa-4.0-name"},
        "SPDX-License-Identifier: EPL-2.0": {"epl-2.0-spdx"},
        "SPDX-License-Identifier: Frobnicate-2.0": set(),
        "Distributed under the BSD 3-Clause License.": {"bsd-3-clause-line"},
        "Released under the Frobnicate License.": set(),
        licenses.TEMPLATES["bsd-2-clause"]: {"bsd-2-clause"},
        licenses.TEMPLATES["bsd-3-clause"]: {"bsd-3-clause"},
        licenses.TEMPLATES["isc"]: {"isc"},
        licenses.TEMPLATES["0bsd"]: {"0bsd"},
        licenses.TEMPLATES["mpl-2.0-notice"].replace("https", "http"): {"mpl-2.0-notice"},
        licenses.TEMPLATES["bsl-1.0-notice"]: {"bsl-1.0-notice"},
        licenses.TEMPLATES["unlicense"]: {"unlicense"},
        licenses.TEMPLATES["cc0-1.0-notice"]: {"cc0-1.0-notice"},
    }
    assert dict(zip(cases, scan(spark, list(cases)), strict=True)) == cases


def test_every_template_is_found_in_its_own_text(spark):
    templates = licenses.TEMPLATES | licenses.long_templates()
    found = scan(spark, list(templates.values()))
    assert [n for n, f in zip(templates, found, strict=True) if n not in f] == []


def test_deep_elements_keep_their_place():
    deep = dom.parse("<body><article>" + "<div>" * 5000 + "<p>deep</p><aside>aside</aside>" + "</div>" * 5000 + "<p>rest</p></article><p>outside</p></body>")
    path = {}
    for piece, owner in zip(deep.texts, deep.owners, strict=True):
        path[piece] = []
        while owner:
            path[piece].append(deep.tags[owner])
            owner = deep.parents[owner]
    assert path == {"deep": ["p"] + ["div"] * 5000 + ["article", "body"], "aside": ["aside"] + ["div"] * 5000 + ["article", "body"], "rest": ["p", "article", "body"], "outside": ["p", "body"]}
    assert dom.features(deep, {})[:, dom.NUMBERS.index("depth")].max() == 5003
    unclosed = dom.parse("<div>" + "<font>" * 50000 + "text" + "</b>" * 50000 + "<aside>aside</aside></div><p>after</p>")
    assert [unclosed.tags[k] for k in unclosed.owners] == ["font", "aside", "p"] and unclosed.parents[unclosed.owners[2]] == 0


def test_pipeline_keeps_one_document_of_each_component(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    a, b, c, d, e = (text() for _ in range(5))
    # near copies without doc_id; a copy of a named one; one doc_id on two texts, one of which has a copy; repeated rows
    rows = [(None, a), (None, a + " "), (None, a.upper()), (None, b), (1, b), (5, c), (5, d), (6, c), (6, d), (7, e), (7, e), (None, None), (None, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(4)
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    kept = sorted((r.doc_id or 0, (r.text or "").strip().lower()) for r in got)
    assert kept == sorted([(0, a), (1, b), (5, c), (5, d), (7, e), (0, "")])


def test_any_trigram_of_a_short_license_makes_it_a_candidate(spark):
    index = licenses.Index(licenses.TEMPLATES)
    held = dict(zip(index.keys.tolist(), index.postings, strict=True))
    for t, w in enumerate(index.words):
        if licenses.GRAM <= len(w) < 40:
            assert all((t, k) in held[int(g)] for k, g in enumerate(licenses.window_hashes(w, licenses.GRAM)))
    changed = ["Distributed under the MIT License.", "Released under the MIT Licence.", "Released in the MIT License."]
    template = {"mit-line": licenses.TEMPLATES["mit-line"]}
    rows = [(i, NOISE + t + " " + NOISE, "en", "s", 1) for i, t in enumerate(changed)]
    assert {r.doc_id for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS), template).collect()} == {0, 1, 2}


def test_extraction_is_fitted_on_whole_pages(spark, monkeypatch):
    fitted = []
    fit = extraction.fit_extractor
    monkeypatch.setattr(extraction, "fit_extractor", lambda pages: fitted.append(pages) or fit(pages))
    html = [f"<article><p>{NOISE * 600} {k}</p></article><footer>end of {k}</footer>" for k in range(6)]
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(html + html[:2] + ["", None])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract_text(pages).collect()}
    assert min(map(len, html)) > 20000 and sorted(h for h in fitted[0] if h) == sorted(html)
    assert all(got[k].endswith(f"home again {k}") for k in range(6))
    assert len(extraction.sample_pages(pages, 160, len(html[0]) * 3)) in (3, 4)  # the empty page may be the fourth


def test_the_longest_match_is_with_one_item(spark):
    w = [f"w{k}" for k in range(60)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[12:30])), (3, "short one"), (4, " ".join(w[12:24] + w[40:60]))]
    texts = ["x y " + " ".join(w[:30]) + " z", "a short one here", "nothing", " ".join(w[14:24] + w[40:50])]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 40):
        got = {r.doc_id: (r.longest, r.longest_at, r.n_hit) for r in decontam.contamination(docs, bench, block_bytes=size).collect()}
        assert got == {0: (18, 14, 30), 1: (2, 1, 2), 2: (0, 0, 0), 3: (20, 0, 20)}


def places(words, template):
    """Where a template's words stand in a row, without overlaps."""
    out, k = [], 0
    while k + len(template) <= len(words):
        if words[k : k + len(template)] == template:
            out.append((k, k + len(template)))
            k += len(template)
        else:
            k += 1
    return out


def test_every_notice_is_found_however_close_the_next(spark):
    rng, texts = random.Random(3), []
    names = ["all-rights-reserved", "mit-line", "apache-2.0-line", "cc-by-nc-4.0-line", "gpl-3.0-line"]
    for n in (1, 2, 6):
        texts += [" ".join([licenses.TEMPLATES[k]] * n) for k in names]
    texts += [licenses.TEMPLATES["all-rights-reserved"] + " so and " + licenses.TEMPLATES["mit-line"] + " so " + licenses.TEMPLATES["mit-line"], " ".join([licenses.TEMPLATES["mit"]] * 3)]
    for _ in range(40):
        texts.append(" ".join(rng.choice([licenses.TEMPLATES[rng.choice(names)], "river", "stone light under"]) for _ in range(rng.randrange(2, 14))))
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.first_word, r.last_word))
    word = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    for k, t in enumerate(texts):
        expected = {(name, *p) for name in [*names, "mit"] for p in places(word(t), word(licenses.TEMPLATES[name]))}
        assert got.get(k, set()) == expected, t


def test_spans_are_compared_only_where_they_meet():
    rng = random.Random(4)
    for _ in range(50):
        found = []
        for k in range(rng.randrange(40)):
            a = rng.randrange(600)
            found.append((rng.randrange(20), (f"n{k}", a, a + rng.choice([3, 9, 200]), 3, rng.random())))
        kept = []
        for _, f in sorted(found, key=lambda f: (-f[0], -f[1][4], f[1][1], f[1][0])):
            if not any(2 * (min(f[2], g[2]) - max(f[1], g[1])) > min(f[2] - f[1], g[2] - g[1]) for g in kept):
                kept.append(f)
        assert licenses.best_fits(found) == sorted(kept, key=lambda f: (f[1], f[0]))


def test_stray_quotes_hide_no_text():
    cases = {
        "<article><p data=it's>Hello big text</p><p>More text, don't stop</p></article>": "Hello big text More text, don't stop",
        '<p class=a">one</p><p "x">two</p>': "one two",
        "<p title='a > b' id=x'y'>one<b '>two": "one two",
        '<a href="x>y" ">link</a> "quoted" text': 'link  "quoted" text',
        "<p =a=b c = 'd' e= f/>one</p>": "one",
        "<p a=>one</p><p a='>lost": "one",
        "<p>a</3>b<!x'y>c<?z'>d</ p>e": "a b c d e",
        "<script>'</p><p>'</script x>after": "after",
    }
    for html, text in cases.items():
        assert " ".join(dom.parse(html).texts).split() == text.split(), html
    page = dom.parse("<div class=\"a b\" CLASS=c id='d e' role=f>x</div>")
    assert page.tokens[1] == ("a", "b", "d", "e", "f")
    assert dom.parse("<p " + "a='b' " * 30000 + "'" * 30000 + ">end").texts == ["end"]


def test_suffix_arrays_are_sorted_and_searched_right():
    rng = random.Random(8)
    for round_ in range(30):
        vocabulary = "a b c d e f".split()[: rng.choice([1, 2, 6])]
        text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
        values = [text(rng.randrange(12)) for _ in range(rng.randrange(1, 8))]
        values += [values[0], "", text(60)]
        items = decontam.Items([(str(k), text(rng.randrange(9)).encode()) for k in range(5)] + [("z", b"a zz b")], 3)
        array = decontam.SuffixArray([v.encode() for v in values], max(items.longest, rng.choice([1, 70])))
        split = [v.split() for v in values]
        flat = [(d, k) for d, w in enumerate(split) for k in range(len(w))]
        assert sorted(array.word[array.array].tolist()) == list(range(len(flat)))
        n, where = array.longest(items)
        listed = [x[0].split() for x in [[items.buf[items.start[i] : items.end[i + items.left[i] - 1]].decode()] for i in range(len(items.left))]]
        common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        for i, suffix in enumerate(listed):
            best = max((common(suffix, split[d][k:]) for d, k in flat), default=0)
            assert n[i] == best and (best == 0) == (where[i] < 0)
            if best:
                d, k = flat[where[i]]
                assert common(suffix, split[d][k:]) == best
        word, place = array.hits(items, n)
        expected = sorted((f, i) for f, (d, k) in enumerate(flat) for i, suffix in enumerate(listed) if (m := int(items.window[i])) and split[d][k : k + m] == suffix[:m])
        assert sorted(zip(word.tolist(), place.tolist(), strict=True)) == expected


def test_longest_matches(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(n))
    rows = [(k, text(rng.randrange(40))) for k in range(30)] + [(None, None), (50, "")]
    items = [(k, text(rng.randrange(12))) for k in range(12)] + [(3, text(9)), (20, "zz"), (21, None), (None, "a b")]
    got = {}
    for size in (1 << 20, 40):
        docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
        got[size] = {r.item_id: (r.words, r.doc_id, r.doc_at, r.item_at) for r in decontam.longest_matches(docs, bench, block_bytes=size).collect()}
    best = {}
    for i, t in items:
        w = (t or "").split()
        for d, u in rows:
            x = (u or "").split()
            for a in range(len(w)):
                for b in range(len(x)):
                    n = 0
                    while a + n < len(w) and b + n < len(x) and w[a + n] == x[b + n]:
                        n += 1
                    if n:
                        key = "null" if i is None else str(i)
                        best[key] = min(best.get(key, (0,)), (-n, -1 if d is None else d, b, a))
    assert got[1 << 20] == got[40] == {k: (-v[0], None if v[1] == -1 else v[1], v[2], v[3]) for k, v in best.items()}


def test_pipelines_and_threads_leave_each_other_alone(spark):
    with scratch.collected() as outer:
        a = scratch.Scratch(spark, "a")
        with scratch.collected() as inner:
            b = scratch.Scratch(spark, "b")
        c = scratch.Scratch(spark, "c")
    scratch.Scratch(spark, "d")
    assert outer == [a, c] and inner == [b]
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with scratch.settings(spark, {key: "7"}):
        with scratch.settings(spark, {key: "7"}):
            pass
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before
