"""The operators with fitted models: held-out accuracy, recall, brute force and odd rows."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from windlass.llm import dom, extraction, licenses, mixing, neighbours, pitmanyor, quality
from windlass.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, label int"


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), "clash", 1)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "light", "house", "walks", "under", "morning"]) + rng.choice(["", "", "s", ",", "."]) for _ in range(n))


def quality_rows(seed=0, n=300):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randrange(20, 200))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), "spam" + str(i) + " " * 0 + (" spam" + str(i)) * 50])
        rows.append(row(i, text, rng.choice(["a", "b", None])))
        labels.append((i, int(good)))
    odd = [row(n, None), row(n + 1, ""), row(None, prose(rng, 50)), row(n + 2, "long " * 3 + prose(rng, 30000)), rows[5], rows[5]]
    return rows + odd, labels


def test_quality_keeps_good_documents(spark):
    rows, truth = quality_rows()
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(truth[:200] + [(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.quality_scores(docs, labels).collect()}
    held = [(i, q) for i, q in truth[200:]]
    assert np.mean([got[i] == bool(q) for i, q in held]) > 0.97
    assert not got[300] and not got[301] and got[302]
    kept = quality.keep_quality(docs.repartition(3), labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i, k in got.items() if k and i is not None for _ in range(3 if i == 5 else 1))
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    unlabelled = quality.quality_scores(docs, labels.limit(0))
    assert unlabelled.where("NOT kept").count() == unlabelled.where("n_grams = 0").count() == 2


def test_cut_is_the_kth_largest(spark):
    rng = random.Random(4)
    codes = [rng.randrange(1 << 48) for _ in range(200)] + [(5 << 32) + rng.randrange(1 << 20) for _ in range(100)] + [7] * 20 + [1 << 47] * 20
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    for k in (1, 17, 150, 325, 340):
        assert quality._cut(df, k) == sorted(codes, reverse=True)[k - 1]


def test_resampling_is_the_top_of_weights_and_noise(spark):
    """Counts, weights, the number kept and the choice, all again in plain Python."""
    rows, truth = quality_rows(3, 150)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    labels = spark.createDataFrame(truth[:100], "doc_id long, quality int")
    got = sorted((str(r.doc_id), r.n_grams, r.kept, r.log_weight) for r in quality.quality_scores(docs, labels).collect())
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(F.col("doc_id")).alias("g")).collect()}
    good = {i for i, q in truth[:100] if q}
    grams = [quality.ngrams([(r[1] or "").encode()])[0].tolist() for r in rows]
    raw, target = Counter(g for x in grams for g in x), Counter(g for r, x in zip(rows, grams, strict=True) if r[0] in good for g in x)
    own = sum(target.values())
    mixed = quality.PRIOR * (1 << quality.LOG2_BUCKETS) + quality.SHARE * own
    weight = lambda g: math.log((target[g] + mixed * raw[g] / sum(raw.values())) / (own + mixed)) - math.log(raw[g] / sum(raw.values()))
    weights = [sum(map(weight, x)) for x in grams]
    k = round(sum(min(1, math.exp(w)) for w, x in zip(weights, grams, strict=True) if x))
    keys = [w + noise[r[0]] if x else -math.inf for r, w, x in zip(rows, weights, grams, strict=True)]
    cut = sorted(keys, reverse=True)[k - 1]
    expected = sorted((str(r[0]), len(x), bool(x) and key >= cut - 1e-6, w) for r, x, w, key in zip(rows, grams, weights, keys, strict=True))
    assert [g[:3] for g in got] == [e[:3] for e in expected] and 0 < k < len(rows)
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-6)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="<p>no</p>";</script><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Home</a><li><a>News</a></ul></nav>
<div class="ad">Buy now</div>{open}<h1>Title &amp; more</h1><p><b>Lead   in<br>two</b><p>Second<i> part</i>&nbsp;here &lt;b&gt;</p><ul><li>one<li>two</ul>{close}<footer>&copy; site</footer>{end}"""


def sample_pages():
    rng = random.Random(8)
    body = lambda: "".join(f"<p>{prose(rng, rng.randrange(3, 60))}</p>" for _ in range(rng.randrange(2, 9)))
    return [f"<html><body><nav><ul><li><a>{prose(rng, 2)}</a></li></ul></nav><div class='ad'>{prose(rng, 6)}</div><article><h1>{prose(rng, 5)}</h1>{body()}</article><footer>{prose(rng, 6)}</footer></body></html>" for _ in range(60)]


def test_extraction(spark):
    text = "Title & more\nLead in two\nSecond part here <b>\none\ntwo"
    odd = [(1000, "u", PAGE.format(open="<article>", close="</article>", end="</body></html>")), (1001, "u", PAGE.format(open="<article>", close="</article>", end="")), (1002, None, None), (None, "v", ""), (1003, "v", "no markup at all"), (1004, "w", "<article><p>" + "word " * 60000), (1005, "w", "<<>>< p <article <p>x")]
    rows = [(k, "u", h) for k, h in enumerate(sample_pages())] + odd
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extraction.extract_text(pages).collect()}
    assert len(got) == len(rows) and got[1000].text == got[1001].text == text and got[1000].n_chars == len(text)
    assert got[1002].text == "" and got[None].text == "" and got[1004].n_chars == 60000 * 5 - 1
    for k, h in enumerate(sample_pages()):
        article = h[h.index("<h1>") : h.index("</article>")].replace("</h1>", "\n").replace("</p>", "\n").replace("<h1>", "").replace("<p>", "")
        assert got[k].text == article.strip("\n")
    assert extraction.extract_text(pages.limit(0)).count() == 0


def test_extraction_of_other_wrappings():
    pages = sample_pages()
    ex = extraction.fit_extractor(pages[:40])
    for open_, close, extra in (("<main>", "</main>", '<div class="comments"><p>first comment here</p></div>'), ('<div class="content">', "</div>", "<form><label>Mail</label><button>Send</button></form>"), ("<article>", "</article>", '<aside class="sidebar"><p>see also this</p></aside><div id="cookie-notice">We use cookies</div>')):
        html = pages[50].replace("<article>", open_).replace("</article>", close + extra)
        page = dom.parse(html)
        kept = ex.kept([page])[0]
        assert all(kept[k] <= kept[p] for k, p in enumerate(page.parents) if k)
        plain = dom.parse(pages[50])
        assert dom.main_text(page, kept) == dom.main_text(plain, ex.kept([plain])[0])


def test_extraction_goes_by_more_than_names():
    """Pages whose parts are nameless boxes, as the fitted ones never are."""
    pages = sample_pages()
    ex = extraction.fit_extractor(pages[:40])
    for html in pages[40:]:
        plain, hidden = dom.parse(html), dom.parse(re.sub(r"<(/?)(?:nav|footer|article)\b", r"<\1div", html).replace("class='ad'", "class='xyzzy'"))
        assert dom.main_text(hidden, ex.kept([hidden])[0]) == dom.main_text(plain, ex.kept([plain])[0])


def test_leaves_grow_with_the_table(spark):
    """Recall at two sizes where parts are cut again, and how few rows are compared."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(200, 16)) * 3
    for n in (3000, 9000):
        x = (centres[rng.integers(0, 200, n)] + 0.5 * rng.normal(size=(n, 16))).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = {}
        for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, parts=8, leaf=300).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        scores = x[::20].astype(float) @ x.T.astype(float)
        scores[np.arange(len(scores)), np.arange(0, n, 20)] = -np.inf
        true = np.argsort(-scores, axis=1)[:, :20]
        assert np.mean([len(got[20 * q] & set(t.tolist())) / 20 for q, t in enumerate(true)]) > 0.9
    top = neighbours.fit_router(x[:2000].astype(float), parts=8)
    tree = neighbours.Tree(top, {2: neighbours.fit_router(x[:600].astype(float), parts=5)})
    assert tree.leaves == 12 and np.allclose(tree(x[:50].astype(float)).sum(1), 1)
    home = tree.home(x[:50].astype(float))
    assert all((2 <= h < 7) == (p == 2) for h, p in zip(home, tree.part(x[:50].astype(float)), strict=True))


def test_licenses(spark):
    rng = random.Random(2)
    mit = licenses.TEMPLATES["mit"].split()
    changed = [w if k % 12 else "altered" for k, w in enumerate(mit)]
    rows = [row(0, prose(rng, 50) + "\n" + licenses.TEMPLATES["gpl-3.0-line"] + "\n" + prose(rng, 30)), row(1, " ".join(mit) + " " + prose(rng, 20)), row(2, prose(rng, 7) + " " + " ".join(changed)), row(3, prose(rng, 300)), row(4, None), row(5, ""), row(None, "All rights reserved.")]
    rows += [row(6, "rights all reserved. " + prose(rng, 20000) + " Released under the MIT License."), row(7, " ".join(mit[:40])), rows[1]]
    got = licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert found == {(0, "gpl-3.0-line"), (1, "mit"), (2, "mit"), (None, "all-rights-reserved"), (6, "mit-line")}
    by = {(r.doc_id, r.license): r for r in got}
    assert (by[0, "gpl-3.0-line"].first_word, by[0, "gpl-3.0-line"].last_word, by[0, "gpl-3.0-line"].coverage) == (50, 62, 1.0)
    assert by[2, "mit"].coverage == pytest.approx(1 - math.ceil(len(mit) / 12) / len(mit), abs=0.03) and len([r for r in got if r.doc_id == 1]) == 2
    assert licenses.scan_licenses(spark.createDataFrame(rows, DOCS).limit(0)).count() == 0


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            out[i] = [(c, s) for s, c in sorted((-float(np.cumsum(v * q)[-1]), c) for c, v in good if c != i)][:k]
    return out


def test_nearest_is_exact_on_small_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(100)]
    rows += [(100, None), (101, [0.0] * 8), (102, [float("nan")] + [1.0] * 7), (103, [None] + [1.0] * 7), (104, [1.0] * 3), (None, [1.0] * 8), (105, [float("inf")] * 8)]
    rows += [(i, rows[7][1]) for i in range(106, 120)]  # ties
    got = {}
    for r in neighbours.nearest(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int"), F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    expected = brute_nearest(rows, 20)
    assert set(got) == set(expected)
    for q, e in expected.items():
        assert [(v, s) for _, v, s in sorted(got[q])] == [(c, -s) for c, s in e]
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_queries_ask_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    table = rows + [rows[20], rows[20], (40, rows[7][1]), rows[33]]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, vectors in ((0, [rows[0][1]]), (20, [rows[20][1]]), (40, [rows[40][1], rows[7][1]])):
        expected = []
        for v in vectors:
            best = sorted((-float(np.cumsum(np.array(c) * np.array(v))[-1]), i) for i, c in table if i != q)[:5]
            expected += [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert sorted(got[q]) == sorted(expected)


def test_nearest_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    x = (centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 8))).astype(np.float32)
    x[1000:1600] = x[1000]  # a large group of equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, parts=16).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute_nearest([(i, v.tolist()) for i, v in enumerate(x)], 20)
    assert np.mean([len(got[q] & {c for c, _ in e}) / 20 for q, e in expected.items()]) > 0.93


def test_language_model(spark):
    rng = random.Random(6)
    rows = [row(i, prose(rng, rng.randrange(0, 120)) + rng.choice([" Naïve", " x" + str(i), ""])) for i in range(150)] + [row(500, None), row(501, ""), row(None, "the river"), row(7, "the river"), row(7, "the river"), row(502, "the " * 20000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = pitmanyor.score_documents(docs).collect()
    assert len(got) == len(rows)
    word = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() + ["</s>"]
    key = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter(w for r in rows if not key(r[0]) for w in word(r[1]))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(r[0]), key(r[0]), len(word(r[1])), sum(counts[w] > 0 for w in word(r[1])), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in word(r[1])), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)
    again = sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in pitmanyor.score_documents(docs).collect())
    assert again == sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert pitmanyor.score_documents(docs.limit(0)).count() == 0


def test_language_model_sums_to_one(spark):
    """Probabilities of every continuation of one context, one document each, all held out."""
    held = [i for i in range(4000) if pitmanyor.held_out(i)]
    seen = ["a", "b", "c", "d"]
    rng = random.Random(1)
    train = [row(i, " ".join(rng.choice(seen) for _ in range(30))) for i in range(60) if not pitmanyor.held_out(i)]
    probes = [row(i, f"a {w}") for i, w in zip(held[100:], [*seen, "unseen"])] + [row(held[200], "a")]
    got = {r.doc_id: r for r in pitmanyor.score_documents(spark.createDataFrame(train + probes, DOCS)).collect()}
    ends = {w: 10 ** got[d].score for d, w in zip(held[100:], [*seen, "unseen"])}
    lone = 10 ** got[held[200]].score  # P(a) P(end | a)
    assert 0 < sum(ends.values()) + lone < 1
    assert ends["b"] > 5 * ends["unseen"]


def test_tables_follow_their_distribution():
    """Against the generalised Stirling numbers, summed up customer by customer."""
    rng = np.random.default_rng(0)
    for c, rate in ((2, 0.3), (7, 0.05), (7, 2.0), (12, 1.0), (12, 40.0)):
        stirling = np.zeros(c + 2)
        stirling[1] = 1
        for n in range(1, c):
            t = np.arange(c + 2)
            stirling = np.maximum(n - t / 2, 0) * stirling + np.concatenate(([0], stirling[:-1]))
        weight = stirling[1 : c + 1] * rate ** np.arange(1, c + 1)
        drawn = pitmanyor.draw_tables(np.full(60_000, c), np.full(60_000, rate), rng)
        assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / 60_000 - weight / weight.sum()).max() < 0.01
    many = pitmanyor.draw_tables(np.array([1, 10**9, 10**9, 50]), np.array([5.0, 3.0, 1e5, 1e9]), rng)
    assert many[0] == 1 and 1 <= many[1] < 40 and abs(many[2] / 2e5 - 1) < 0.1 and many[3] == 50


class Restaurant:
    """A Pitman-Yor restaurant of discount 1/2 whose customers are seated one at a time."""

    def __init__(self, strength, parent):
        self.strength, self.parent, self.tables = strength, parent, {}

    def p(self, dish):
        n, t = sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))
        own = self.tables.get(dish, [])
        up = self.parent.p(dish) if isinstance(self.parent, Restaurant) else self.parent[dish]
        return (sum(own) - len(own) / 2 + (self.strength + t / 2) * up) / (self.strength + n)

    def add(self, dish, rng):
        own, t = self.tables.setdefault(dish, []), sum(map(len, self.tables.values()))
        up = self.parent.p(dish) if isinstance(self.parent, Restaurant) else self.parent[dish]
        k = rng.choices(range(len(own) + 1), [n - 0.5 for n in own] + [(self.strength + t / 2) * up])[0]
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            if isinstance(self.parent, Restaurant):
                self.parent.add(dish, rng)

    def remove(self, dish, rng):
        own = self.tables[dish]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            if isinstance(self.parent, Restaurant):
                self.parent.remove(dish, rng)


def tiny_corpus():
    rng = random.Random(5)
    docs = [row(i, " ".join(rng.choice(["a", "a", "a", "b", "c", "d e", "a a"]) for _ in range(rng.randrange(1, 9)))) for i in range(16)]
    words = lambda t: ["$", *t.split(), "$"]
    pairs = [p for r in docs if not pitmanyor.held_out(r[0]) for p in zip(words(r[1]), words(r[1])[1:], strict=False)]
    counts = Counter(w for _, w in pairs)
    n = len(pairs) + len(counts) + 1
    return docs, pairs, {w: (c + 1) / n for w, c in counts.items()} | {"?": 1 / n}


def by_customers(pairs, base, strength, parent_strength, sweeps):
    rng, top = random.Random(1), Restaurant(parent_strength, base)
    rooms, seen = {u: Restaurant(strength, top) for u, _ in pairs}, {}
    for u, w in pairs:
        rooms[u].add(w, rng)
    for sweep in range(sweeps):
        for u, w in pairs:
            rooms[u].remove(w, rng)
            rooms[u].add(w, rng)
        if sweep >= 50:
            for u in rooms:
                for w in base:
                    seen[u, w] = seen.get((u, w), 0) + rooms[u].p(w) / (sweeps - 50)
    return seen


def by_blocks(pairs, base, strength, parent_strength, sweeps):
    """The steps of the operator, without its shards."""
    rng, count, words = np.random.default_rng(2), Counter(pairs), sorted(base)
    key, rooms = sorted(count), sorted({u for u, _ in pairs})
    c, u, w = np.array([count[k] for k in key]), np.array([rooms.index(k[0]) for k in key]), np.array([words.index(k[1]) for k in key])
    h, seen, out = np.array([base[x] for x in words]), np.bincount(u, c), np.zeros((len(rooms), len(words)))
    t, gamma = np.minimum(c, 1), 2 * parent_strength + len(words)
    for sweep in range(sweeps):
        customers, seated = np.bincount(w, t, len(words)), np.bincount(u, t)
        known = customers > 0
        tables = np.zeros(len(words))
        tables[known] = pitmanyor.draw_tables(customers[known], gamma / 2 * h[known], rng)
        if sweep >= 50:
            parent = (customers - tables / 2 + (parent_strength + tables.sum() / 2) * h) / (parent_strength + customers.sum())
            own, left = np.zeros_like(out), np.zeros_like(out)
            own[u, w], left[u, w] = c, t
            out += (own - left / 2 + (strength + seated[:, None] / 2) * parent) / (strength + seen[:, None]) / (sweeps - 50)
        gamma = rng.standard_gamma(2 * parent_strength + tables.sum())
        mass = pitmanyor.draw_masses(customers, tables, h, gamma, rng)
        y = rng.standard_gamma(2 * strength + seated)
        t = pitmanyor.draw_tables(c, y[u] / 2 * (mass / mass.sum())[w], rng)
    return {(rooms[i], words[j]): out[i, j] for i in range(len(rooms)) for j in range(len(words))}


@pytest.mark.parametrize("strength, parent_strength", [(0.5, 1.0), (5.0, 0.2)])
def test_blocked_steps_agree_with_customers_seated_one_at_a_time(strength, parent_strength):
    _, pairs, base = tiny_corpus()
    a, b = (f(pairs, base, strength, parent_strength, n) for f, n in ((by_customers, 1500), (by_blocks, 12_000)))
    for u in {u for u, _ in pairs}:
        assert sum(b[u, w] for w in base) == pytest.approx(1, abs=1e-9)
    assert all(b[k] == pytest.approx(a[k], rel=0.04, abs=0.002) for k in a)


def test_scores_are_those_of_the_model(spark):
    docs, pairs, base = tiny_corpus()
    expected = by_blocks(pairs, base, 2.0, 1.0, 6000)
    probes = [(20, "a b c"), (21, "d e"), (22, "a a a"), (23, "b b b b")]
    assert any(pitmanyor.held_out(i) for i in range(16))
    held = [i for i in range(100, 200) if pitmanyor.held_out(i)]
    rows = docs + [row(held[k], t) for k, (_, t) in enumerate(probes)]
    for split in (1 << 20, 3):  # three tokens to a shard: every context is in several
        got = {r.doc_id: r.score for r in pitmanyor.score_documents(spark.createDataFrame(rows, DOCS), pitmanyor.Settings(2.0, 1.0, 3, 12), split=split).collect()}
        for k, (_, t) in enumerate(probes):
            words = ["$", *t.split(), "$"]
            assert got[held[k]] == pytest.approx(sum(math.log10(expected[p]) for p in zip(words, words[1:], strict=False)), abs=0.12)


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    rows, truth = quality_rows(9, 200)
    rows = [r[:5] for r in rows]
    bench = prose(rng, 15)
    rows += [(900, rows[8][1] + " ", "en", "a", 5), (901, prose(rng, 30) + " " + bench + " " + prose(rng, 30), "en", "b", 5)]
    data = {"documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"), "labels": ([(i, q, 0) for i, q in truth], "doc_id long, quality int, toxic int"), "benchmark": ([(1, bench)], "item_id long, text string")}
    for name, (values, schema) in data.items():
        spark.createDataFrame(values, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        sizes.append(docs)
    ids = [Counter(r.doc_id for r in d.collect()) for d in sizes]
    assert 8 in ids[0] and 900 in ids[0] and 900 not in ids[1] and max(v for k, v in ids[1].items()) == 1
    assert 901 in ids[1] and 901 not in ids[2] and len(ids[2]) == len(ids[1]) - 1
    taken = {r.doc_id: r.passes for r in mixing.mix_sources(sizes[2]).collect()}
    assert ids[3] == Counter({k: v for k, v in taken.items() if v}) and ids[4] == ids[3]
    run = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert Counter(r.doc_id for r in run.collect()) == ids[4]
    for name in data:
        spark.createDataFrame([], data[name][1]).write.parquet(str(tmp_path / f"empty/{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_scratch_lives_in_the_shared_folder(spark):
    scratch = Scratch(spark, "test")
    df = scratch.cut(spark.range(5).toDF("x"), "a")
    assert df.count() == 5 and spark.conf.get("spark.checkpoint.dir").removesuffix("/") in scratch.path and json.dumps(scratch.path)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
