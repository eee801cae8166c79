"""The operators on whole texts, against plain Python."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from windlass.llm import bytesops, decontam, mixing, simhash, substrings, tokenfiles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, key string, h string, size string"


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "Of", "und", "é", "naïve", "x1", "don't", "日本", "end.", "ß", "THE", "l'été"]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(45)) for _ in range(4)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) + str(rng.randrange(60)) * rng.randrange(2) for _ in range(rng.choice([0, 1, 2, 5, 34, 35, 36, 80, 300]))]
        text = "".join(w + rng.choice([" ", "\n", "  ", "\t", " \x0b"]) for w in words)
        if rng.random() < 0.3:
            text += rng.choice(shared) + " tail" + str(i)
        rows.append([i, text, rng.choice(["s1", "s2", "hot", "hot", None]), "clash", "clash", "clash"])
    rows += [[n, None, None, None, None, None], [n + 1, "", "s1", "", "", ""], [n + 2, rows[3][1], "s2", "", "", ""], [n + 3, rows[-1][1], "hot", "", "", ""]]
    rows += [[n + 4, "x " * 30000 + shared[0], "hot", "", "", ""], [7, rows[7][1], rows[7][2], "", "", ""], [None, "only this " * 20, None, "", "", ""]]
    rows += [[n + 5, " \t\n ", "s2", "", "", ""]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


def test_hashes_follow_the_words():
    values = [b"one two  three one two", b"", b"three one two", b"z" * 100 + b" one two"]
    buf, start, end, first = bytesops.tokens(values)
    h = bytesops.span_hashes(buf, start, end)
    by = {}
    for s, e, x in zip(start, end, h):
        assert by.setdefault(buf[s:e], x) == x
    assert len(set(by.values())) == len(by)
    assert first.tolist() == [0, 5, 5, 8, 11]
    w = bytesops.window_hashes(h, 3)
    words = [buf[s:e] for s, e in zip(start, end)]
    assert len(w) == 9 and len({(x, *words[i : i + 3]) for i, x in enumerate(w.tolist())}) == len(set(w.tolist())) == 6
    gaps = np.array([0, 0, 3, 258, 258, 1000, 70000])
    assert bytesops.decode_gaps(bytesops.encode_gaps(gaps)).tolist() == gaps.tolist()


def test_mixing_meets_targets(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    total = sum(sizes.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-9
        assert abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s)
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix_sources(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in rows}
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_weights_take_turns(spark):
    totals = spark.createDataFrame([("b", 100), ("a", 100), (None, 100), ("c", 100)], "source string, total long")
    got = {r.source: r.target for r in mixing.source_targets(totals).collect()}
    # 600 words by 5:2:1:5 (a, b, c, null): a and null stop at 200, and b and c share the remaining 200 by 2:1
    assert got == {"a": 200.0, None: 200.0, "b": pytest.approx(400 / 3), "c": pytest.approx(200 / 3)}


def brute_repeats(rows, window):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("cells", [4, 0.01])
def test_repeats(docs, empty, cells, monkeypatch):
    monkeypatch.setattr(substrings, "UNIT", 3000)
    same(substrings.remove_repeats(docs, cells=cells), brute_repeats(corpus(), 35))
    assert substrings.remove_repeats(empty).count() == 0


def brute_contamination(rows, items, window=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("null" if i is None else str(i))
    out = []
    for r in rows:
        w, hit, found = word(r[1]), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((r[0], len(w), len(hit), len(found), decontam.items_digest(list(found)), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, docs, empty, block_bytes):
    rows = corpus()
    items = [(1, " ".join(rows[13][1].split()[3:20])), (2, rows[20][1]), (2, "und 日本"), (3, None), (4, ""), (None, "Naïve"), (30, "X X X x"), (5, "no such words here at all"), (6, "... !!")]
    items += [(7, " ".join(rows[k][1].upper().split()[:14])) for k in range(30, 60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(decontam.contamination(docs, bench, block_bytes=block_bytes).select(*columns), brute_contamination(rows, items))
    assert decontam.contamination(empty, bench, block_bytes=block_bytes).count() == 0
    nothing = decontam.contamination(docs, bench.limit(0))
    assert nothing.count() == docs.count() and nothing.where("contaminated").count() == 0


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def classes(nodes, link):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if link(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    rows = corpus()
    fps = [brute_fingerprint(r[1]) for r in rows]
    of = classes(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, fp in zip(rows, fps):
        if r[0] is not None:
            least[of[fp]] = min(least.get(of[fp], r[0]), r[0])
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fp")), "component_id")
    same(got, [(r[0], f"{fp:016x}", least.get(of[fp])) for r, fp in zip(rows, fps)])
    assert simhash.near_duplicates(empty).count() == 0


def test_links_in_crowds_and_chains(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        x = rng.getrandbits(64)
        fps |= {x ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}  # crowds
        for _ in range(40):  # chains
            fps.add(x)
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    fps = sorted(fps)
    of = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    from windlass.llm.components import components
    from windlass.llm.scratch import Scratch

    scratch = Scratch(spark, "test")
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), scratch)
    roots = {r.node: r.root for r in components(edges, scratch).collect()}
    groups, expected = {}, {}
    for f in fps:
        groups.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
        expected.setdefault(of[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_token_files(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    expected = {}
    for r in corpus():
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [2]
        expected.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = tokenfiles.token_files(docs, path).collect()
    found, at = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert tokenfiles.token_files(empty, path).count() == 0


def test_words_encode_as_in_the_text():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole, encode = Tokenizer.from_file(path), tokenfiles.Encoder(path, "<u2")
    rng = random.Random(1)
    signs = ["a", "B", "é", "é", "́", "'s", "'", "1", "Σ", "ς", "\x85", "\xa0", "　", " ", "\n", "\x0b", "\x0c", "\x1c", "<|startoftext|>", "<|endoftext|>", "&", "日", "İ", "!"]
    for text in ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]:
        assert np.frombuffer(encode([text.encode()])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_words_are_encoded_together_and_apart_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(12)
    whole = Tokenizer.from_file(path)
    odd = ["", " a", " a b c", "<|endoftext|> x<|startoftext|>y", " ab ", "é ́", "\U0001f600\U0001f600 x", "İstanbul Σας ΣΑΣ", "it's don't 's '", "\x00 \x7f", "x" * 5000]
    letters = "abcXYZéß×÷ .,!'$1Α中́\n"
    odd += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    for some in (1, 7, 512):
        encode = tokenfiles.Encoder(path, "<u2")
        for lo in range(0, len(odd), some):
            got = encode([x.encode() for x in odd[lo : lo + some]])
            assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole.encode(x, add_special_tokens=False).ids for x in odd[lo : lo + some]]


def test_tokenizers_that_join_words_are_refused(tmp_path):
    import public_tokenizers

    good = public_tokenizers.path("word_bpe_49k.json")
    tokenfiles.check_tokenizer(good)
    with pytest.raises(ValueError, match="white space"):
        tokenfiles.check_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    made = json.loads(open(good, encoding="utf-8").read())
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}, {"added_tokens": [dict(made["added_tokens"][0], lstrip=True)]}):
        (tmp_path / "t.json").write_text(json.dumps(made | change))
        with pytest.raises(ValueError, match="white space"):
            tokenfiles.check_tokenizer(str(tmp_path / "t.json"))


def test_files_are_read_by_ranges_where_they_cannot_be_mapped(tmp_path, monkeypatch, spark):
    import public_tokenizers

    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(50)] + [(None, "x y"), (3, None)], "doc_id long, text string")
    manifest = tokenfiles.write_tokens(docs, f"file://{tmp_path}/files", public_tokenizers.path("word_bpe_49k.json"))
    found = json.loads((tmp_path / "files/manifest.json").read_text())
    read = lambda: [(d, a, ids.tolist()) for x in found["shards"] for d, a, ids in tokenfiles.Shard(f"file://{tmp_path}/files", x["name"], found["dtype"]).documents(0, x["docs"])]
    mapped = read()
    monkeypatch.setattr(tokenfiles, "_local", lambda uri: None)
    assert read() == mapped and len(mapped) == 52 and manifest.endswith("manifest.json")
