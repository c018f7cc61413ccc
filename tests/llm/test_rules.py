"""Quality rules, URL filters and toxicity against brute force and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from stratagraph.llm import quality_rules as qr, toxicity, url_filters


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    base = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), base


def some_texts():
    r = random.Random(6)
    out = ["", " \n\t", "one two", "a b c d e a b c d e", "x " * 5000, "é\u00a0ü\u2003z " * 7, "#*$%&|<> " * 20]
    for _ in range(60):
        out.append("".join(r.choice(["aa", "b", "c.", "\n", " ", " ", " ", "| ", "#"]) for _ in range(r.randint(1, 300))))
    return out


def test_counts(spark):
    ts = some_texts()
    df = spark.createDataFrame([(i, t, "q", True) for i, t in enumerate(ts)] + [(None, None, "q", False)], "doc_id long, text string, n_words string, kept boolean")
    got = qr.quality(df).collect()
    assert len(got) == len(ts) + 1
    for r in got:
        t = ts[r.doc_id] if r.doc_id is not None else ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        assert not (r.base_failed and r.kept)
    assert qr.quality(df.where("false")).count() == 0


def test_verdicts():
    r = random.Random(3)
    sentence = lambda: " ".join("".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 7))) for _ in range(14)) + "."
    prose, nav = [sentence() for _ in range(8)], "Home | About | Contact | Terms | Login"
    assert qr.judge("\n".join(prose))[6]
    assert not qr.judge("\n".join(" | ".join(sentence().split()) for _ in range(8)))[6]
    mixed = qr.judge("\n".join([*prose, nav]))
    assert mixed[6] and mixed[7] == "\n".join(prose)


URLS = [(1, "https://A.Example.NET/en/x"), (2, "http://www.shop.net"), (3, "http://www.shop.net/"), (4, "https://example.com/de/q?x"), (5, "https://sub.example.com/DE/"), (6, "ftp://x.org/fr/1#a"), (7, None), (8, "no scheme/en/"), (9, "https://notexample.net/en/"), (10, "http://x.net?q=/en/"), (11, "a://b://c/fr/")]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in URLS], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, labels).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("www.shop.net", "", None, "allow"), 3: ("www.shop.net", "/", "net/", "block"), 4: ("example.com", "/de/q", "example.com/de/", "block"),
        5: ("sub.example.com", "/DE/", None, "allow"), 6: ("x.org", "/fr/1", "org/fr/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("notexample.net", "/en/", "net/", "block"), 10: ("x.net", "", None, "allow"),
        11: ("b:", "//c/fr/", None, "allow"),
    }
    assert url_filters.filter_urls(pages.where("false"), labels).count() == 0


def test_mined_rules(spark):
    r = random.Random(0)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        parts = ["https", "example", r.choice(["alpha", "beta", "gamma"]), r.choice(["one", "two", "three"])]
        if bad:
            parts[2:] = ["casino", "win"] if i % 8 else ["beta", "three", "promo"]
        rows.append((i, f"{parts[0]}://{'-'.join(parts[1:])}.org/p", bad))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(None, rows[0][1]), (900, rows[0][1])], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0, "u") for i, _, b in rows] + [(None, 0, 0, "u"), (5, None, None, "u")], "doc_id long, quality int, toxic int, url string")
    got = url_filters.filter_urls(pages, labels).collect()
    assert len(got) == len(rows) + 2
    verdict = {x.page_id: x.verdict for x in got}
    # brute force: all token sets of up to three tokens that are frequent and confident enough
    from itertools import combinations

    tokens = {i: frozenset(t for t in re.split(r"[^a-z0-9]+", u) if t and not t.isdigit()) for i, u, _ in rows}
    count, hits = Counter(), Counter()
    for i, _, b in rows:
        for n in (1, 2, 3):
            for c in combinations(sorted(tokens[i]), n):
                count[c] += 1
                hits[c] += b
    rules = [set(c) for c in count if hits[c] >= max(0.005 * len(rows), 8) and hits[c] >= 0.6 * count[c]]
    for i, _, _ in rows:
        assert verdict[i] == ("block" if any(x <= tokens[i] for x in rules) else "allow")
    assert verdict[900] == verdict[0] == "block"


def toxic_corpus(n=400):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.2
        if toxic:
            for w in r.sample(["zumquat", "zumblest", "vexxor", "vexxing", "zumtar"], 3):
                words.insert(r.randrange(len(words)), w)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows] + [(None, None, "en", 0.1), (9000, "", "en", 0.1), (6, rows[6][1], "de", 0.2)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 2 == 0] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 3
    from zlib import crc32

    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
    by = {r.doc_id: r.predicted for r in got}
    held = [(by[i], y) for i, _, y in rows if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p for p, y in held if y]) >= 0.9 and np.mean([p for p, y in held if not y]) <= 0.05
    assert by[9000] == 0 and by[None] == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.keep_clean(docs, model).count() == len(got) - sum(r.predicted for r in got)
    none = toxicity.train(docs.where("false"), labels)
    assert toxicity.score(docs.where("false"), none).count() == 0 and toxicity.score(docs, none).where("predicted = 1").count() == 0


def test_risk_stays_non_negative():
    r = np.random.default_rng(0)
    pos = [np.unique(r.integers(0, 500, 20)).astype(np.uint32) for _ in range(40)]
    m = toxicity.fit(pos, [p for p in pos for _ in range(3)], 0.9)
    assert np.isfinite(m.bias) and all(np.isfinite(x) for x in m.weights.values())


@pytest.mark.parametrize("text", ["", "a", "zum"])
def test_features(text):
    assert len(set(toxicity.hashed(text).tolist())) == len(toxicity.hashed(text))


def test_boilerplate_in_lines_of_any_length():
    """Phrases are judged against the words of their line, with no limit on its length."""
    from stratagraph.llm.quality_rules import line_fails

    prose = "the river bends and the road bends with it past quiet fields. " * 8
    banner = "We use cookies on this site, please read our privacy policy and the terms of use before you go on. " * 4
    assert len(banner) > 300 and line_fails(banner, banner.split())
    one = prose + "He baked a cookie."
    assert not line_fails(one, one.split())
    short = "Please accept every cookie."
    assert line_fails(short, short.split())
