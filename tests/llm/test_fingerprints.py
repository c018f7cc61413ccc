"""Winnowing and SimHash against brute force."""

import hashlib
import random

import numpy as np
import xxhash

from stratagraph.llm import simhash, winnowing

DOC = "doc_id long, text string, lang string, component_id string, key long"


def rows(texts):
    return [(i, t, "en", "clash", 7) for i, t in texts]


def test_windows_pick_rightmost_minimum():
    h = np.array([3, 1, 2, 1, 1, 5, 0, 9], dtype=np.uint64) << np.uint64(32)
    want = sorted({max((-int(h[i + j]), i + j) for j in range(3))[1] for i in range(len(h) - 2)})
    assert winnowing.window_minima(h, 3).tolist() == want


def test_blocks_change_nothing():
    r = random.Random(3)
    t = "".join(r.choice("abcde ") for _ in range(5000))
    whole, parts = winnowing.winnow(t), winnowing.winnow(t, block=333)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_match_guarantee():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = word(winnowing.GRAM + winnowing.WINDOW - 1)
    for _ in range(20):
        a, b = word(300) + shared + word(50), word(77) + shared + word(400)
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


def test_against_edits(spark):
    texts = [(4, "alpha beta gamma " * 30), (9, None), (9, "zz"), (None, "last one"), (2, ""), (1, "alpha beta gamma " * 30), (7, "x" * 4000)]
    got = winnowing.against_edits(spark.createDataFrame(rows(texts), DOC)).collect()
    assert len(got) == len(texts)
    order = sorted(((i if i is not None else -(2**63), t or "") for i, t in texts), key=lambda x: (-x[0], x[1]))
    want = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        want[i, len(t)] = (hashlib.sha256(e.encode()).hexdigest(), winnowing.likeness(winnowing.winnow(t)[0], winnowing.winnow(nxt)[0]))
    for r in got:
        assert want[r.doc_id if r.doc_id is not None else -(2**63), r.n_chars] == (r.edited_sha256, r.near_next)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[4, 510].fingerprint == by[1, 510].fingerprint
    assert winnowing.against_edits(spark.createDataFrame([], DOC)).count() == 0


def plain_simhash(t):
    parts = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t).replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_value():
    for t in ("", "One", "a b c", "A b\tc d", "a b c d e É é f g", "x " * 3000):
        assert simhash.simhash(t) == plain_simhash(t)


def brute_components(fps, d):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= d:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def some_fingerprints(n, seed):
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    for x in list(out)[: n // 2]:
        for bits in (1, 3, 4, 5, 6):
            for b in r.sample(range(64), bits):
                x ^= 1 << b
            out.add(x)
    return out


def test_group_links_match_brute_force():
    fps = some_fingerprints(300, 1)
    a, b = simhash.group_links(*[np.array(sorted(fps), dtype=np.uint64)] * 2, 4)
    root = {f: f for f in fps}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[x] = y
    want = brute_components(fps, 4)
    groups = lambda m: sorted(sorted(f for f in m if top(m, f) == k) for k in {top(m, f) for f in m})

    def top(m, f):
        while m[f] != f:
            f = m[f]
        return f

    assert groups(root) == groups(want)


def test_links_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 20)
    base = 0x0123456789ABCDEF
    fps = {base ^ (1 << i) ^ (1 << j) for i in range(30, 45) for j in range(i)} | some_fingerprints(60, 2)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    from stratagraph.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    want = brute_components(fps, 4)
    sizes = sorted(c for c in __import__("collections").Counter(want.values()).values() if c > 1)
    assert sorted(c + 1 for c in __import__("collections").Counter(got.values()).values()) == sizes


def test_near_duplicates_rows(spark):
    t = "one two three four five six seven eight nine ten"
    texts = [(5, t), (3, t), (3, t), (None, t), (8, None), (6, ""), (9, "other words that are not alike at all here")]
    got = simhash.near_duplicates(spark.createDataFrame(rows(texts), DOC)).collect()
    assert len(got) == len(texts)
    assert {r.component_id for r in got if r.doc_id in (3, 5, None)} == {3}
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (6, 8)} == {("0" * 16, 6)}
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_short_texts_are_near_their_edits(spark):
    r = random.Random(6)
    texts = [(i, "".join(r.choice("abcdefghijklmnop ") for _ in range(r.randint(34, 247)))) for i in range(200)]
    got = winnowing.against_edits(spark.createDataFrame(rows(texts), DOC)).collect()
    assert len(got) == 200 and min(x.near_edited for x in got) > 0
