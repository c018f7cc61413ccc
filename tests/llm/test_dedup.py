"""Line and substring dedup against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stratagraph.llm import line_dedup, substring_dedup as sd

DOC = "doc_id long, text string, lang string, row long, n_lines string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", 3, "clash") for i, t in texts], DOC)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_lines_equal_sql(spark):
    r = random.Random(4)
    pool = [sentence(r, n) for n in (1, 2, 3, 8, 9, 12)] * 2 + ["", "  "]
    texts = [(i, "\n".join(r.choice(pool) if r.random() < 0.6 else sentence(r, 9) for _ in range(r.randint(1, 12)))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, texts[3][1]), (103, "\n".join(texts[5][1].split("\n") * 30))]
    got = {x.doc_id: x for x in line_dedup.remove_lines(frame(spark, texts)).collect()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    for doc_id, *want in con.sql(line_dedup.ORACLE_SQL).fetchall():
        x = got[doc_id]
        assert [x.n_lines, x.n_removed, x.longest_run, hashlib.md5((x.text or "").encode()).hexdigest()] == want
    assert got[103].longest_run >= 29
    assert got[100].text is None and got[0].row == 3


def test_lines_of_repeated_rows_and_empty_tables(spark):
    t = sentence(random.Random(1), 10) + "\n" + sentence(random.Random(2), 10)
    got = line_dedup.remove_lines(frame(spark, [(1, t), (1, t), (None, t)])).collect()
    assert sorted(x.n_removed for x in got) == [0, 2, 2] and {x.doc_id for x in got if x.n_removed == 0} == {1}
    assert line_dedup.remove_lines(frame(spark, [])).count() == 0
    assert line_dedup.remove_lines(frame(spark, [(1, "alone")])).first().text == "alone"


def test_suffix_array_equals_brute_force(spark):
    r = random.Random(8)
    pool = ["a", "b", "c", "dd dd"]
    docs = [[r.choice(pool) if r.random() < 0.85 else f"only {r.random()}" for _ in range(r.randint(0, 25))] for _ in range(25)]
    docs += [docs[3], docs[4] + docs[5], ["a"] * 20, ["a"] * 13, docs[4] + docs[5]]
    table = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "row long, text string").repartition(3)
    paths = line_dedup.suffix_paths(line_dedup.line_ids(table, "text", 8))
    got = line_dedup.suffix_array(paths).orderBy("at").collect()

    def common(x, y):
        k = 0
        for p, q in zip(docs[x[0]][x[1] :], docs[y[0]][y[1] :], strict=False):
            if p != q:
                break
            k += 1
        return k

    every = [(i, j) for i, d in enumerate(docs) for j in range(len(d))]
    want = [p for p in every if sum(docs[q[0]][q[1]] == docs[p[0]][p[1]] for q in every) > 1]
    places = [(x.row, x.pos) for x in got]
    assert sorted(places) == want
    assert [x.lcp for x in got] == [0] + [common(a, b) for a, b in zip(places, places[1:], strict=False)]
    # sorted: no suffix elsewhere has more in common with a place than its neighbours do
    for i, p in enumerate(places):
        near = max(common(p, places[j]) for j in (i - 1, i + 1) if 0 <= j < len(places))
        assert near == max(common(p, q) for q in places if q != p)


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs_of_any_length(spark, least):
    r = random.Random(least)
    texts = [(i, "\n".join(r.choice("abcdef") for _ in range(r.randint(1, 30)))) for i in range(20)]
    got = {x.doc_id: x for x in line_dedup.remove_lines(frame(spark, texts), min_lines=least).collect()}
    seen, split = set(), [t.split("\n") for _, t in texts]
    places = [(i, p) for i, lines in enumerate(split) for p in range(len(lines))]

    def common(i, p, j, q):
        n = 0
        while p + n < len(split[i]) and q + n < len(split[j]) and split[i][p + n] == split[j][q + n]:
            n += 1
        return n

    for i, lines in enumerate(split):
        gone, longest = set(), 0
        for p in range(len(lines) - least + 1):
            run = tuple(lines[p : p + least])
            if run in seen:
                gone |= set(range(p, p + least))
                longest = max(longest, *(common(i, p, *x) for x in places if x != (i, p)))
            seen.add(run)
        assert got[i].text == "\n".join(x for p, x in enumerate(lines) if p not in gone) and got[i].n_removed == len(gone)
        assert got[i].longest_run == longest


@pytest.mark.parametrize("seed", range(5))
def test_compact_windows(seed):
    r = np.random.default_rng(seed)
    v = r.permutation(np.arange(1, 301)).astype(np.uint64)
    v[[17, 140]] = 0
    want = set()

    def tree(a, b):
        if b - a + 1 < 5:
            return
        c = a + int(v[a : b + 1].argmin())
        want.add((max(a, c - 4), c, min(b, c + 4)))
        tree(a, c - 1)
        tree(c + 1, b)

    for a, b in ((0, 16), (18, 139), (141, 299)):
        tree(a, b)
    assert {tuple(map(int, x)) for x in zip(*sd.compact_windows(v, 5), strict=True)} == want
    same = np.array([9, 7, 7, 7, 7, 7, 7, 7, 8, 9, 9, 9, 9, 9], dtype=np.uint64)
    assert [tuple(map(int, x)) for x in zip(*sd.compact_windows(same, 5), strict=True)] == [(0, 1, 11), (8, 8, 12), (9, 9, 13)]


def test_signatures_equal_brute_force():
    r = np.random.default_rng(3)
    width, hashes, cols = 6, 3, []
    want = set()
    for doc in (4, 9):
        h = r.integers(1, 40, 80).astype(np.uint64)
        v = [sd.minhash(h, f) for f in range(hashes)]
        for f in range(hashes):
            for left, c, right in zip(*sd.compact_windows(v[f], width), strict=True):
                cols.append((int(v[f][c].view(np.int64) & ~7) | f, doc, int(left), int(c), int(right)))
        low = [[int(v[f][s : s + width].min()) for s in range(len(h) - width + 1)] for f in range(hashes)]
        for f in range(hashes):
            for g in range(f + 1, hashes):
                want |= {(doc, f, g, s) for s in range(1, len(low[0])) if (low[f][s], low[g][s]) != (low[f][s - 1], low[g][s - 1])} | {(doc, f, g, 0)}
    got = sd.overlaps(*(np.array(x) for x in zip(*cols, strict=True)), width, hashes)
    assert len(got["key"]) == len(want) and {(int(d), int(x)) for d, x in zip(got["row"], got["l"], strict=True)} == {(d, s) for d, _, _, s in want}


def test_passages_are_found(spark):
    r = random.Random(9)
    shared, near, short, line = sentence(r, 60), sentence(r, 120), sentence(r, 40), sentence(r, 14)
    changed = near.split()
    changed[60] = "changed"
    body = lambda: sentence(r, 80)
    texts = [(i, f"{body()} {line} {body()}") for i in range(6)]
    texts += [(10, f"{body()} {shared} {body()}"), (11, f"{shared}\n{body()}"), (12, f"{body()}\t{shared}")]
    texts += [(20, f"{body()} {near} {body()}"), (21, f"{body()} {' '.join(changed)}")]
    texts += [(30, f"{body()} {short} {body()}"), (31, f"{body()} {short}")]
    texts += [(40, None), (41, ""), (42, "x"), (None, f"{body()} {shared}")]
    docs = frame(spark, texts)
    got = {x.doc_id: x for x in sd.documents_with_passages(docs).collect()}
    assert len(got) == len(texts)
    for i in (11, 12, None):
        assert got[i].class_id == 10 and got[i].n_passages == 1 and got[i].duplicate_words == 60 and got[i].partners == [10]
    assert got[10].class_id == 10 and got[10].n_passages == 0
    assert got[21].class_id == 20 and got[21].duplicate_words >= 110
    for i in [*range(6), 30, 31, 40, 41, 42]:
        assert got[i].class_id == i and got[i].n_passages == 0
    clean = {x.doc_id: x.text for x in sd.remove_passages(docs).collect()}
    words = lambda t: re.findall(r"\S+", t)
    assert clean[40] is None and clean[10] == dict(texts)[10] and clean[3] == dict(texts)[3]
    assert words(clean[12]) == words(dict(texts)[12])[:80]
    assert shared not in clean[11] and shared not in clean[None]
    assert sd.documents_with_passages(frame(spark, [])).count() == 0


def test_hot_passage_and_copies(spark):
    r = random.Random(2)
    shared, copy = sentence(r, 70), sentence(r, 200)
    texts = [(i, f"{sentence(r, 60)} {shared} {sentence(r, 60)}") for i in range(30)] + [(i, copy) for i in range(30, 50)]
    got = {x.doc_id: x for x in sd.documents_with_passages(frame(spark, texts)).collect()}
    assert {got[i].class_id for i in range(30)} == {0} and {got[i].class_id for i in range(30, 50)} == {30}
    assert all(got[i].duplicate_words >= 70 for i in range(1, 30))


def test_repetitive_texts_are_compared_once():
    r = random.Random(5)
    lines = [sentence(r, 12) for _ in range(6)]
    a = sd.shingles(sd.split(" ".join(r.choice(lines) for _ in range(400))))
    b = sd.shingles(sd.split(" ".join(r.choice(lines) for _ in range(400))))
    import time

    start = time.time()
    sd.passages(a, sd.Target(b, 46), list(range(0, len(a), 40)))
    assert time.time() - start < 5


def test_equal_stretches():
    r = random.Random(7)
    x, y = sentence(r, 60), sentence(r, 30)
    a, b = (sd.shingles(sd.split(t)) for t in (f"{y} {x} {sentence(r, 20)} {x}", f"{sentence(r, 9)} {x} {y}"))
    assert [(i, j + 4, p, q + 4) for i, j, p, q in sd._equal(a, sd.Target(b, 46))] == [(30, 89, 9, 68), (110, 169, 9, 68)]


def test_equal_passages_meet_whatever_the_first_rows_hold(spark):
    r = random.Random(11)
    lines = [sentence(r, 30) for _ in range(24)]
    body = lambda: sentence(r, 60)
    texts = [(i, f"{body()} {line} {body()}") for i, line in enumerate(lines)]
    pairs = [(x, x + 1) for x in range(0, 23)] + [(x, x + 5) for x in range(0, 18)]
    for n, (x, y) in enumerate(pairs):
        texts += [(100 + n, f"{body()} {lines[x]} {lines[y]} {body()}"), (200 + n, f"{body()} {lines[x]} {lines[y]} {body()}")]
    got = {x.doc_id: x for x in sd.documents_with_passages(frame(spark, texts)).collect()}
    stretches = {i: {tuple(w[a : a + 50]) for a in range(len(w) - 49)} for i, w in ((i, t.split()) for i, t in texts)}
    for n in range(len(pairs)):
        assert stretches[100 + n] & stretches[200 + n]
        assert got[200 + n].class_id == 100 + n and got[200 + n].duplicate_words >= 60, n


def test_passages_beside_text_that_the_other_has_elsewhere():
    for seed in range(20):
        r = random.Random(seed)
        passage, line = sentence(r, 80), sentence(r, 40)
        changed = passage.split()
        changed[40] = "changed"
        texts = [f"{passage} {line} {sentence(r, 30)}", f"{line} {sentence(r, 70)} {' '.join(changed)}"]
        for x, y in (texts, texts[::-1], (f"{sentence(r, 20)} {line} {passage} {line}", f"{' '.join(changed)} {sentence(r, 90)} {line}")):
            a, b = (sd.shingles(sd.split(t)) for t in (x, y))
            start = x.split().index((passage if passage in x else " ".join(changed)).split()[0])
            places = sorted({int(np.argmin(sd.minhash(a[start : start + 76], f))) + start for f in range(4)})
            got = sd.passages(a, sd.Target(b, 46), [c for c in places if a[c] in b])
            assert got and max(j - i + 1 for i, j, _, _ in got) >= 75, (seed, got)


def test_passages_at_the_threshold_are_found(spark):
    """One changed word in 54 (0.818), in 60 (0.836) and two in 110; equal passages of two lines that earlier documents hold one by one."""
    r = random.Random(21)
    body = lambda: sentence(r, 60)
    texts, n = [], 0
    for length, edits in ((54, 1), (60, 1), (110, 2)):
        for _ in range(60):
            base = sentence(r, length).split()
            own = list(base)
            for at in r.sample(range(6, length - 6), edits):
                own[at] = "changed"
            texts += [(1000 + n, f"{body()} {' '.join(base)} {body()}"), (5000 + n, f"{body()} {' '.join(own)} {body()}")]
            n += 1
    lines = [sentence(r, 28) for _ in range(40)]
    texts += [(i, f"{body()} {x} {body()}") for i, x in enumerate(lines)]
    texts += [(m * 1000 + i, f"{body()} {lines[i]} {lines[i + 1]} {body()}") for i in range(39) for m in (20, 30)]
    got = {x.doc_id: x for x in sd.documents_with_passages(frame(spark, texts)).collect()}
    assert sum(got[5000 + i].class_id == 1000 + i for i in range(n)) >= 0.95 * n
    assert all(got[30000 + i].class_id == got[20000 + i].class_id and got[30000 + i].duplicate_words >= 56 for i in range(39))
    assert all(got[i].class_id == i and got[i].n_passages == 0 for i in range(40))


def test_results_do_not_depend_on_how_files_are_split(spark, tmp_path):
    r = random.Random(6)
    line, passage = sentence(r, 9), sentence(r, 70)
    texts = [(i, f"{sentence(r, 30)}\n{line if i % 3 else sentence(r, 9)}\n{sentence(r, 20)} {passage if i % 5 == 0 else ''}") for i in range(200)]
    frame(spark, texts).repartition(20).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    seen = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append([sorted((x.doc_id, x.text) for x in f(docs).collect()) for f in (line_dedup.remove_lines, sd.remove_passages)])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and seen[0][0] != sorted(texts)


def test_places_without_room_are_not_tried_on_diagonals(monkeypatch):
    """A shingle that repeats in the other text is tried on the diagonal of every place, but only where enough matches stand around it."""
    r = np.random.default_rng(5)
    for _ in range(300):
        hit = r.random(int(r.integers(1, 150))) < r.choice([0.3, 0.8, 0.9])
        c = int(r.integers(len(hit)))
        hit[c] = True
        over = [0.0, *(np.cumsum(hit - 0.8) + 1e-9 * np.arange(1, len(hit) + 1))]
        want = max((j - i, -i) for i in range(c + 1) for j in range(c + 1, len(hit) + 1) if over[j] >= over[i])
        assert sd.longest(hit, c, 0.8) == (-want[1], want[0] - want[1] - 1)
    tried = []
    monkeypatch.setattr(sd, "nearby", lambda *a, f=sd.nearby: tried.append(1) or f(*a))
    a, b = r.integers(1, 1 << 60, 300).astype(np.uint64), r.integers(1, 1 << 60, 4000).astype(np.uint64)
    b[::20] = a[150]
    assert sd.passages(a, sd.Target(b, 46), [150]) == [] and not tried
    b[1000:1046] = a[130:176]
    b[1002] = b[1012] = b[1032] = b[1043] = 0
    assert sd.passages(a, sd.Target(b, 46), [150]) and tried


def _windows(rng, n: int) -> list[np.ndarray]:
    """Shingles of windows around one shingle (7): some repeat a few, some have many of their own, and some are edited copies."""
    common, out = rng.integers(100, 1 << 20, 140), []
    for i in range(n):
        if i % 3 == 0:
            a = np.tile(np.concatenate([rng.integers(100, 1 << 20, 10), common[:10]]), 7)
        else:
            a = np.where(rng.random(140) < (0.02, 0.1, 0.15, 0.3)[i % 4], rng.integers(100, 1 << 20, 140), common)
        a[70] = 7
        if i % 5 == 4:
            a = np.concatenate([common[rng.integers(0, 60) :][:50], a])  # alike or equal away from the anchor
        out.append(a.astype(np.uint64))
    return out


def test_windows_that_cannot_be_alike_are_not_compared():
    rng = np.random.default_rng(5)
    around = _windows(rng, 60)
    anchor = np.array([int(np.flatnonzero(a == 7)[0]) for a in around])
    known, others = sd.Windows(around, anchor), np.arange(60)
    numbers, owner = known.number, np.repeat(others, known.size)
    asked = found = 0
    for x in range(60):
        near = set(known.alike(x, others, numbers, owner, 46, 0.8).tolist())
        for y in range(60):
            a, b = max(x, y), min(x, y)
            if x != y and sd.passages(around[a], sd.Target(around[b], 46), [int(anchor[a])]):
                assert y in near
                found += 1
        asked += len(near - {x})
    assert 200 < found and asked < 60 * 59 / 4


def test_groups_of_repeating_windows_are_told_apart_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    around = [w for i, w in enumerate(_windows(rng, 90)) if i % 3 == 0 and i % 5 != 4]
    n = len(around)
    calls, old = [], sd.passages
    monkeypatch.setattr(sd, "passages", lambda *a, **k: calls.append(1) or old(*a, **k))
    zeros = np.zeros(n, dtype=np.int32)
    batch = pa.RecordBatch.from_pydict({"key": zeros.astype(np.int64), "i": zeros, "j": zeros, "part": zeros, "row": np.arange(n), "root": np.arange(n), "c": zeros + 70, "anchor": zeros + 70, "around": [w.astype(np.uint32).tobytes() for w in around], "miss": [True] * n, "apart": [True] * n})
    assert sd.compared(batch, 50, 5, 0.8) == [] and not calls


def test_words_are_hashed_together(monkeypatch):
    """Short words of many texts by one run of numpy, none by the dictionary; the same hashes and shingles as one by one."""
    rng = random.Random(9)
    parts = ["a", "B", "é", "中", "\U0001f600", " ", "\n", "\t", "\x0b", "\x0c", "\r", " ", " ", "wxyz" * 2, "q" * 31, "q" * 32, "Long" * 30]
    ts = ["", " ", "one", "a b c d e", *("".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(300)), "w " * 90_000, "end of it all now"]
    want = [sd.shingles(sd.split(t)) for t in ts]
    hashes = [[sd._words[w] for w in sd.split(t)] for t in ts]
    monkeypatch.setattr(sd, "_words", None)
    assert [sd.word_hashes(t.encode().lower())[1].tolist() for t in ts] == hashes
    got = list(sd.shingled_texts(t.encode().lower() for t in ts))
    assert len(got) == len(ts) and all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))


def test_growth_by_runs():
    """Runs of matches and mismatches give the stretch that the score by places gives."""

    def reach(h, penalty, drop):
        total = best = 0
        place = -1
        for i, x in enumerate(h):
            total += 1 if x else -penalty
            if total > best:
                best, place = total, i
            if best - total > drop:
                break
        return place + 1

    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 255, 256, 257, 700, 5000):
        for share in (0.0, 0.5, 0.8, 0.9, 0.97, 1.0):
            hit = rng.random(n) < share
            for c in {0, n // 2, n - 1}:
                for penalty, drop in ((sd.PENALTY, sd.DROP), sd.STRICT):
                    assert sd.grow(hit, c, penalty, drop) == (c - reach(hit[:c][::-1], penalty, drop), c + reach(hit[c + 1 :], penalty, drop))
