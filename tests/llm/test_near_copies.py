"""Near copies of the pipeline against brute force."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from stratagraph.llm import near_copies as nc, simhash
from stratagraph.llm.substring_dedup import split


def test_near_copies_equal_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    texts = []
    for n in (20, 30, 60, 120, 300):
        for _ in range(12):
            base = [word() for _ in range(n)]
            for edits in (0, 0, n // 60, n // 45, n // 30):  # up to and below 0.8
                own = list(base)
                for at in r.sample(range(n), edits):
                    own[at] = word()
                texts.append(" ".join(own).upper() if r.random() < 0.2 else " ".join(own))
    texts += ["", None, "x", "X", "a b c", "a b d"]
    r.shuffle(texts)
    sets = [nc.shingle_set(split(t or "")) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            s = nc.jaccard(sets[i], sets[j])
            linked += 0.8 <= s < 0.9
            if s >= 0.8 or not len(sets[i]) + len(sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert linked >= 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.near_copies_out(spark, docs, "").collect()}
    assert got == {find(i) for i in range(len(texts))}


def test_stage_takes_pairs_of_the_fingerprints_index(spark, monkeypatch):
    """The stage's links come from SimHash's index too: without any band, texts within its distance still meet, each pair verified."""
    r = random.Random(3)
    base = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    near = [*base[:-1], "other"]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(reversed(base)))]
    distances = bin(simhash.simhash(rows[0][1], 5) ^ simhash.simhash(rows[1][1], 5)).count("1")
    assert distances <= simhash.DISTANCE
    monkeypatch.setattr(nc, "signed", lambda keyed, k, f=nc.signed: f(keyed, k).withColumn("bands", F.expr("cast(array() as array<long>)")))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.near_copies_out(spark, docs, "").collect()} == {1, 3}


def test_a_group_of_near_texts_sends_on_a_forest():
    """However many pairs of a band's group agree in their functions, fewer links leave it than it has rows, and all alike texts are connected."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = []
    for i in range(60):  # every other text is a near copy of the one before; other pairs are near, but under 0.8
        own = list(base if i % 2 == 0 else texts[-1])
        for at in r.sample(range(200), 6 if i % 2 == 0 else 2):
            own[at] = word()
        texts.append(own)
    words = [" ".join(t).encode().split() for t in texts]
    sets = [nc.shingle_set(w) for w in words]
    sig = [(nc.signature(s) >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
    n = len(texts)
    columns = {"i": [0] * n, "j": [0] * n, "c": [0] * n, "n": [0] * n, "b": [-1] * n, "row": range(n), "root": range(n), "sig": sig}
    batch = pa.RecordBatch.from_pydict(columns | {"packed": [zstandard.compress(b" ".join(w)) for w in words]})
    got = nc.compared(batch, nc.SHINGLE, nc.SIMILARITY)
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    alike = [(i, j) for i in range(n) for j in range(i) if nc.jaccard(sets[i], sets[j]) >= 0.8]
    agreeing = sum((np.frombuffer(sig[i], np.uint32) == np.frombuffer(sig[j], np.uint32)).mean() >= nc.AGREE for i in range(n) for j in range(i))
    assert agreeing > 10 * n and 0 < len(got) < n
    for a, b in got:
        assert (a, b) in alike and find(a) != find(b)
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in alike)
