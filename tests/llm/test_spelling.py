"""Spelling variants against all pairs, words against a plain count."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from stratagraph.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, every=97):
    out = Counter()
    for doc, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def cut(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in cut(max(a, b, key=len))


def grouped(counts):
    out, forms = {}, {}
    found = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(found[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, len(found[w]), counts.get(forms[w]))
    return out


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("letters,most", [("ab", 50_000), ("ab", 3), ("abcdeé÷一\U0001f600", 50_000), ("abcdeé", 5)])
def test_variants_equal_all_pairs(spark, letters, most):
    """Repeated letters, letters of any plane, words of one letter and very long ones, chains, ties; tries cut until one place is left."""
    r = random.Random(len(letters) + most)
    names = {"".join(r.choice(letters) for _ in range(r.randrange(1, 8))) for _ in range(500)}
    names |= {"a" * k for k in (1, 2, 9, 10, 11)} | {"b" * 2_000, "b" * 2_001, "b" * 1_999 + "a", "z" + "b" * 2_000}
    counts = {w: r.choice([3, 3, 4, 7, 20, 41, 90]) for w in names}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(spelling.variants(df, most)) == grouped(counts)


def test_words_of_broken_documents(spark):
    """Null and empty texts, null and repeated ids, letters beyond Latin-1, capitals that stay, one text of over a megabyte, extra columns."""
    r = random.Random(5)
    stems = ["Garten", "École", "écoles", "straße", "cafēs", "Worlds", "×÷×÷×", "abcd", "naïvés", "ZEBRA_crossing"]
    text = lambda n: " ".join(r.choice(stems) + r.choice(["", "s", "!", "あ"]) for _ in range(n))
    rows = [(i if i % 7 else None, text(40), 1, "x") for i in range(300)] + [(500, None, 2, "y"), (501, "", 3, None), (502, text(150_000), 4, "z"), (3, text(9), 5, "x"), (3, text(9), 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, word string")
    got = {x.word: x.n for x in spelling.words(df).collect()}
    assert got == counted(rows) and any(w for w in got if w not in counted(rows, 0))
    assert {x.word: x.n for x in spelling.words(df, typo_every=0).collect()} == counted(rows, 0)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.words(empty)).count() == 0
