"""Base spans against Python's regular expressions, the battery against its formulas, the whole against planted keys."""

import base64
import hashlib
import math
import random
import re

from stratagraph.llm import secret_scan as ss

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, pattern, ok) in enumerate(BASE) for m in pattern.finditer(text or "") if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(spans)]


def rows(df, id_col="doc_id"):
    assert df.columns == [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
    return df.collect()


def test_base_spans(spark):
    """Short second groups, matches inside matches, runs at both ends, letters of any plane, nulls, repeats, a text of over a megabyte."""
    r = random.Random(1)
    bits = ["password", "PASSWD", "ſecret", "secret", "Token", "api_key", "apikey", "'", '"', " ", "  ", "\t", ":", "=", ": ", "abc", "abcdef", "ab.c-d_e=f/", "AKIA", "AKIA" + "Z9" * 8, "AKIAAKIA" + "Q" * 11, "deadbeef" * 3, "0123456789abcdef", "é", "\U0001f600", "\n", "K", "token=token:abcdefgh"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(400)]
    texts += [None, "", "token=abcdef", "deadbeef" * 3, ("word " * 50 + "passwd: zzzzzzzz ") * 5000, texts[3], texts[3]]
    data = [(i if i % 9 else None, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, row long, spans string")
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in rows(ss.scan(df)))
    want = []
    for i, t, *_ in data:
        spans = base(t)
        n = [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        want.append((-1 if i is None else i, *n, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert got == sorted(want)


def battery(run, symbols):
    v = [symbols.index(c) for c in run.rstrip("=")]
    n, k = len(v), len(symbols)
    upper = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((v.count(s) - n / k) ** 2 for s in range(k)) / (n / k)
    var = 2 * (k - 1) * (n - 1) / n
    ninth = var / (9 * (k - 1) ** 2)
    even = upper(((chi / (k - 1)) ** (1 / 3) - (1 - ninth)) / math.sqrt(ninth))
    high = [x >= k // 2 for x in v]
    a, seen = sum(high), 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 2 * a * (n - a) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 2 * upper(abs(seen - mean) / math.sqrt(spread)) if spread > 0 else ss.LEAST_P
    m = sum(v) / n
    around = sum((x - m) ** 2 for x in v)
    serial = 2 * upper(abs(sum((x - m) * (y - m) for x, y in zip(v, v[1:], strict=False)) / around + 1 / n) * math.sqrt(n)) if around else ss.LEAST_P
    p = [min(max(x, ss.LEAST_P), 1) for x in (even, runs, serial)]
    x = -sum(map(math.log, p))
    return (*p, math.exp(-x) * (1 + x + x * x / 2))


def test_battery(spark):
    r, of = random.Random(2), {name: symbols for name, symbols, _ in ss.ENCODINGS}
    data = [("".join(r.choice(s) for _ in range(r.randrange(20, 90))) + "=" * r.randrange(3), name) for name, s in of.items() for _ in range(20)]
    data += [("a" * 30, "hex"), (of["hex"] * 3, "hex"), ("0" * 15 + "f" * 15, "hex"), ("theordinarytextofadocument", "base64"), ("ab" * 500, "base36")]
    for x in ss.battery(spark.createDataFrame(data, "value string, encoding string")).collect():
        for got, want in zip((x.p_even, x.p_runs, x.p_serial, x.p), battery(x.value, of[x.encoding]), strict=True):
            assert abs(got - want) < 2e-6, x


def test_encodings(spark):
    runs = {"0123456789abcdef": "hex", "0123456789ABCDEF": "HEX", "XYZ234": "base32", "abz9": "base36", "ABZ19": "BASE36", "aB9==": "base64", "aB+/": "base64", "aB_-": "base64url", "a+b_": None, "2024": None, "a/b-c": None}
    df = spark.createDataFrame(list(runs), "string")
    assert {x[0]: x[1] for x in df.select("value", ss.encoding(df["value"])).collect()} == runs


def test_keys_are_told_from_text(spark):
    """Keys without any word before them are found; long words, paths and identifiers of ordinary words are not."""
    r = random.Random(3)
    letters, weights = zip(*{"e": 12, "t": 9, "a": 8, "o": 7, "i": 7, "n": 7, "s": 6, "h": 6, "r": 6, "d": 4, "l": 4, "u": 3, "c": 3, "m": 2, "w": 2, "f": 2, "g": 2, "y": 2, "p": 2, "b": 1}.items(), strict=True)
    word = lambda: "".join(r.choices(letters, weights, k=r.randrange(2, 9)))
    data, keys, plain = [], {}, {}
    for i in range(400):
        text = " ".join(word() for _ in range(80)) + " "
        key = base64.b64encode(r.randbytes(r.choice([24, 32, 48]))).decode()
        name = "".join(word().title() for _ in range(9)) + "2"
        plain[i] = (len(text), len(text) + len(name))
        text += name + " and "
        if i % 2:
            keys[i] = f"random:{len(text)}:{len(text) + len(key)}"
            text += key + " end"
        data.append((i, text))
    found = {x.doc_id: x.spans.split(",") for x in rows(ss.scan(spark.createDataFrame(data, "doc_id long, text string")))}
    hit = sum(k in found[i] for i, k in keys.items())
    wrong = sum(f"random:{a}:{b}" in found[i] for i, (a, b) in plain.items())
    assert hit >= 0.9 * len(keys) and wrong <= 0.1 * hit, (hit, wrong)


def test_keys_beside_base_spans(spark):
    """A run that a fixed pattern covers in part is no span of its own."""
    text = 'token = "' + "0123456789abcdef" * 2 + '" rest'
    (x,) = rows(ss.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert x.spans.split(",") == base(text) and x.n_random == 0


def test_no_documents(spark):
    assert rows(ss.scan(spark.createDataFrame([], "`a.b` long, text string"), id_col="a.b"), "a.b") == []
