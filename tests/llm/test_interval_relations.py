"""Interval relations against the pairs themselves, and sessions against a plain walk."""

import datetime
import random
import zlib
from collections import defaultdict

import pytest

from stratagraph.llm import interval_relations as ir

FAR = 1 << 40
EPOCH = datetime.datetime(1970, 1, 1)
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, id string, key string"
LINES = "sale_id long, shipped_at timestamp_ntz, first string"
CLICKS = "client_id long, ts timestamp_ntz, kind string, us string, open string"


def brute(asking, asked):
    out = defaultdict(lambda: [0, 0, 0])
    for i, k, s, e in asking:
        for k2, a, b, crc in asked:
            if None in (k, s, k2, a) or k != k2:
                continue
            e1, b1 = FAR if e is None else e, FAR if b is None else b
            if e1 < s or b1 < a or a > e1 or s > b1:
                continue
            at = (0 if s < a else 3 if s == a else 6) + (0 if e1 < b1 else 1 if e1 == b1 else 2)
            row = out[i, ir.RELATIONS[at]]
            row[0] += 1
            row[1] = None if e is None and b is None else row[1] + min(e1, b1) - max(s, a) + 1
            row[2] += crc
    return sorted((*k, *v) for k, v in out.items())


def found(df):
    assert df.columns == ["id", "relation", "n_pairs", "overlap_slots", "crc"]
    return sorted(tuple(r) for r in df.collect())


def frames(spark, asking, asked):
    return spark.createDataFrame(asking, "id long, key long, first long, last long"), spark.createDataFrame(asked, "key long, first long, last long, crc long")


@pytest.mark.parametrize("seed,spread", [(1, 6), (2, 40)])
def test_relations_equal_pairs(spark, seed, spread):
    """Ties of every kind, nulls, open ends, backward intervals, repeats and negative slots."""
    r = random.Random(seed)
    span = lambda: (s := r.randrange(-3, spread), r.choice([None, s, s + r.randrange(6), s + r.randrange(spread), s - 1]))
    key = lambda: r.choice([0, 0, 1, 2, 5, None])
    asking = [(i, key(), *span()) for i in range(200)] + [(900, 0, None, 3), (901, 7, 1, 2)]
    asked = [(key(), *span(), r.randrange(1 << 32)) for _ in range(150)]
    asked += asked[:20] + [(0, None, 4, 1)]
    assert found(ir.relations(*frames(spark, asking, asked))) == brute(asking, asked)


def test_key_of_most_rows_is_split(spark):
    """One key has nearly all questions; its groups are copied, every question is answered once."""
    asking = [(i, 3 if i % 50 else i % 7, i % 41, None if i % 9 == 0 else i % 41 + i % 13) for i in range(12_000)]
    asked = [(3, a, a + a % 3, a + 1) for a in range(40)] + [(3, 5, None, 9), (1, 2, 8, 4)]
    got = found(ir.relations(*frames(spark, asking, asked)))
    assert got == brute(asking, asked)


def test_empty_sides(spark):
    some, none = [(1, 1, 2, 3)], []
    assert found(ir.relations(*frames(spark, none, [(1, 2, 3, 4)]))) == []
    assert found(ir.relations(*frames(spark, some, none))) == []


def walked(clicks, gap=10):
    by = defaultdict(lambda: defaultdict(bool))
    for c, ts, kind, *_ in clicks:
        if c is not None and ts is not None:
            by[c][(ts - EPOCH) // datetime.timedelta(microseconds=1)] |= kind == "purchase"
    out = []
    for c, marks in by.items():
        first = prev = None
        for us in sorted(marks):
            if prev is None or us - prev > gap * 60_000_000:
                if first is not None:
                    out.append((c, first, prev, marks[prev]))
                first = us
            prev = us
        out.append((c, first, prev, marks[prev]))
    return sorted(out)


def test_sessions_equal_a_walk(spark):
    """Gaps of exactly ten minutes and one microsecond more, runs over days, times before 1970, nulls, repeats."""
    r, start, clicks = random.Random(3), datetime.datetime(2024, 1, 1, 23, 50), []
    for c in (1, 2, 3):
        at = start
        for _ in range(900):
            at += r.choice([datetime.timedelta(minutes=10), datetime.timedelta(minutes=10, microseconds=1 if r.random() < 0.02 else 0), datetime.timedelta(seconds=r.randrange(500)), datetime.timedelta(hours=r.randrange(1, 30) if r.random() < 0.05 else 0)])
            clicks.append((c, at, r.choice(["purchase", "view", None]), "x", None))
    clicks += [(4, EPOCH - datetime.timedelta(minutes=m), "purchase", None, None) for m in (0, 5, 16, 2000)]
    clicks += [(None, start, "view", None, None), (5, None, "purchase", None, None)] + clicks[:30]
    df = spark.createDataFrame(clicks, CLICKS)
    got = sorted(tuple(x) for x in ir.sessions(df).select("client", "first", "last", "open").collect())
    assert got == walked(clicks)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sorted(tuple(x) for x in ir.sessions(df).collect()) == got
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sales_and_sessions(spark):
    """The whole query on broken rows: sales without client, time or lines, lines without sale, shipped before sold."""
    r, day = random.Random(4), datetime.datetime(2024, 2, 1)
    when = lambda hours: day + datetime.timedelta(seconds=r.randrange(3600 * hours))
    sales = [(i, r.choice([1, 2, None]), r.choice([None, *[when(200)] * 6]), "a", "b") for i in range(60)]
    lines = [(r.choice([None, *range(50)]), r.choice([None, *[when(300)] * 9]), "c") for _ in range(120)]
    clicks = [(r.choice([1, 2, 3, None]), when(200), r.choice(["purchase", "view", None]), "d", "e") for _ in range(400)]
    hour = lambda us: us // 3_600_000_000
    us = lambda t: (t - EPOCH) // datetime.timedelta(microseconds=1)
    asking = []
    for i, c, at, *_ in sales:
        own = [x for s, x, _ in lines if s == i]
        if c is not None and at is not None:
            asking.append((i, c, hour(us(at)), None if None in own else hour(us(max([at, *own])))))
    asked = [(c, hour(a), None if is_open else hour(b), zlib.crc32(b"%d" % a)) for c, a, b, is_open in walked(clicks)]
    got = ir.sale_session_relations(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), spark.createDataFrame(clicks, CLICKS))
    assert found(got) == brute(asking, asked)
