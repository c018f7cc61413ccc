"""Groups of spelling variants: a trie self-join with active-node sets over a vocabulary.

Two words are near if one inserted, deleted or replaced code point makes one of the other. A trie of the vocabulary
is joined with itself from the root down: the active nodes of a node are those within one edit of it, and the active
nodes of its children follow from them. Next to itself these are its siblings (a replaced code point), its children
(an inserted one), and whatever follows from the active nodes of its parent by the same code point. Where two
active nodes both end a word, the words are near. A level of the trie is one step of numpy over all its nodes.

The trie is partitioned by prefixes. A pair whose edit lies behind the first half of the longer word shares the
prefix before it, and meets in that prefix's trie; the others share the suffix of the other half, and meet in the
trie of what stands before it. Where a trie holds more than ``MOST`` words, the half in which its edits lie is cut in
two again, at most as often as lengths have bits: at the end words differ at one known place, and a trie
has no more of them than there are letters. Every pair is found once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import drop_written, give_back, small_batches, texts, wide_batches, written
from stratagraph.shipping import ship

#: Fixed by the contract: runs of these letters, of which only A-Z are lower-cased (in Latin-1, where each is one byte).
RUNS = re.compile(rb"[a-z\xc0-\xff]+")
#: Different words that a task counts before it passes the counts on.
COUNTED = 300_000
#: Words in one trie, beyond which it is cut in two.
MOST = 50_000
#: Code points of words that a task takes into its tries at a time, beyond one trie.
HELD = 2_000_000
#: Above every code point.
SIGMA = 1 << 21


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, typo_every: int = 97) -> DataFrame:
    """``word, n``: the runs of letters in whole texts that occur ``least_count`` times and have ``least_chars`` code points.

    Where ``typo_every`` (0: never) divides the CRC-32 of ``<id>:<run>``, the run loses the code point whose place is the
    CRC-32 modulo the run's length. A null text has no runs; a null id is written as the empty text; every row of
    a repeated id counts.
    """
    spark = docs.sparkSession
    least = re.compile(RUNS.pattern[:-1] + b"{%d,}" % least_chars)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            kept = {w: n for w, n in counts.items() if n and len(w) >= least_chars}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(texts(batch, "doc"), texts(batch), strict=True):
                # letters beyond Latin-1 become question marks, which end a run as they did
                latin = text.encode("latin-1", "replace").lower()
                runs = least.findall(latin)
                counts.update(runs)
                if typo_every:
                    head = crc32(f"{doc}:".encode())
                    if latin.isascii():
                        hit = [(w, h) for w in set(runs) if not (h := crc32(w, head)) % typo_every]
                    else:
                        hit = [(w, h) for w in set(runs) if not (h := crc32(w if w.isascii() else w.decode("latin-1").encode(), head)) % typo_every]
                    for w, h in hit:
                        n, at = runs.count(w), h % len(w)
                        counts[w] -= n
                        counts[w[:at] + w[at + 1 :]] += n
                if len(counts) > COUNTED:
                    yield passed_on()
        yield passed_on()
        give_back()

    small_batches(spark)
    ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _matched(u: np.ndarray, v: np.ndarray, first: np.ndarray, edges_u: np.ndarray, edges_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of active pairs by the same code point. Edges are sorted numbers ``parent * SIGMA + code point``."""
    many = first[u + 1] - first[u]
    of = np.repeat(np.arange(len(u)), many)
    child = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[u][of]
    want = v[of] * SIGMA + edges_u[child] % SIGMA
    at = np.searchsorted(edges_v, want)
    ok = np.flatnonzero(edges_v[np.minimum(at, len(edges_v) - 1)] == want) if len(edges_v) else np.zeros(0, np.int64)
    return child[ok], at[ok]


def _siblings(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of one parent; ``parent`` ascends. A parent has no more children than there are letters."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.arange(len(parent))
    step = 1
    while len(at := at[at + step < len(parent)]) and len(at := at[parent[at] == parent[at + step]]):
        u.append(at)
        v.append(at + step)
        step += 1
    return np.concatenate(u), np.concatenate(v)


def near_rows(roots: np.ndarray, codes: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose words differ by one edit in tries under ``roots`` (numbers from 0): ``a, b`` of equal length, and ``short, longer``.

    ``codes`` has the code points of the words, as many as columns for ``long`` rows and one fewer for the others,
    whose last column is not read. Rows of one root and length are different words.
    """
    width, none = codes.shape[1], np.zeros(0, np.int64)
    node, n_nodes = roots, int(roots.max(initial=-1)) + 1
    has_short = np.bincount(node[~long], minlength=n_nodes) > 0
    level = inserted = (none, none)
    before_edges = before_first = ended = before_nodes = None
    for k in range(width):
        rows = np.arange(len(roots)) if k < width - 1 else np.flatnonzero(long)
        edges, to = np.unique(node[rows] * SIGMA + codes[rows, k], return_inverse=True)
        parent = edges // SIGMA
        first = np.searchsorted(parent, np.arange(n_nodes + 1))
        leads_long = np.bincount(to[long[rows]], minlength=len(edges)) > 0
        # a word with an inserted code point is one level deeper than its active node
        deeper = np.flatnonzero(leads_long & has_short[parent])
        u, v = (none, none) if before_edges is None else _matched(*inserted, before_first, before_edges, edges)
        ok = has_short[u] & leads_long[v]
        both = np.unique(np.concatenate([u[ok], parent[deeper]]) * (len(edges) + 1) + np.concatenate([v[ok], deeper]))
        inserted = both // (len(edges) + 1), both % (len(edges) + 1)
        # replaced code points: nodes of one level
        u, v = _matched(*level, first, edges, edges)
        su, sv = _siblings(parent)
        u, v = np.concatenate([u, su]), np.concatenate([v, sv])
        ok = leads_long[u] & leads_long[v]
        level = u[ok], v[ok]
        before_nodes, ended = node, n_nodes
        before_edges, before_first = edges, first
        node = np.zeros(len(roots), np.int64)
        node[rows] = to
        n_nodes = len(edges)
        has_short = np.bincount(to[~long[rows]], minlength=n_nodes) > 0
    long_at, short_at = np.full(n_nodes, -1), np.full(ended, -1)
    long_at[node[long]] = np.flatnonzero(long)
    short_at[before_nodes[~long]] = np.flatnonzero(~long)
    return long_at[level[0]], long_at[level[1]], short_at[inserted[0]], long_at[inserted[1]]


def _joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near pairs in whole tries; rows are sorted by ``size, head, tail, key``."""
    key = rows.column("key").to_numpy()
    same = np.diff(key) == 0
    alone = ~(np.append(same, False) | np.insert(same, 0, False))
    rows = rows.filter(pa.array(~alone))
    if not rows.num_rows:
        return
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    sizes = np.stack([rows.column(c).to_numpy() for c in ("size", "head", "tail")], axis=1)
    ends = [*(np.flatnonzero(np.any(np.diff(sizes, axis=0), axis=1)) + 1).tolist(), len(key)]
    start = 0
    for end in ends:
        size, head, tail = sizes[start].tolist()
        word = rows.column("word").slice(start, end - start).to_pylist()
        codes = np.array(word, dtype=f"U{size}").view(np.uint32).reshape(len(word), size).astype(np.int64)
        long = codes[:, -1] != 0
        roots = np.concatenate([[0], np.cumsum(np.diff(key[start:end]) != 0)])
        a, b, short, longer = near_rows(roots, codes[:, head : size - tail], long)
        # an inserted code point may have several places, say one of two equal letters: the last one decides
        cut = size - tail
        ok = np.array([not tail or word[i][:cut] != word[j][:cut] for i, j in zip(short.tolist(), longer.tolist(), strict=True)], bool)
        a, b = np.concatenate([a, short[ok]]), np.concatenate([b, longer[ok]])
        if len(a):
            held, own = pa.array(word), n[start:end]
            yield pa.RecordBatch.from_arrays([held.take(pa.array(np.concatenate([a, b]))), held.take(pa.array(np.concatenate([b, a]))), pa.array(own[np.concatenate([b, a])])], names=["word", "near", "n"])
        start = end


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    chars = 0
    for batch in batches:
        held.append(batch)
        chars += int(batch.column(batch.schema.get_field_index("size")).to_numpy().sum())
        if chars < HELD:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        cut = np.flatnonzero(np.diff(rows.column("key").to_numpy()) != 0)
        if len(cut):
            yield from _joined(rows.slice(0, int(cut[-1]) + 1))
            rows = rows.slice(int(cut[-1]) + 1)
            held, chars = rows.to_batches(), int(rows.column("size").to_numpy().sum())
    if held:
        yield from _joined(pa.Table.from_batches(held).combine_chunks())
    give_back()


def _halved(rows: DataFrame) -> DataFrame:
    """Each trie as two: of edits in the second half of where they may lie, and in the first."""
    middle = F.col("head") + F.floor((F.col("size") - F.col("tail") - F.col("head")) / 2)
    halves = F.array(F.struct(middle.cast("int").alias("head"), F.col("tail")), F.struct(F.col("head"), (F.col("size") - middle).cast("int").alias("tail")))
    rows = rows.withColumn("half", F.explode(halves)).select("word", "n", "size", "half.head", "half.tail")
    return rows.withColumn("key", F.xxhash64("size", "head", "tail", F.substr("word", F.lit(1), F.col("head")), F.right("word", F.col("tail"))))


def near_words(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """``word, near, n`` (of the near word), both ways, of all words of ``vocabulary`` (``word, n``) one edit apart.

    Words are different, not null and not empty. ``vocabulary`` is read several times and is best a written table.
    """
    spark = vocabulary.sparkSession
    # a word meets words as long as itself, and as one of the shorter ones those that are longer by one
    sized = vocabulary.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    rows = _halved(sized.withColumn("head", F.lit(0)).withColumn("tail", F.lit(0)))
    while True:
        large = rows.where("size - head - tail > 1").groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > most).select("key")
        large = written(large, "large")
        if large.isEmpty():
            drop_written(large)
            break
        again = written(_halved(rows.join(large, "key", "left_semi").drop("key")).unionByName(rows.join(large, "key", "left_anti")), "halved")
        drop_written(large)
        rows = again
    ship(spark)
    with wide_batches(spark, 1 << 14):
        return rows.repartition("key").sortWithinPartitions("size", "head", "tail", "key").mapInArrow(_tries, "word string, near string, n long")


def roots(links: DataFrame) -> DataFrame:
    """``word, root``: the last form from each word of ``links`` (``word, form``, without circles), by doubling steps."""
    now = written(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        after = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        after = written(after.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "forms")
        drop_written(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word: its most frequent near word if that is twice as frequent, and the last of those.

    Of equally frequent near words the first in code-point order is the form. A word that is near none, or only rarer
    ones, has no form and is its own root. ``vocabulary`` has ``word, n``; an empty one gives no rows.
    """
    vocabulary = written(vocabulary.select("word", "n"), "vocabulary")
    best = near_words(vocabulary, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("n"), F.col("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    formed = vocabulary.join(best, "word", "left").withColumn("has", F.col("near_n") >= 2 * F.col("n"))
    formed = written(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("near")).alias("form"), F.when(F.col("has"), F.col("near_n")).alias("form_n")), "formed")
    drop_written(vocabulary)
    last = roots(formed.where("form IS NOT NULL"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_BYTES = "flatten(list_transform(range(1, length({0})+1), lambda i: CASE WHEN ord(substr({0}, i, 1)) < 128 THEN [ord(substr({0}, i, 1))::BIGINT, -1,-1,-1,-1,-1,-1,-1,-1] ELSE [195, -1,-1,-1,-1,-1,-1,-1,-1, ord(substr({0}, i, 1)) - 64, -1,-1,-1,-1,-1,-1,-1,-1] END))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, " + _BYTES + "), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"

ORACLE_SQL = f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT w, d || ':' || w AS k, count(*) AS c FROM r WHERE length(w) >= 5 GROUP BY ALL),
h AS (SELECT w, c, {_CRC.format("k")} AS h FROM g),
t AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, c FROM h),
v AS MATERIALIZED (SELECT w, sum(c)::BIGINT AS n FROM t WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
p AS (SELECT w, n, unnest(range(1, length(w)+1)) AS i FROM v),
m AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i-1) AS l, substr(w, i+1) AS r FROM p),
near AS (SELECT a.w, b.w AS o, b.n FROM m a JOIN m b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.w <> b.w
  UNION SELECT m.w, v.w, v.n FROM m JOIN v ON v.w = m.l || m.r UNION SELECT v.w, m.w, m.n FROM m JOIN v ON v.w = m.l || m.r),
best AS (SELECT w, count(*) AS k, max(n) AS top FROM near GROUP BY w),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(k, 0) AS k, CASE WHEN top >= 2 * v.n THEN (SELECT min(o) FROM near x WHERE x.w = v.w AND x.n = top) END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN best b ON b.w = v.w),
chain AS (SELECT w, w AS here FROM f UNION ALL SELECT c.w, f.form FROM chain c JOIN f ON f.w = c.here WHERE f.form IS NOT NULL)
SELECT f.w AS word, form, here AS root, n, k::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN (SELECT c.w, c.here FROM chain c JOIN f ON f.w = c.here WHERE f.form IS NULL) e ON e.w = f.w
"""
