"""SimHash fingerprints, and links between those that differ in few bits by a Gray-order hierarchical index.

Fingerprints that share a masked bit pattern stand under one upper node; two that differ in at most
d bits share at least one of d + 1 patterns over disjoint masks, so each such pair meets there. Below,
an index holds its fingerprints in Gray order, in which neighbours share most bits. Every node keeps
the bits that all below it have in common; a search adds up differing bits downwards and drops a
whole group once they pass d.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import map_rows, small_batches, texts, written
from stratagraph.llm.components import components
from stratagraph.shipping import ship

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of a group that one task searches; larger groups are dealt out in pairs of chunks.
CHUNK = 2048
FAN = 16


def simhash(text: str, k: int = SHINGLE) -> int:
    """64-bit fingerprint of a text: a bit is set if it is in over half of the shingles' hashes."""
    parts = text.encode().lower().split()  # bytes: A-Z and ASCII white space alone
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1
    ends = np.cumsum(sizes) - 1
    begins = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n - k + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        own = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``id_col, fp long``: the fingerprint's bits as a signed integer. Null texts are empty: 0."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        def step(batch):
            fp = np.array([simhash(t, k) for t in texts(batch)], dtype=np.uint64).view(np.int64)
            return {id_col: batch.column(0), "fp": pa.array(fp)}

        return step

    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, f"`{id_col}` {kind}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the Gray code: the number whose code it is."""
    x = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def build(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Fingerprints in Gray order, and levels of (mask, pattern) from the nodes above them to the root."""
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    levels = []
    every, some = fps, fps
    while len(every) > 1 or not levels:
        at = np.arange(0, len(every), FAN)
        every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
        mask = ~(every ^ some)
        levels.append((mask, every & mask))
    return fps, levels


def search(fps: np.ndarray, levels: list, queries: np.ndarray, d: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in ``queries``, place in ``fps``) that differ in at most d bits, for a block of queries at a time."""
    for at in range(0, len(queries), block):
        q = np.arange(at, min(at + block, len(queries)))
        node = np.zeros(len(q), dtype=np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            mask, pattern = levels[depth]
            near = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]) <= d
            q, node = q[near], node[near]
            below = len(levels[depth - 1][0]) if depth else len(fps)
            q = np.repeat(q, FAN)
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            q, node = q[node < below], node[node < below]
        near = np.bitwise_count(queries[q] ^ fps[node]) <= d
        yield q[near], node[near]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, least of its component) that connect what the given edges connect."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def group_links(left: np.ndarray, right: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one chunk (left is right) or between two, as a forest."""
    fps, levels = build(right)
    a, b = [], []
    for q, node in search(fps, levels, left, d):
        x, y = left[q], fps[node]
        keep = x != y
        if keep.any():
            x, y = forest(x[keep], y[keep])
            a.append(x)
            b.append(y)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(a), np.concatenate(b))


def masks(d: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of d + 1 disjoint masks over 64 bits."""
    edges = [round(i * 64 / (d + 1)) for i in range(d + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, d: int = DISTANCE) -> DataFrame:
    """``a, b``: links that connect all fingerprints (column ``fp``, distinct) that differ in at most d bits.

    Groups under an upper node of over CHUNK fingerprints are split by a hash of these; each pair of
    chunks is a task's group of its own.
    """
    spark = distinct.sparkSession
    pattern = F.array(*[F.struct(F.lit(i).alias("m"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << n) - 1)).alias("p")) for i, (lo, n) in enumerate(masks(d))])
    posted = distinct.select("fp", F.explode(pattern).alias("g")).select("fp", "g.m", "g.p")
    sizes = posted.groupBy("m", "p").count().where("count > 1").withColumn("k", F.ceil(F.col("count") / CHUNK).cast("int"))
    dealt = posted.join(sizes.select("m", "p", "k"), ["m", "p"]).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
    dealt = dealt.withColumn("g", F.explode(pairs)).select("m", "p", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "c", "fp")
    dealt = dealt.repartition("m", "p", "i", "j").sortWithinPartitions("m", "p", "i", "j", "c")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solved(table: np.ndarray, fp: np.ndarray):
        cut = np.flatnonzero((table[1:, :4] != table[:-1, :4]).any(axis=1)) + 1
        for rows in np.split(np.arange(len(fp)), cut):
            i, j = table[rows[0], 2], table[rows[0], 3]
            own, c = fp[rows], table[rows, 4]
            yield group_links(own, own, d) if i == j else group_links(own[c == i], own[c == j], d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_t, rest_f = np.zeros((0, 5), dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def out(table, fp):
            found = [x for x in solved(table, fp) if len(x[0])] if len(fp) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], schema=schema)

        for b in batches:
            t = np.concatenate([rest_t, np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)])
            f = np.concatenate([rest_f, b.column(5).to_numpy().view(np.uint64)])
            # the last group may go on in the next batch
            at = len(f) - int((t == t[-1])[:, :4].all(axis=1)[::-1].argmin()) if len(f) and not (t[:, :4] == t[-1, :4]).all() else 0
            yield from out(t[:at], f[:at])
            rest_t, rest_f = t[at:], f[at:]
        yield from out(rest_t, rest_f)

    small_batches(spark)
    ship(spark)
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, d: int = DISTANCE) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every document.

    Documents whose fingerprints differ in at most d bits are linked; the component is named by the
    smallest id that links reach. Null and empty texts have fingerprint zero and are linked like any
    other. A null id is never the name of a component that holds another id; rows that repeat fall
    into one component. Other columns are ignored.
    """
    found = written(fingerprints(docs, id_col=id_col, text_col=text_col, k=k), "simhash")
    first = found.groupBy("fp").agg(F.min(id_col).alias("first"))
    joined = components(links(first.select("fp"), d))
    named = first.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
