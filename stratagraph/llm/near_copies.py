"""Near copies of whole texts: pairs whose five-word shingles are 0.8 or more alike, every one verified on the shingles.

SimHash fingerprints of five-word shingles and their Gray-order index (``simhash``) give the pairs within 4 bits. Alone they
cannot take this similarity in: fingerprints of pairs at 0.8 differ in 9 bits at the median and in up to 17, and 18 disjoint
masks over 64 bits are 3 or 4 bits wide, under which every document meets a good part of all others. So bands of min-hashes
give the pairs that the fingerprints leave unconnected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import column_of, drop_written, map_groups, map_rows, numbered, texts, unpacked, written
from stratagraph.llm import simhash
from stratagraph.llm.components import components
from stratagraph.llm.substring_dedup import opened, shingles, split, squeezed

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of ROWS functions each: two texts at 0.8 share a band with probability 1 - (1 - 0.8 ** 3) ** 14 = 0.99996.
BANDS, ROWS = 14, 3
#: Rows of a band's group that one task compares; larger groups are dealt out in pairs of chunks.
CHUNK = 2048
#: Sets compared with one at a time.
SETS = 256
#: Functions that must agree, in share, for two texts of a group to be compared (4.8 standard deviations below 0.8).
AGREE = 0.5


def _odd(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), 11) | 1 for i in range(n)], dtype=np.uint64)


FUNCTIONS = _odd(BANDS * ROWS)


def shingle_set(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Distinct shingles in order; a text of under k words is one shingle, the empty text has none."""
    if words and len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 13)], dtype=np.uint64)
    return np.unique(shingles(words, k))


def signature(h: np.ndarray) -> np.ndarray:
    """The least value of each function."""
    with np.errstate(over="ignore"):
        return np.array([(h * a).min() for a in FUNCTIONS], dtype=np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def signed(keyed: DataFrame, k: int) -> DataFrame:
    """``row, whole, fp, bands, sig``: a hash of the words, the SimHash fingerprint, 32 bits of each function, and the keys of bands of these."""

    def make():
        def step(batch):
            whole, fps, bands, sigs = [], [], [], []
            for t in texts(batch):
                words = split(t)
                h = shingle_set(words, k)
                whole.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                fps.append(simhash.simhash(t, k))
                s = signature(h) if len(h) else np.zeros(0, dtype=np.uint64)
                few = (s >> np.uint64(32)).astype(np.uint32)
                bands.append([xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(few.reshape(-1, ROWS))])
                sigs.append(few.tobytes())
            return {"row": batch.column(0), "whole": whole, "fp": pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), "bands": bands, "sig": sigs}

        return step

    return map_rows(keyed, make, "row long, whole string, fp long, bands array<long>, sig binary")


def verified(pairs: DataFrame, packed: DataFrame, k: int, similarity: float) -> DataFrame:
    """``a, b``: the pairs whose texts are alike."""
    left = pairs.join(packed.select(F.col("row").alias("a"), F.col("packed").alias("p")), "a")
    both = left.join(packed.select(F.col("row").alias("b"), F.col("packed").alias("q")), "b").select("a", "b", "p", "q")

    def make():
        def step(batch):
            keep, last = [], (None, None)
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[0] != q:
                    last = (q, shingle_set(opened(q), k))
                keep.append(jaccard(shingle_set(opened(p), k), last[1]) >= similarity)
            return {"a": batch.column(0), "b": batch.column(1), "ok": keep}

        return step

    return written(map_rows(both, make, "a long, b long, ok boolean").where("ok").select("a", "b"), "alike")


def _alike(one: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets are alike to ``one``; all are in order, and none is empty."""
    ends = np.cumsum([len(x) for x in sets])
    flat = np.concatenate(sets)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.diff(np.concatenate([[0], np.cumsum(hit)])[ends], prepend=0)
    return both >= similarity * (len(one) + np.diff(ends, prepend=0) - both)


def compared(batch: pa.RecordBatch, k: int, similarity: float) -> list[tuple]:
    """(a, b) of alike rows that connect what is not connected yet, in a chunk of a band's group or between two: a forest.

    A pair that agrees in enough functions is verified here, so a group sends on fewer links than it has rows, however many of
    its pairs are near. Several bands may hold a pair: it is verified in the first of them. The group's least row has been
    compared with all.
    """
    i, j, row, c = (batch.column(n).to_numpy() for n in ("i", "j", "row", "c"))
    n, least = batch.column("n")[0].as_py(), batch.column("b")[0].as_py()
    _, root = np.unique(batch.column("root").to_numpy(), return_inverse=True)
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(len(row), -1)
    packed, known, out = batch.column("packed"), {}, []

    def shingled(x: int) -> np.ndarray:
        if x not in known:
            known[x] = shingle_set(opened(packed[x].as_py()), k)
        return known[x]

    left, right = np.flatnonzero((c == i[0]) & (row != least)), np.flatnonzero((c == j[0]) & (row != least))
    for x in left.tolist():
        other = right[right > x] if i[0] == j[0] else right
        other = other[root[other] != root[x]]
        same = sig[other] == sig[x]
        other = other[(same.sum(axis=1) >= AGREE * sig.shape[1]) & ~same[:, : n * ROWS].reshape(len(other), n, ROWS).all(axis=2).any(axis=1)]
        for at in range(0, len(other), SETS):
            near = other[at : at + SETS]
            near = near[root[near] != root[x]]
            if not len(near):
                continue
            for y in near[_alike(shingled(x), [shingled(y) for y in near.tolist()], similarity)].tolist():
                if root[y] != root[x]:
                    out.append((int(max(row[x], row[y])), int(min(row[x], row[y]))))
                    root[root == root[y]] = root[x]
    return out


def fingerprint_pairs(first: DataFrame) -> DataFrame:
    """``a, b``: pairs of rows (``row, fp``) that connect all whose fingerprints are equal or within the index's distance."""
    least = first.groupBy("fp").agg(F.min("row").alias("least"))
    same = first.join(least, "fp").where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    near = simhash.links(least.select("fp"))
    for side in ("a", "b"):
        near = near.join(least.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_row")), side)
    return same.unionByName(near.select(F.greatest("a_row", "b_row").alias("a"), F.least("a_row", "b_row").alias("b"))).distinct()


def links(first: DataFrame, packed: DataFrame, k: int, similarity: float) -> DataFrame:
    """``a, b``: links that connect all rows (``row, fp, bands, sig``) whose texts are alike and share a band or an index's pair.

    Pairs that the fingerprints' index gives come first, each verified. Then rows are compared with the first of their band; in bands that this leaves in several components, all
    rows that are not connected yet are compared with each other, in pairs of chunks, each of which verifies its pairs and gives a forest.
    """
    indexed = written(fingerprint_pairs(first), "indexed")
    by_index = verified(indexed, packed, k, similarity)
    posted = first.select("row", F.posexplode("bands").alias("n", "key"))
    groups = posted.groupBy("n", "key").agg(F.min("row").alias("b"), F.count("*").alias("size")).where("size > 1")
    met = written(posted.join(groups, ["n", "key"]), "bands")
    star = written(met.where("row <> b").select(F.col("row").alias("a"), "b").distinct(), "star")
    near = written(by_index.unionByName(verified(written(star.join(indexed, ["a", "b"], "left_anti"), "starred"), packed, k, similarity)), "near")
    roots = components(near)
    placed = met.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    split_up = placed.groupBy("n", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("n", "key")
    dealt = placed.join(split_up, ["n", "key"]).join(first.select("row", "sig"), "row").join(packed, "row").withColumn("m", F.ceil(F.col("size") / CHUNK).cast("int"))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("row"), F.col("m")).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
    dealt = dealt.withColumn("g", F.explode(chunks)).select("n", "key", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "c", "row", "b", "root", "sig", "packed")
    more = written(map_groups(dealt, ["n", "key", "i", "j"], ["row"], lambda g: compared(g, k, similarity), "a long, b long").distinct(), "more")
    drop_written(met)
    return near.unionByName(more)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of near copies: that of the smallest id (null last), of one id the first row.

    Texts of the same words are copies, empty and null ones too. All columns stay as they are.
    """
    table = numbered(docs, id_col, "texts")
    keyed = table.select("row", F.coalesce(F.col(column_of(docs, text_col)), F.lit("")).alias("text"))
    found = written(signed(keyed, k), "signatures")
    copies = written(found.groupBy("whole").agg(F.min("row").alias("row")), "copies")
    joined = components(links(found.select("row", "fp", "bands", "sig").join(copies.select("row"), "row", "left_semi"), squeezed(keyed), k, similarity))
    # a component's root is its least row
    stays = copies.select("row").join(joined.where("node <> root").select(F.col("node").alias("row")), "row", "left_anti")
    return table.join(stays, "row", "left_semi").select(*unpacked(table, docs))
