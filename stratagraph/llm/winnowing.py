"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window, rightmost on ties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import map_rows, small_batches, texts
from stratagraph.shipping import ship

#: Code points of a gram, grams of a window: any passage of GRAM + WINDOW - 1 code points that two texts share leaves a hash in both,
#: so half of a text of 34 code points or more does.
GRAM, WINDOW = 8, 10
BASE = 0x9E3779B97F4A7C15
LOWEST = -(2**63)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams, as the polynomial of their code points; grams double in length."""
    bits, power = codes.astype(np.uint64) + np.uint64(1), np.uint64(BASE)
    done, length = None, 0
    span = 1
    with np.errstate(over="ignore"):
        while span <= k:
            if k & span:
                if done is None:
                    done, length = bits, span
                else:
                    done = done[: len(done) - span] * power + bits[length : length + len(done) - span]
                    length += span
            if span * 2 <= k:
                bits = bits[: len(bits) - span] * power + bits[span:]
            power = power * power
            span *= 2
        done = (done ^ (done >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return done ^ (done >> np.uint64(29))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minima of all windows of w hashes by their upper halves, each once; the rightmost of equal ones."""
    n = len(h)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    w = min(w, n)
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    new = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return (low - (key[new] & low)).astype(np.int64)


def winnow(text: str, k: int = GRAM, w: int = WINDOW, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in the order of the text.

    A text shorter than k is one gram; the empty text has none. Long texts are taken in blocks that
    overlap by a window, which leaves the result as it would be in one piece.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    k = min(k, n)
    grams = n - k + 1
    hashes, places = [], []
    for at in range(0, max(1, grams - w + 1), block):
        own = gram_hashes(codes[at : at + block + w - 1 + k - 1], k)
        p = window_minima(own, w)
        if places and len(places[-1]):
            p = p[p + at > places[-1][-1]]
        hashes.append(own[p].astype(np.uint32))  # the lower half: the upper one is small in every minimum
        places.append(p + at)
    return np.concatenate(hashes), np.concatenate(places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of hashes that two fingerprints have in common (Dice); 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) + len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def spelled(hashes: np.ndarray) -> str:
    """A fingerprint as text: its hashes in order, eight hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``id_col, hashes array<long>, positions array<long>`` for every document.

    Null and empty texts have empty arrays; rows that repeat give the same arrays. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        def step(batch):
            rows = [winnow(t, k, w) for t in texts(batch)]
            return {id_col: batch.column(0), "hashes": [h.astype(np.int64) for h, _ in rows], "positions": [p for _, p in rows]}

        return step

    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, f"`{id_col}` {kind}, hashes array<long>, positions array<long>")


def in_descending_order(docs: DataFrame, id_col: str, parts: int) -> DataFrame:
    """Partitions that each hold a range of ids in descending order, and after it the first row of the range that follows.

    Bounds come from the ids alone; the driver sees one bound and one id for each range. The last
    range is followed by the first. Columns ``_part``, ``_halo`` (1 for the row that follows) and ``_key``.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    ids = docs.select(key.alias("_key"))
    bounds = sorted({int(x) for x in ids.approxQuantile("_key", [i / parts for i in range(1, parts)], 0.2 / parts)})
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("_key"))) if bounds else F.lit(0)
    first = {r["_part"]: r["m"] for r in ids.withColumn("_part", part).groupBy("_part").agg(F.max("_key").alias("m")).collect()}
    order = sorted(first)
    # the range that a range's first row follows
    follows = {first[p]: order[i - 1] for i, p in enumerate(order)}
    rows = docs.withColumn("_key", key).withColumn("_part", part)
    if follows:
        ahead = F.element_at(F.create_map(*[F.lit(x) for kv in follows.items() for x in kv]), F.col("_key"))
        places = F.when(F.col("_key").isin(list(follows)), F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("h")), F.struct(ahead.alias("p"), F.lit(1).alias("h"))))
        places = places.otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("h"))))
    else:
        places = F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("h")))
    rows = rows.withColumn("_place", F.explode(places)).select("*", F.col("_place.h").alias("_halo"), F.col("_place.p").alias("_to"))
    rows = rows.drop("_part", "_place").withColumnRenamed("_to", "_part")
    return rows


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are to each other and to the next text.

    The edited text has its last half replaced by the start of the next document in descending order
    of ids. Null texts are empty, null ids come last; rows with one id follow each other in the order
    of their texts. A single row is its own next one. Texts are shuffled once, by range of ids.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = in_descending_order(own, "id", 2 * parts)
    rows = rows.repartition(parts, "_part").sortWithinPartitions("_part", "_halo", F.desc("_key"), "text").select("id", "text", "_part", "_halo")
    names = ["id", *(x.split()[0] for x in COLUMNS.split(", "))]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        waiting = None  # id, text, hashes of the row before
        for batch in batches:
            out = []
            for i, t, part, halo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting is not None and waiting[3] != part:
                    waiting = None
                if waiting is None and halo:
                    continue  # a second row of the one that follows
                h = winnow(t, k, w)[0]
                if waiting is not None:
                    a, text, own_h, _ = waiting
                    half = len(text) // 2
                    edited = text[: len(text) - half] + t[:half]
                    eh = winnow(edited, k, w)[0]
                    out.append((a, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(own_h), spelled(eh), likeness(own_h, eh), likeness(own_h, h)))
                waiting = None if halo else (i, t, h, part)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    small_batches(spark)
    ship(spark)
    return rows.mapInArrow(run, f"id long, {COLUMNS}").withColumnRenamed("id", id_col)
