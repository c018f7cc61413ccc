"""Toxicity scores by non-negative positive-unlabelled learning on hashed words.

The risk of a classifier g is prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)):
confirmed toxic texts stand for the positive class, other text for the mixture of both.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import give_back, map_rows, texts

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that count as features beside the words themselves.
STEMS = (3, 4, 5, 6)
CACHE = 200_000


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    """32-bit hashes of a word and its beginnings."""
    return [crc32(word.encode()), *(crc32(f"^{word[:k]}".encode()) for k in STEMS if len(word) >= k)]


#: A beginning that several distinct words of a text share is a feature of its own.
TWICE, THRICE = 0x5BD1E995, 0x1B873593


def hashed(text: str) -> np.ndarray:
    """The distinct features of a text, in ascending order."""
    base, count = np.unique(np.array([f for w in words(text) for f in features(w)], dtype=np.uint32), return_counts=True)
    return np.unique(np.concatenate([base, base[count > 1] ^ np.uint32(TWICE), base[count > 2] ^ np.uint32(THRICE)]))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    """A linear classifier: weights of the few hashes that carry any."""

    weights: dict[int, float]
    bias: float

    def scorer(self):
        """text -> score from 0 to 1; words that recur are hashed once per task."""
        weights, bias = self.weights, self.bias

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= CACHE:
                    self.clear()
                got = self[word] = tuple(f for f in features(word) if f in weights or f ^ TWICE in weights or f ^ THRICE in weights)
                return got

        known = Known()

        def score(text: str) -> float:
            count = Counter(f for own in filter(None, map(known.__getitem__, words(text))) for f in own)
            found = {f for f, n in count.items()} | {f ^ TWICE for f, n in count.items() if n > 1} | {f ^ THRICE for f, n in count.items() if n > 2}
            z = bias + sum(weights.get(f, 0.0) for f in sorted(found))
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return score


def without_copies(rows: list[np.ndarray], pairs: int = 3) -> list[np.ndarray]:
    """The texts without near copies of earlier ones, whose words would count many times.

    Two texts are taken as copies if two min-hashes of a pair over their rarer features agree.
    """
    if not rows:
        return rows
    names, seen = np.unique(np.concatenate(rows), return_counts=True)
    # looked up text by text: places of all features at once are several times the features
    few_seen = seen <= max(30, 0.002 * len(rows))
    known: list[set[tuple[int, ...]]] = [set() for _ in range(pairs)]
    out = []
    for r in rows:
        own = r[few_seen[np.searchsorted(names, r)]].astype(np.uint64)
        again = False
        for i in range(pairs if len(own) else 0):
            low = []
            for j in (2 * i, 2 * i + 1):
                with np.errstate(over="ignore"):
                    x = (own + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15 + 2 * j * 0x632BE59BD9B4E019) % 2**64)
                    low.append(int(own[(x ^ (x >> np.uint64(29))).argmin()]))
            again |= tuple(low) in known[i]
            known[i].add(tuple(low))
        if not again:
            out.append(r)
    return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, min_docs: int = 5, min_share: float = 0.002, min_z: float = 5.0, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Train on the hashed features of texts.

    Features carry weight if they are in ``min_docs`` and ``min_share`` of the texts and their share
    of the positives differs from that of the unlabelled texts by ``min_z`` standard errors.

    Without positives, or without a prior, nothing is toxic: a constant score near 0.
    """
    if not positive or not unlabelled or prior <= 0:
        return Model({}, -5.0)
    positive, unlabelled = without_copies(positive), without_copies(unlabelled)
    rows = positive + unlabelled
    n, n_pos = len(rows), len(positive)
    names, seen = np.unique(np.concatenate(rows), return_counts=True)
    in_pos = np.zeros(len(names), dtype=np.int64)
    own, times = np.unique(np.concatenate(positive), return_counts=True)
    in_pos[np.searchsorted(names, own)] = times
    share = seen / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_pos + 1 / (n - n_pos)))
    z = (in_pos / n_pos - (seen - in_pos) / (n - n_pos)) / error
    used = np.flatnonzero((seen >= max(min_docs, min_share * n)) & (np.abs(z) >= min_z))
    new = np.full(len(names), -1, dtype=np.int32)
    new[used] = np.arange(len(used))
    # features that carry weight, text by text: places of all features at once are several times the features
    placed = [new[np.searchsorted(names, r)] for r in rows]
    placed = [x[x >= 0] for x in placed]
    owner, cols = np.repeat(np.arange(n), [len(x) for x in placed]), np.concatenate(placed)
    is_pos = np.arange(n) < n_pos
    w, b = np.zeros(len(used)), math.log(prior / (1 - prior)) if prior < 1 else 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[cols], minlength=n) + b
        p = sig(z)
        neg_loss = np.logaddexp(0, z)
        rest = neg_loss[~is_pos].mean() - prior * neg_loss[is_pos].mean()
        g = np.empty(n)
        if rest >= 0:
            g[is_pos] = prior / n_pos * ((p[is_pos] - 1) - p[is_pos])
            g[~is_pos] = p[~is_pos] / (n - n_pos)
        else:  # the negative part has gone below 0: step back along it
            g[is_pos] = prior / n_pos * p[is_pos]
            g[~is_pos] = -p[~is_pos] / (n - n_pos)
        gw = np.bincount(cols, weights=g[owner], minlength=len(used)) + decay * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-6)
    return Model({int(f): float(x) for f, x in zip(names[used], w, strict=True)}, float(b))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 2000, max_unlabelled: int = 6000, **options) -> Model:
    """Fit on a bounded sample: at most ``max_positive`` confirmed toxic documents and ``max_unlabelled`` of all documents.

    The latter are drawn whatever their labels, so that toxic ones are among them in the share that
    the prior tells. Neither holds a held-out row. Samples are those with the least hash of the id, so they are the
    same in every run. The prior is the share of toxic rows among all usable labels.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    prior = marks.agg(F.avg((F.col("_toxic") == 1).cast("double"))).first()[0] or 0.0
    ids = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id")).distinct()
    rank = (F.xxhash64("_id"), F.col("_id"))
    positive = marks.where("_toxic = 1").join(ids, "_id").orderBy(*rank).limit(max_positive).select("_id")
    mixture = ids.orderBy(*rank).limit(max_unlabelled)
    confirmed, drawn = ({r["_id"] for r in x.collect()} for x in (positive, mixture))
    # the chosen ids are at most max_positive + max_unlabelled, a size that may be broadcast
    picked = docs.sparkSession.createDataFrame([(i,) for i in sorted(confirmed | drawn)], ids.schema)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id")

    def make():
        return lambda batch: {"_id": batch.column(0), "features": [hashed(t).tobytes() for t in texts(batch)]}

    found = map_rows(sample.select("_id", "text"), make, f"_id {dict(ids.dtypes)['_id']}, features binary").toArrow()
    rows = sorted(zip(found.column(0).to_pylist(), (np.frombuffer(x, dtype=np.uint32) for x in found.column(1).to_pylist()), strict=True), key=lambda r: r[0])
    del found
    model = fit([b for i, b in rows if i in confirmed], [b for i, b in rows if i in drawn], prior, **options)
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every document.

    Null and empty texts get the score of a text without words; null ids count as held out. Rows that
    repeat get the same score, whatever their other columns.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        rate = model.scorer()
        return lambda batch: {id_col: batch.column(0), "score": [rate(t) for t in texts(batch)]}

    out = map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, f"`{id_col}` {kind}, score double")
    return out.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    flat = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(docs.columns)])
    at = docs.columns.index(text_col)

    def make():
        rate = model.scorer()
        return lambda batch: {f"c{i}": batch.column(i) for i in range(batch.num_columns)} | {"clean": [rate(t) < 0.5 for t in texts(batch, f"c{at}")]}

    out = map_rows(flat, make, ", ".join(f"{n} {t}" for n, t in flat.dtypes) + ", clean boolean").where("clean")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])
