"""Scores of queries against all candidates by blocks: one matrix product for two blocks, and a row for each pair only where all are asked for.

Vectors are dealt out anew by their number and packed into full blocks, which are written once; so blocks and tasks grow with
the rows and not with the partitions that these came in. Each block of queries meets each block of candidates once. For the best
candidates and for counts a task keeps these for the queries it sees, and passes on one row for each of them at its end: what
leaves it grows with the queries, not with pairs. ``every`` passes on all pairs, some queries of a block at a time, and keeps none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratagraph.shipping import ship
from stratagraph.sources.steps import step

#: Rows of a block; two blocks, their scores and a sort of these fit a worker's memory at some hundred dimensions.
QUERIES, CANDIDATES = 512, 4096
#: Full blocks of a partition; all of a partition of queries meet all of one of candidates in a task.
QUERY_BLOCKS, CANDIDATE_BLOCKS = 4, 8
#: The same where every pair is passed on: what a task reads, and may hold as one Arrow batch, is small beside what it makes.
EVERY_QUERY_BLOCKS, EVERY_CANDIDATE_BLOCKS = 2, 4
#: Queries of a block whose pairs go on together.
_TOGETHER = 16
#: Columns of a block at a time in sums over places, so that they stay in a core's cache; pairs whose scores are made one by one at a time.
_TILE, _PAIRS = 256, 1 << 15


@contextmanager
def _few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of few rows while blocks, which are large rows, are read; what runs inside must be an action."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def packed(rows: DataFrame, numbers: list[str], vector: str, size: int, prefix: str) -> DataFrame:
    """Blocks of up to ``size`` rows: the columns ``numbers`` (no nulls) as arrays of doubles or whole numbers, the vectors as ``<prefix>data``.

    Rows without a vector are left out. All vectors have one length.
    """
    kinds = dict(rows.dtypes)
    array = lambda c: "double" if kinds[c] in ("double", "float") else "long"
    schema = StructType.fromDDL(", ".join([*(f"{prefix}{c} array<{array(c)}>" for c in numbers), f"{prefix}data binary"]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(last: bool):
            table = pa.Table.from_batches(held).combine_chunks()
            end = table.num_rows if last else table.num_rows // size * size
            for at in range(0, end, size):
                part = table.slice(at, min(size, end - at)).combine_chunks()
                data = part.column(vector).combine_chunks().flatten().cast(pa.float64()).to_numpy()
                columns = [pa.array([part.column(c).to_numpy()], f.type) for c, f in zip(numbers, arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([data.tobytes()], pa.binary())], schema=arrow)
            held[:] = table.slice(end).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= size:
                    yield from blocks(False)
        if held:
            yield from blocks(True)

    ship(rows.sparkSession)
    return rows.select(*numbers, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)


def scores(q: np.ndarray, c: np.ndarray, how: str) -> np.ndarray:
    """Scores of all rows of ``q`` against all of ``c``: ``dot``, minus the ``l1`` distance, or minus the ``l2`` distance squared.

    ``dot_effect`` adds an effect along trees: queries end with a weight, a tree and a norm, candidates with a tree and a norm.
    """
    if how == "dot":
        return q @ c.T
    if how == "dot_effect":
        near = np.maximum(0, 1 - np.abs(q[:, -1:] - c[:, -1]))
        return q[:, :-3] @ c[:, :-2].T + q[:, -3:-2] * np.where(q[:, -2:-1] == c[:, -2], near, 0)
    out = np.zeros((len(q), len(c)))
    for k in range(q.shape[1]):
        off = q[:, k, None] - c[None, :, k]
        out -= np.abs(off) if how == "l1" else off * off
    return out


def _blocks(rows: DataFrame, numbers: list[str], vector: str, size: int, many: int, prefix: str) -> DataFrame:
    """Full blocks of the rows, ``many`` to a partition, checkpointed; inside a partition in order of the first number."""
    dealt = rows.select(*numbers, vector).repartition(max(1, -(-rows.count() // (size * many)))).sortWithinPartitions(numbers[0])
    return step(packed(dealt, numbers, vector, size, prefix).withColumn(f"{prefix}block", F.monotonically_increasing_id()))


def _cells(queries: DataFrame, numbers: list[str], candidates: DataFrame, many: tuple[int, int] = (QUERY_BLOCKS, CANDIDATE_BLOCKS)) -> DataFrame:
    """Every block of queries with every block of candidates. Both sides are read from where they are written; neither is broadcast."""
    q = _blocks(queries, numbers, "q", QUERIES, many[0], "q_").withColumnRenamed("q_block", "block")
    c = _blocks(candidates, ["id"], "c", CANDIDATES, many[1], "c_").drop("c_block")
    return q.hint("shuffle_replicate_nl").crossJoin(c)


def _read(row: dict, numbers: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.asarray(row["c_id"])
    q = np.frombuffer(row["q_data"]).reshape(len(row[f"q_{numbers[0]}"]), -1)
    c = np.frombuffer(row["c_data"]).reshape(len(ids), -1)
    if (np.diff(ids) < 0).any():
        order = np.argsort(ids, kind="stable")
        c, ids = c[order], ids[order]
    return q, c, ids


def _near_scores(q: np.ndarray, c: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray | float]:
    """Scores as ``scores`` has them, or quicker ones with what they are off by at most (0: exact), for each query."""
    if how not in ("l1", "l2"):
        return scores(q, c, how), 0.0
    width = q.shape[1]
    if how == "l2":
        qq, cc = (q * q).sum(axis=1)[:, None], (c * c).sum(axis=1)
        off = (width + 8) * 2.0**-50 * (qq + cc.max(initial=0.0))
        if not np.isfinite(off).all():
            return scores(q, c, how), 0.0
        s = q @ c.T
        s *= 2
        s -= cc
        s -= qq
        return s, off
    largest = np.abs(q).max(initial=0.0) + np.abs(c).max(initial=0.0)
    if not largest < 1e30:
        return scores(q, c, how), 0.0
    q4, c4 = q.astype(np.float32), np.ascontiguousarray(c.T, dtype=np.float32)
    out = np.empty((len(q), len(c)), np.float32)
    for at in range(0, len(c), _TILE):
        part = np.zeros((len(q), min(_TILE, len(c) - at)), np.float32)
        off = np.empty_like(part)
        for k in range(width):
            np.subtract(q4[:, k, None], c4[k, at : at + _TILE], out=off)
            np.abs(off, out=off)
            part -= off
        out[:, at : at + _TILE] = part
    return out, (width + 4) ** 2 * 2.0**-23 * largest


def _pair_scores(q: np.ndarray, c: np.ndarray, rows: np.ndarray, at: np.ndarray, how: str) -> np.ndarray:
    """Exact scores of some pairs, a bounded number at a time."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), _PAIRS):
        off = q[rows[i : i + _PAIRS]] - c[at[i : i + _PAIRS]]
        out[i : i + _PAIRS] = -(np.abs(off) if how == "l1" else off * off).sum(axis=1)
    return out


def _kept(q: np.ndarray, c: np.ndarray, ids: np.ndarray, how: str, k: int, digits: int, before: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query out of those before and this block: ids by place, and rounded scores; smaller ids first among equals.

    Only candidates that may reach the k-th place are scored exactly, rounded and put in order: those not under the k-th best
    score known, by more than rounding and what the quick scores are off by.
    """
    n = len(q)
    s, off = _near_scores(q, c, how)
    if np.isnan(s).any():
        s[np.isnan(s)] = -np.inf
    if before is not None:
        floor = before[1][:, -1:]
    elif s.shape[1] >= k:
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None].astype(np.float64)
    else:
        floor = np.full((n, 1), -np.inf)
    floor = floor - 2 * off - 1.5 * 10.0**-digits
    rows, at = np.nonzero(s >= np.nextafter(floor.astype(s.dtype), s.dtype.type(-np.inf)))
    found = np.round(s[rows, at] if how not in ("l1", "l2") else _pair_scores(q, c, rows, at, how), digits) + 0.0
    numbers = ids[at]
    if before is not None:
        rows, numbers, found = np.concatenate([np.repeat(np.arange(n), k), rows]), np.concatenate([before[0].ravel(), numbers]), np.concatenate([before[1].ravel(), found])
    order = np.lexsort((numbers, -found, rows))
    rows, numbers, found = rows[order], numbers[order], found[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rows, numbers, found, place = (x[place < k] for x in (rows, numbers, found, place))
    out = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    out[0][rows, place], out[1][rows, place] = numbers, found
    return out


def best(queries: DataFrame, keys: list[str], candidates: DataFrame, k: int, how: str = "dot", digits: int = 6) -> DataFrame:
    """``keys, id, score``: the k best candidates (``id, c``) of every query (``keys, q``), scores rounded; equal ones by id.

    Keys are whole numbers and name a query once. Empty sides give no rows. The result is checkpointed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                q, c, ids = _read(row, keys)
                before = held.get(row["block"])
                held[row["block"]] = [[row[f"q_{c}"] for c in keys], _kept(q, c, ids, how, k, digits, before and before[1])]
        for names, (ids, s) in held.values():
            at = np.nonzero(np.isfinite(s).ravel())[0]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(np.asarray(n), k)[at]) for n in names], pa.array(ids.ravel()[at]), pa.array(s.ravel()[at])], names=[*keys, "id", "score"])

    schema = ", ".join([*(f"{c} long" for c in keys), "id long", "score double"])
    cells = _cells(queries, keys, candidates)
    with _few_rows(queries.sparkSession, 16):
        found = step(cells.mapInArrow(run, schema))
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def every(queries: DataFrame, keys: list[str], candidates: DataFrame, how: str = "dot", digits: int = 6) -> DataFrame:
    """``keys, id, score``: all candidates (``id, c``) of every query (``keys, q``), scores rounded; null where either has no vector.

    Keys are whole numbers. The rows are made when they are read: as many as pairs, so they are neither kept nor written.
    """
    schema = ", ".join([*(f"{c} long" for c in keys), "id long", "score double"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, c, ids = _read(row, keys)
                c, names = np.asfortranarray(c), [np.asarray(row[f"q_{k}"]) for k in keys]
                for at in range(0, len(q), _TOGETHER):
                    s = np.round(scores(q[at : at + _TOGETHER], c, how), digits) + 0.0
                    columns = [*(np.repeat(n[at : at + _TOGETHER], len(ids)) for n in names), np.tile(ids, len(s)), s.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    out = _cells(queries, keys, candidates, (EVERY_QUERY_BLOCKS, EVERY_CANDIDATE_BLOCKS)).mapInArrow(run, schema)
    lone_q, lone_c = queries.where("q IS NULL"), candidates.where("c IS NULL")
    for lone, q, c in ((lone_q, lone_q, candidates), (lone_c, queries.where("q IS NOT NULL"), lone_c)):
        if not lone.isEmpty():
            pairs = q.select(*[F.col(k).cast("long").alias(k) for k in keys]).crossJoin(c.select(F.col("id").cast("long").alias("id")))
            out = out.unionByName(pairs.withColumn("score", F.lit(None).cast("double")))
    return out


def against_all(queries: DataFrame, keys: list[str], candidates: DataFrame, how: str = "dot", margin: float = 1.0, digits: int = 6) -> DataFrame:
    """``keys, own, better, hinge, n``: for every query (``keys, q, own``) how many candidates score over ``own``, the sum of
    ``max(0, margin + score - own)``, and how many there are. Keys name a query once. The result is checkpointed.
    """
    numbers = [*keys, "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                q, c, _ = _read(row, numbers)
                s = np.round(scores(q, c, how), digits) - np.asarray(row["q_own"])[:, None]
                counts = np.stack([(s > 0).sum(axis=1), np.maximum(0, margin + s).sum(axis=1), np.full(len(q), len(c))])
                before = held.setdefault(row["block"], [[row[f"q_{c}"] for c in numbers], 0])
                before[1] = before[1] + counts
        for names, counts in held.values():
            yield pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(counts[0].astype(np.int64)), pa.array(counts[1]), pa.array(counts[2].astype(np.int64))], names=[*numbers, "better", "hinge", "n"])

    schema = ", ".join([*(f"{c} long" for c in keys), "own double, better long, hinge double, n long"])
    cells = _cells(queries, numbers, candidates)
    with _few_rows(queries.sparkSession, 16):
        found = step(cells.mapInArrow(run, schema))
    return found.groupBy(*numbers).agg(F.sum("better").alias("better"), F.sum("hinge").alias("hinge"), F.sum("n").alias("n"))
