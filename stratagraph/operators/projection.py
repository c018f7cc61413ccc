"""Vectors of unseen entities from their features: a linear map fitted to the entities that have vectors.

A partition of the table adds up products of its features and vectors; these sums, as large as the map and not as the
table, are added up over partitions and solved once. The map then goes to every row that lacks a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.shipping import ship


@dataclass
class Moments:
    """Of the rows with a vector, features with a leading 1: ``gram`` = F'F, ``cross`` = F'Y, and how many rows."""

    gram: np.ndarray
    cross: np.ndarray
    n: int


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().cast(pa.float64()).to_numpy().reshape(batch.num_rows, -1)


def moment_rows(rows: DataFrame, features: str, vector: str) -> DataFrame:
    """``i, j, value``: sums over rows of feature i times feature or vector component j; place 0 is the constant 1, components follow the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                f = np.column_stack([np.ones(batch.num_rows), _matrix(batch, features)])
                sums = f.T @ np.column_stack([f, _matrix(batch, vector)])
                total = sums if total is None else total + sums
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "value"])

    ship(rows.sparkSession)
    whole = rows.where(F.col(features).isNotNull() & F.col(vector).isNotNull()).select(features, vector)
    return whole.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def moments(rows: DataFrame, features: str, vector: str) -> Moments:
    """The sums on the driver: as many numbers as the map has, whatever the rows. No rows at all is an error."""
    found = moment_rows(rows, features, vector).collect()
    if not found:
        raise ValueError("no row has features and a vector")
    p, width = max(r.i for r in found) + 1, max(r.j for r in found) + 1
    m = np.zeros((p, width))
    for r in found:
        m[r.i, r.j] = r.value
    return Moments(m[:, :p], m[:, p:], round(m[0, 0]))


def solved(m: Moments, ridge: float = 0.0) -> np.ndarray:
    """The map of least squares with ``ridge`` (a row's worth) on all but the constant; of several equally good ones the smallest."""
    penalty = ridge * m.n * np.eye(len(m.gram))
    penalty[0, 0] = 0
    return np.linalg.pinv(m.gram + penalty, hermitian=True) @ m.cross


def aligned(m: Moments, steps: int, rate: float, weight: float) -> np.ndarray:
    """The map after steps of gradient descent on ``weight`` times the mean squared error, from zero."""
    w = np.zeros_like(m.cross)
    for _ in range(steps):
        w -= rate * weight * 2 * (m.gram @ w - m.cross) / m.n
    return w


def project(rows: DataFrame, features: str, vector: str, learned: np.ndarray) -> DataFrame:
    """``rows`` with the vector of those that have none made from their features; rows without features stay as they are."""
    made = F.array(*[F.lit(float(learned[0, k])) + _weighted(features, learned[1:, k]) for k in range(learned.shape[1])])
    return rows.withColumn(vector, F.coalesce(F.col(vector), F.when(F.col(features).isNotNull(), made)))


def _weighted(features: str, weights: np.ndarray):
    return F.aggregate(F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
