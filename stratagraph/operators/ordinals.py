"""Places in an order over a whole table, without one task that holds it: a range sort, and offsets of its partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.sources.steps import step

_BITS = 33  # monotonically_increasing_id has the partition above these


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The table in order, checkpointed, with ``_part`` and ``_at`` of each row."""
    at = F.monotonically_increasing_id()
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return step(sorted_.select("*", F.shiftright(at, _BITS).alias("_part"), at.bitwiseAND((1 << _BITS) - 1).alias("_at")))


def _offsets(ranged: DataFrame, value, kind: str) -> DataFrame:
    """``_part, _before``: what all partitions before one add up to; a row for each partition, so small enough for the driver."""
    total, rows = (0.0 if kind == "double" else 0), []
    for part, x in sorted(ranged.groupBy("_part").agg(value).collect()):
        rows.append((part, total))
        total += x
    return F.broadcast(ranged.sparkSession.createDataFrame(rows, f"_part long, _before {kind}"))


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Adds the place of each row by ``order`` (nulls first), from ``start`` without gaps; ties in any order."""
    ranged = _ranged(df, order)
    out = ranged.join(_offsets(ranged, F.count("*"), "long"), "_part")
    return out.select(*df.columns, (F.col("_before") + F.col("_at") + start).alias(name))


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` (doubles) over a row and all before it by ``order``; a window holds one partition of the range sort."""
    ranged = _ranged(df, order)
    inside = F.sum(value).over(W.partitionBy("_part").orderBy("_at"))
    out = ranged.withColumn("_sum", inside).join(_offsets(ranged, F.coalesce(F.sum(value), F.lit(0.0)), "double"), "_part")
    return out.select(*df.columns, (F.col("_before") + F.col("_sum")).alias(name))
