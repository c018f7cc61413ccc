"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import drop_written, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: connect each node's larger (or smaller) neighbours with the least node around it."""
    turned = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = turned.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = turned.join(least, "a")
    out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is the least node of the component.

    Each round writes its links to the shared folder. The driver sees a count and a checksum.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    stamp = None
    for _ in range(most_rounds):
        after = written(_star(_star(now, True), False), "links")
        new = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        drop_written(now)
        now = after
        if new == stamp:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        stamp = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
