"""What the operators share: reading tables, Arrow batches, written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratagraph.shipping import ship
from stratagraph.sources.steps import shared_dir

#: Rows in one Arrow batch at most; a batch of very long texts must fit in a Python worker.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for rows that hold very long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def wide_batches(spark: SparkSession, rows: int = 1 << 16) -> Iterator[None]:
    """Larger Arrow batches while tables of numbers alone are made; what runs inside must hold no texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and an executor's workers share its memory with its heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Apply a batch function on the executors.

    ``make`` runs once per task and returns the function, so that vocabularies load there; it
    returns columns by name, in the order of ``schema``.
    """
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in zip(arrow, (out[f.name] for f in arrow), strict=True)],
                    schema=arrow,
                )
        del step
        give_back()

    return df.mapInArrow(run, struct)


def map_groups(df: DataFrame, keys: list[str], order: list[str], step: Callable[[pa.RecordBatch], list[tuple]], schema: str) -> DataFrame:
    """Apply a function to each group of rows that agree in ``keys`` (whole numbers without nulls), sorted by ``order``.

    Groups come one after another out of sorted partitions, so that many small ones cost no call into
    Spark each; a task holds one Arrow batch and one group. The function returns rows of ``schema``.
    """
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        return np.flatnonzero(np.any([np.diff(batch.column(batch.schema.get_field_index(k)).to_numpy()) != 0 for k in keys], axis=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def made(part: pa.RecordBatch):
            ends = [*changes(part).tolist(), part.num_rows]
            rows = [r for a, b in zip([0, *ends], ends, strict=False) for r in step(part.slice(a, b - a))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            if rest and all(rest[-1].column(rest[-1].schema.get_field_index(k))[-1] == batch.column(batch.schema.get_field_index(k))[0] for k in keys) and not len(changes(batch)):
                rest.append(batch)  # one group goes on
                continue
            whole = pa.concat_batches([*rest, batch])
            cut = changes(whole)
            if len(cut):
                yield from made(whole.slice(0, int(cut[-1])))
                whole = whole.slice(int(cut[-1]))
            rest = [whole]
        if rest:
            yield from made(pa.concat_batches(rest))
        give_back()

    return dealt.mapInArrow(run, struct)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no table in use can ask for again: its cleaner acts when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(docs: DataFrame, id_col: str, name: str = "numbered") -> DataFrame:
    """``row`` and ``all`` (a struct of the columns), written once, so that every later step sees the same numbers.

    Rows ascend by id, null ids last; rows of one id keep the order of the table. An id that very many
    rows have spreads over several partitions.
    """
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = F.col(f"all.c{docs.columns.index(id_col)}")
    keyed = docs.select(kept.alias("all"), F.monotonically_increasing_id().alias("place"))
    keyed = keyed.select("all", "place", at.isNull().alias("no_id"), at.alias("id"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = keyed.repartitionByRange(parts, "no_id", "id", "place").sortWithinPartitions("no_id", "id", "place")
    out = written(dealt.select(F.monotonically_increasing_id().alias("row"), "all"), name)
    del dealt, keyed
    release(docs.sparkSession)
    return out


def column_of(docs: DataFrame, name: str) -> str:
    """Where ``numbered`` keeps a column."""
    return f"all.c{docs.columns.index(name)}"


def unpacked(rows: DataFrame, docs: DataFrame) -> list:
    """The columns of ``docs`` out of ``all``."""
    return [F.col(f"all.c{i}").alias(c) for i, c in enumerate(docs.columns)]


def join_counted(large: DataFrame, counted: DataFrame, on: list[str], n: str = "n", spread: str = "row", total: int | None = None) -> DataFrame:
    """``large`` joined with ``counted``, a written table that tells how many rows of ``large`` have each key (``total`` in all).

    Keys that hold more than a quarter of a partition's even share, and over 1,000 rows, are split by a hash of
    ``spread``; the counted row is copied to each part. There are at most four such keys a partition, so their list may be broadcast.
    """
    spark = large.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    limit = max(1000, (counted.agg(F.sum(n)).first()[0] or 0 if total is None else total) // (4 * parts))
    found = counted.where(F.col(n) > limit).select(*on, F.ceil(F.col(n) / limit).cast("int").alias("_parts")).collect()
    if not found:
        return large.join(counted, on)
    hot = spark.createDataFrame(found, counted.select(*on, F.lit(1).alias("_parts")).schema)
    left = large.join(F.broadcast(hot), on, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_parts"))).cast("int")).drop("_parts")
    right = counted.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*on, "_part"]).drop("_part")
