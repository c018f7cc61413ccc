"""Tables between the steps of a loop, and the folder they lie in."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session that runs in one process gets a temporary folder of its own; on a
    cluster no such folder would do, and the lack is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stratagraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def step(df: DataFrame) -> DataFrame:
    """Checkpoint a step's table in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A step's table written to the folder that the cluster shares, and read again.

    For loops whose columns derive from each other: with checkpoints their rounds were measured to become slower
    and slower, likely as a checkpoint keeps what the optimizer inferred of its columns. A table read anew has none of it.
    """
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
