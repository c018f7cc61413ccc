"""File sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAPTORS = "Dataset string, Order string, Family string, Species_Scientific string, Species_Chinese string, Protection_CN string, IUCN string, CITES string, Elevation_m string, Habitats string, Source string"


def read_raptors(spark: SparkSession, path: str) -> DataFrame:
    """A species list as CSV: empty fields are null, habitats become an array, elevations a low and a high end."""
    raw = spark.read.csv(path, header=True, schema=RAPTORS, nullValue="")
    ends = F.split("Elevation_m", "-")
    number = lambda x: F.expr(f"try_cast({x} AS INT)")
    return raw.withColumn("habitats", F.split("Habitats", "-")).withColumn("_e", ends).withColumn("elevation_lo", number("_e[0]")).withColumn("elevation_hi", number("element_at(_e, -1)")).drop("_e")


def write_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines; text stays as it is, nulls are left out."""
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
