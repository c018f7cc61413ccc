"""Cleaning of a corpus in stages: toxic documents go, then repeated lines, near copies and repeated passages; the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept, written as Parquet and
read again. All but the last return the columns of documents; texts that a stage changes have their
``n_chars`` counted anew.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import line_dedup, near_copies, packing, substring_dedup, toxicity
from stratagraph.llm.common import read
from stratagraph.sources.steps import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go; it learns from the labels of the documents at hand."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels"))).select(COLUMNS)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; every document stays."""
    return _recounted(line_dedup.remove_lines(docs))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles) stays: that of the smallest id. SimHash's index and min-hash bands find them."""
    return near_copies.keep_one(docs).select(COLUMNS)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that earlier documents have go from the texts; every document stays."""
    return _recounted(substring_dedup.remove_passages(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in full sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_out), ("near_dedup", near_copies_out), ("substring_dedup", passages_out), ("packing", packed)]

#: Trained models and min-hashes have no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}-{name}")
