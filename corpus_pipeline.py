"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before
and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.  An
empty table passes all stages as one; columns besides are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import exact_dedup, mixing, packing, quality, simhash
from tidewake.llm._shared import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go.

    A null text counts as empty and goes; null languages and sources are strata
    like any other.  Each row is judged by itself, so repeated rows and ids
    share no verdict; texts are read whole.
    """
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    A null text equals an empty one; a row without id goes before one with an
    id.  Of rows of the same text and id one stays.
    """
    return exact_dedup.keep_unique(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with near fingerprints the one with the smallest doc_id stays.

    Wordless texts have fingerprint 0 and are near each other.  Rows without id
    stay; rows that share their id with a dropped one go with it.
    """
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time that the mix takes a document, with the words it takes.

    A null source is a source of its own, last in order.  Rows without words
    are never taken; ties lie in seeded order, so reruns agree.
    """
    return mixing.mixed(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the words of every row of the mix lie in packed sequences.

    A row longer than the largest sequence is cut into several pieces.  Rows
    without words have none.
    """
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("source mix", source_mix),
    ("best-fit packing", best_fit),
]

#: XXH64 fingerprints and seeded selection have no counterpart in DuckDB's SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the table before a stage lies in the shared folder until the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            _remove(spark, f"{at}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
