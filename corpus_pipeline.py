"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrpipe.llm import decontaminate, mix, neardup, quality, shards
from arrpipe.llm.common import table
from arrpipe.sources.staging import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = docs.select(row, quality.score(model, spark).alias("_score"))
    return scored.where("_score >= 0.5").select("_row.*")


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.unique(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken several times comes in as many rows."""
    return mix.mixed(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, text_crc32, shard and slot."""
    return shards.assign(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", accept_quality),
    ("near_duplicates", unique_documents),
    ("decontamination", clean_documents),
    ("mix", mixed_documents),
    ("shards", sharded_documents),
]

#: The classifier and the signatures can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
