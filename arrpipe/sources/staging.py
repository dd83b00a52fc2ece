"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and scratch tables, from the session.

    Only a local session, as in a plain test, may name none: one is made for it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("the session must name a shared folder in spark.checkpoint.dir")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="arrpipe-"))
    return context.getCheckpointDir()


_folder: ContextVar[str | None] = ContextVar("staging folder", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes into one folder, which is deleted at the end, also after an error."""
    path = f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: what builds on it neither repeats its work nor, when
    an executor is lost, sees other rows or another order."""
    path = f"{_folder.get() or checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
