"""The file log: which landing files were loaded or kept out, and which are still to do."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import conform

FILE_KEY = ["file_name", "file_timestamp"]
# The two states of a file, and spellings of "alert not processed".
SUCCESS, QUARANTINED = "success", "quarantined"
_NOT_PROCESSED = ["false", "f", "0"]


def pending(files: DataFrame, *loaded: DataFrame, identity: str = "name") -> DataFrame:
    """Files whose (name, timestamp), or (path, timestamp), none of the ``loaded`` tables holds.

    A file that comes again under a newer timestamp is a new file.
    """
    key = FILE_KEY if identity == "name" else ["path", "file_timestamp"]
    for table in loaded:
        files = files.join(table.select(*key).distinct(), key, "left_anti")
    return files


def repeated(files: DataFrame, identity: str = "name") -> DataFrame:
    """Add ``same_as``: the path of the earlier file, in path order, that has the same identity; NULL for the first.

    Files are known by base name and time, or, with ``identity="path"``, by their path and time.
    """
    if identity not in ("name", "path"):
        raise ValueError(f"unknown identity {identity!r}")
    if identity == "path":
        return files.withColumn("same_as", F.lit(None).cast("string"))
    first = F.min("path").over(Window.partitionBy(*FILE_KEY))
    return files.withColumn("same_as", F.when(F.col("path") != first, first))


def log_rows(files: DataFrame, batch_id: Column | int, as_of: dt.datetime) -> DataFrame:
    """Log rows for (file_name, file_timestamp, reason); a reason means quarantine."""
    now = F.lit(as_of).cast("timestamp")
    bad = F.col("reason").isNotNull()
    rows = files.select(
        *FILE_KEY,
        *(["path"] if "path" in files.columns else []),
        "reason",
        F.when(bad, QUARANTINED).otherwise(SUCCESS).alias("status"),
        (F.lit(batch_id) if isinstance(batch_id, int) else batch_id).alias("batch_id"),
        F.when(bad, now).alias("quarantined_at"),
        F.when(~bad, now).alias("processed_at"),
        F.lit("N").alias("alert_processed"),
    )
    return conform(rows, "bronze_file_log")


def repair_alerts(log: DataFrame) -> DataFrame:
    """Old spellings of "not processed", and NULL, become 'N'."""
    flag = F.col("alert_processed")
    stale = flag.isNull() | F.lower(flag).isin(_NOT_PROCESSED)
    return log.withColumn("alert_processed", F.when(stale, "N").otherwise(flag))
