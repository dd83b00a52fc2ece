"""Landing files to raw tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, ledger, state
from ..schemas import empty
from ..sources import landing
from ..sources.staging import stage
from ..sources.tables import Tables


def _paths(files: DataFrame) -> list[str]:
    # The reader needs names, and its file index holds them on the driver anyway.
    return [row["path"] for row in files.where("not is_empty and not is_hidden").select("path").collect()]


_HIDDEN = "File or folder name starts with '_' or '.': not readable as data."


def _kept_out(files: DataFrame) -> DataFrame:
    """(path, same_reason) of files that aren't looked into: hidden ones and later copies."""
    reason = F.when(F.col("is_hidden"), _HIDDEN).when(
        F.col("same_as").isNotNull(), F.concat(F.lit("Same name and time as "), "same_as")
    )
    return files.withColumn("_out", reason)


def gate_articles(
    spark: SparkSession, files: DataFrame, options: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split CSV files at the gate: (files with reason, rows of the files without one)."""
    paths = _paths(files)
    names = (
        landing.csv_headers(spark, paths, options)
        if paths
        else spark.createDataFrame([], "path string, names array<string>")
    )
    checked = gates.check_headers(
        files.join(names, "path", "left").withColumn(
            "names", F.coalesce("names", F.array().cast("array<string>"))
        )
    )
    # Only headers that passed come here: as many read groups as there are layouts.
    good = checked.where("reason is null").groupBy("names").agg(F.collect_list("path").alias("p"))
    groups = [(row["names"], row["p"]) for row in good.collect()]
    rows = landing.read_csv(spark, groups, options) if groups else empty(spark, "bronze_articles")
    return checked, rows


def gate_companies(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split JSON files at the gate: (files with reason, rows of the files without one).

    The parsed files are staged, as reasons and rows are taken from them several times.
    """
    paths = _paths(files)
    schema = "path string, entries map<string,string>, is_json boolean"
    read = (
        stage(landing.read_json_objects(spark, paths), "json-objects") if paths else spark.createDataFrame([], schema)
    )
    unread = files.where("is_empty").select(
        "path", F.lit(None).cast("map<string,string>").alias("entries"), F.lit(False).alias("is_json")
    )
    bad, rows = gates.check_companies(read.unionByName(unread))
    origin = files.select("path", *ledger.FILE_KEY)
    order = F.split(landing.decoded("path"), "/").alias("_order")
    return files.join(bad, "path", "left"), rows.join(origin, "path").select("*", order)


def run_bronze(
    spark: SparkSession,
    tables: Tables,
    source: str,
    as_of: dt.datetime,
    options: dict | None = None,
    suffixes: tuple[str, str] = ("csv", "json"),
    identity: str = "name",
) -> None:
    """Load the files below ``source`` that no earlier run has loaded or kept out.

    Of files with one ``identity`` in a run the first in path order is loaded, the others are logged.
    """
    log = tables.appended("bronze_file_log")
    found = [ledger.pending(landing.discover(spark, source, s), log, identity=identity) for s in suffixes]
    found = [_kept_out(ledger.repeated(files, identity)) for files in found]
    csvs, jsons = (files.where("_out is null") for files in found)
    out = [files.where("_out is not null").select(*ledger.FILE_KEY, F.col("_out").alias("reason"), "path") for files in found]
    articles = tables.appended("bronze_articles")
    batch_id = articles.agg((F.coalesce(F.max("batch_id"), F.lit(0)) + 1).alias("b")).first()["b"]
    now = F.lit(as_of).cast("timestamp")

    csv_files, rows = gate_articles(spark, csvs, options)
    tables.append(
        "bronze_articles", rows.withColumns({"insert_datetime": now, "batch_id": F.lit(batch_id)})
    )
    json_files, companies = gate_companies(spark, jsons)
    current = tables.current("bronze_company_metadata")
    tables.replace_current(
        "bronze_company_metadata",
        state.scd2_by_file(
            current, companies.withColumn("insert_datetime", now), "company_name", "_order"
        ),
    )
    files = csv_files.select(*ledger.FILE_KEY, "reason", "path")
    for more in (json_files.select(*ledger.FILE_KEY, "reason", "path"), *out):
        files = files.unionByName(more)
    tables.append("bronze_file_log", ledger.log_rows(files, batch_id, as_of))
