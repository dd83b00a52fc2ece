"""One batch: landing files to published tables and extracts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from ..sources.staging import scratch
from ..sources.tables import Tables
from .bronze import run_bronze
from .gold import export, run_gold
from .options import Options
from .silver import run_silver


def run(
    spark: SparkSession,
    source: str,
    warehouse: str,
    output: str | None = None,
    as_of: dt.datetime | None = None,
    csv_options: dict | None = None,
    suffixes: tuple[str, str] = ("csv", "json"),
    identity: str = "name",
    keep: int | None = 2,
    options: Options = Options(),
) -> Tables:
    """Run bronze, silver and gold, publish the results together, then export.

    ``as_of`` stands for "now" wherever the batch needs it. The session time zone should
    be UTC. ``suffixes`` are those of article and company files. Files are known by base name and time,
    or by path and time where ``identity`` is "path". The last ``keep`` published versions stay readable, all if None;
    snapshots of older ones are deleted. ``options`` are the switches of the silver step. The table ``run_audit``
    says how many rows each run wrote.
    """
    as_of = as_of or dt.datetime.now(dt.timezone.utc)
    tables = Tables(spark, warehouse)
    with scratch(spark):
        run_bronze(spark, tables, source, as_of, csv_options, suffixes, identity)
        run_silver(spark, tables, as_of, options)
        run_gold(tables, as_of)
        tables.publish(as_of)
    if keep is not None:
        tables.retire(keep)
    if output:
        export(tables, output)
    return tables
