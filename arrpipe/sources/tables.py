"""Tables of one warehouse folder, written per run and published together.

``<root>/<table>/version=<run>/`` holds what a run wrote. Built-in Parquet tables take
neither MERGE nor UPDATE, so a run writes its results under a new number and its last
step publishes that number; readers see published runs only. A run that dies before is
invisible, and the next one writes the same number anew.
"""

from __future__ import annotations

import datetime as dt
import uuid
from copy import copy

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import repair_alerts
from ..schemas import SCHEMAS, conform


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.version = self._published()
        self._observed: dict[str, Observation] = {}
        self._superseded: dict[str, str] = {}  # of the tables written so far, what a later version makes useless

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        partitioned = T.StructType(schema.fields + [T.StructField("version", T.IntegerType())])
        try:
            return self.spark.read.schema(partitioned).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], partitioned)

    def _published(self) -> int:
        runs = self._read("published_runs", T.StructType.fromDDL("published_at timestamp"))
        return runs.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def publish(self, as_of: dt.datetime) -> None:
        now = F.lit(as_of).cast("timestamp")
        counts = self.spark.createDataFrame(
            [(table, counter, n) for table, seen in self._observed.items() for counter, n in seen.get.items()],
            "table_name string, counter string, n bigint",
        )
        self._write("run_audit", conform(counts.withColumn("recorded_at", now), "run_audit").coalesce(1))
        run = self.spark.range(1).select(now.alias("published_at"))
        self._write("published_runs", run.coalesce(1))
        self._observed = {}
        self.version += 1

    def draft(self) -> Tables:
        """A view that also reads what the run in progress has written so far."""
        view = copy(self)
        view.version = self.version + 1
        return view

    def _write(self, name: str, df: DataFrame, *partitions: str) -> None:
        path = f"{self.root}/{name}/version={self.version + 1}"
        df.write.mode("overwrite").partitionBy(*partitions).parquet(path)

    def _counted(self, name: str, df: DataFrame, counters: dict[str, Column] | None) -> DataFrame:
        """``df`` with counters that the write itself fills: no second pass. They go into ``run_audit`` as the run
        is published. A counter is an aggregate over the rows written; the number of rows always is one."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        self._observed[name] = seen
        more = [value.cast("bigint").alias(counter) for counter, value in (counters or {}).items()]
        return df.observe(seen, F.count(F.lit(1)).alias("written"), *more)

    def append(self, name: str, rows: DataFrame, counters: dict[str, Column] | None = None) -> None:
        """Add rows to a table that only grows."""
        self._write(name, self._counted(name, conform(rows, name), counters))

    def appended(self, name: str, row_id: str | None = None) -> DataFrame:
        """All published rows; ``row_id`` adds a column that is stable and unique per row."""
        rows = self._read(name, SCHEMAS[name]).where(F.col("version") <= self.version)
        if row_id:
            rows = rows.withColumn(row_id, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
        if name == "bronze_file_log":
            rows = repair_alerts(rows)  # files are never rewritten, so old spellings are repaired as they are read
        return rows.drop("version")

    def replace(self, name: str, rows: DataFrame, counters: dict[str, Column] | None = None) -> None:
        """Write the whole of a table."""
        self._superseded[name] = ""
        self._write(name, self._counted(name, conform(rows, name), counters))

    def latest(self, name: str) -> DataFrame:
        rows = self._read(name, SCHEMAS[name])
        return rows.where(F.col("version") == self.version).drop("version")

    def replace_current(
        self, name: str, changed: DataFrame, counters: dict[str, Column] | None = None
    ) -> None:
        """Write a versioned table: its current rows, and those this run made history.

        Rows that were history before are in earlier runs' folders and stay there.
        """
        self._superseded[name] = "/is_current=true"
        self._write(name, self._counted(name, conform(changed, name), counters), "is_current")

    def retire(self, keep: int) -> None:
        """Delete what only published versions before the last ``keep`` read.

        That is the whole snapshot of a replaced table, and the current rows of a versioned one; history
        and tables that only grow stay. A reader of a version that is kept sees no change.
        """
        if keep < 1:
            raise ValueError("at least the published version must be kept")
        path_of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name, part in self._superseded.items():
            base = path_of(f"{self.root}/{name}")
            files = base.getFileSystem(conf)
            for status in files.listStatus(base):
                version = status.getPath().getName().removeprefix("version=")
                if version.isdigit() and int(version) <= self.version - keep:
                    files.delete(path_of(f"{self.root}/{name}/version={version}{part}"), True)

    def current_and_history(self, name: str) -> DataFrame:
        run = F.col("version")
        alive = F.when(F.col("is_current"), run == self.version).otherwise(run <= self.version)
        return conform(self._read(name, SCHEMAS[name]).where(alive), name)

    def current(self, name: str) -> DataFrame:
        rows = self._read(name, SCHEMAS[name])
        return conform(rows.where(F.col("is_current") & (F.col("version") == self.version)), name)

