"""Landing files: discovery, CSV headers and rows, JSON company objects."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ARTICLE_COLUMNS
from .staging import stage


def decoded(path: str) -> Column:
    """File paths come URL-encoded, '+' excepted."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_name(path: str) -> Column:
    return F.element_at(F.split(decoded(path), "/"), -1)


def _reader(spark: SparkSession, suffix: str):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}")


def _unseen(spark: SparkSession, root: str, suffix: str) -> list[tuple]:
    """(path, time in ms, hidden) of files that Spark's readers leave out: empty ones, and names that start
    with '_' or '.', or lie below such a folder. Listed with the file system; only these are kept."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = len([p for p in fs.makeQualified(base).toUri().getPath().split("/") if p])
    found, files = [], fs.listFiles(base, True)
    while files.hasNext():
        status = files.next()
        path = status.getPath()
        if not path.getName().endswith(f".{suffix}"):
            continue
        parts = [p for p in path.toUri().getPath().split("/") if p][top:]
        hidden = any(p[0] in "_." for p in parts)
        if hidden or status.getLen() == 0:
            found.append((re.sub(r"^file:/+", "file:/", path.toUri().toString()), status.getModificationTime(), hidden))
    return found


def discover(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, file_name, file_timestamp, is_empty, is_hidden) of every file below ``root``.

    Only listing data is read.
    """
    files = _reader(spark, suffix).format("binaryFile").load(root)
    read = files.where("length > 0").select(
        F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("file_timestamp"),
        F.lit(False).alias("is_empty"), F.lit(False).alias("is_hidden"),
    )
    rest = spark.createDataFrame(_unseen(spark, root, suffix), "path string, ms long, is_hidden boolean").select(
        "path", F.timestamp_millis("ms").alias("file_timestamp"), (~F.col("is_hidden")).alias("is_empty"), "is_hidden"
    )
    found = read.unionByName(rest)
    if found.isEmpty():
        raise FileNotFoundError(f"no {suffix} files found under {root}")
    return found.select("path", file_name("path").alias("file_name"), "file_timestamp", "is_empty", "is_hidden")


def _literal(paths: Iterable[str]) -> list[str]:
    """Paths as the reader takes them: decoded, with glob characters escaped."""
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(p)) for p in paths]


def _cells(lines: pd.Series, options: dict) -> pd.Series:
    """Header lines cut into column names.

    Blank names, and names that repeat (letter case aside), get the replacement the CSV reader gives them.
    """
    form = {"delimiter": options.get("sep", options.get("delimiter", ",")), "quotechar": options.get("quote", '"') or None}
    escape = options.get("escape", "\\")
    form["escapechar"] = escape if escape and escape != form["quotechar"] else None
    form["quoting"] = csv.QUOTE_MINIMAL if form["quotechar"] else csv.QUOTE_NONE
    out = []
    for line in lines:
        names = next(csv.reader([line], **form), [])
        repeats = Counter(n.lower() for n in names)
        out.append([f"_c{i}" if not n else f"{n}{i}" if repeats[n.lower()] > 1 else n for i, n in enumerate(names)])
    return pd.Series(out)


def csv_headers(spark: SparkSession, paths: list[str], options: dict | None = None) -> DataFrame:
    """(path, names): the column names in the first line of each file that is neither blank nor a comment.

    The rows are staged, not cached: Spark finds cached plans by their paths, and a file that comes again
    under its path would be answered with its old header.
    """
    options = {k: v for k, v in (options or {}).items() if v is not None}
    reader = spark.read.options(**{k: v for k, v in options.items() if k in ("encoding", "charset", "lineSep")})
    comment = options.get("comment")
    lines = (
        reader.text(_literal(paths))
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            "value",
        )
        .where("start = 0 and trim(value) <> ''")
    )
    if comment:
        lines = lines.where(~F.startswith("value", F.lit(comment)))
    first = (
        lines.withColumn("at", F.monotonically_increasing_id())
        .groupBy("path")
        .agg(F.min_by("value", "at").alias("header"))
    )
    # One short row per file: a vectorised cut into a list, whatever the width of a header.
    cut = F.pandas_udf(lambda lines: _cells(lines, options), "array<string>")
    return stage(first.select("path", cut("header").alias("names")), "csv-headers")


def read_csv(
    spark: SparkSession, groups: list[tuple[list[str], list[str]]], options: dict | None = None
) -> DataFrame:
    """Rows of CSV files, all strings, from (header names, paths) groups.

    A single read of files whose headers differ would map columns by position, so each
    distinct header is read under its own schema. Header names are stripped.
    """
    parts = []
    for names, paths in groups:
        at = {name.strip(): i for i, name in enumerate(names)}
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        reader = spark.read.schema(schema).option("header", True).options(**(options or {}))
        parts.append(
            reader.csv(_literal(paths)).select(
                *(F.col(f"c{at[c]}").alias(c) for c in ARTICLE_COLUMNS),
                file_name("_metadata.file_path").alias("file_name"),
                F.col("_metadata.file_modification_time").alias("file_timestamp"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def parse_objects(texts: DataFrame) -> DataFrame:
    """(path, entries, is_json) of (path, value): the object in ``value`` as key to JSON text.

    ``entries`` is NULL where there is none; ``is_json`` tells other valid JSON apart.
    """
    return texts.select(
        "path",
        F.from_json("value", "map<string,string>").alias("entries"),
        F.try_parse_json("value").isNotNull().alias("is_json"),
    )


def read_json_objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``parse_objects`` of files; a file is one JSON value and therefore one row."""
    texts = spark.read.text(_literal(paths), wholetext=True)
    return parse_objects(texts.select(F.col("_metadata.file_path").alias("path"), "value"))
