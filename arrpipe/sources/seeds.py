"""Dimension seeds and the steps that load them into existing tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS, conform

# Fixed values: (id, name, group).
CATEGORIES = [
    (1, "Finance", "Finance"),
    (2, "Cybersecurity", "Security"),
    (3, "Enterprise Software", "Software"),
    (4, "Data Analytics", "Analytics"),
    (5, "InfoSec", "Security"),
    (6, "Machine Learning", "AI/ML"),
    (7, "Software", "Software"),
    (8, "Cloud", "Cloud"),
    (9, "FinTech", "Finance"),
    (10, "AI/ML", "AI/ML"),
    (11, "Financial Technology", "Finance"),
    (12, "Analytics", "Analytics"),
    (13, "Security", "Security"),
    (14, "AI & ML", "AI/ML"),
    (15, "Artificial Intelligence", "AI/ML"),
    (16, "Big Data", "Analytics"),
    (17, "SaaS", "Software"),
    (18, "Cloud Services", "Cloud"),
    (19, "Cloud Computing", "Cloud"),
]
# Fixed values: (range_id, min, max, name, order), both bounds inclusive, NULL for an open end.
REVENUE_RANGES = [
    (0, 0.0, 0.0, "Unknown", 0),
    (1, 1.0, 1e4, "Up to 10K USD", 1),
    (2, 10001.0, 1e5, "10K -100K USD", 2),
    (3, 100001.0, 1e6, "100K - 1M USD", 3),
    (4, 1000001.0, 1e7, "1M-10M USD", 4),
    (5, 10000001.0, 1e8, "10M-100M", 5),
    (6, 100000001.0, 1e9, "100M-1B", 6),
    (7, 1000000001.0, 1e10, "1B - 10B", 7),
    (8, 10000000001.0, 1e11, "10B - 100B", 8),
    (9, 100000000001.0, None, "100B+", 9),
]
# Fixed values: (id, currency, rate to USD, is_current).
CURRENCIES = [
    (1, "EUR", 1.1, True),
    (2, "GBP", 1.27, True),
    (3, "JPY", 1.0 / 150, True),
    (4, "USD", 1.0, True),
]
DATE_SPINE = (dt.date(2020, 1, 1), dt.date(2026, 12, 31))


def _literal(value) -> str:
    if value is None or isinstance(value, (bool, int)):
        return "null" if value is None else str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, dt.datetime):
        return f"timestamp'{value.isoformat()}'"
    return "'" + value.replace("'", "''") + "'"


def _inline(spark: SparkSession, rows: list[tuple], table: str) -> DataFrame:
    """Rows as an inline table: unlike rows from Python it has a known, small size."""
    values = ", ".join(f"({', '.join(map(_literal, row))})" for row in rows)
    names = ", ".join(SCHEMAS[table].names)
    return conform(spark.sql(f"select * from values {values} as t({names})"), table)


def categories(spark: SparkSession, as_of: dt.datetime) -> DataFrame:
    return _inline(spark, [(*row, as_of) for row in CATEGORIES], "dim_category")


def revenue_ranges(spark: SparkSession) -> DataFrame:
    return _inline(spark, REVENUE_RANGES, "dim_revenue_range")


def currencies(spark: SparkSession) -> DataFrame:
    return _inline(spark, CURRENCIES, "dim_currency_conversion")


def dates(spark: SparkSession, spine: tuple[dt.date, dt.date] = DATE_SPINE) -> DataFrame:
    """One row per day of the spine, keyed by yyyymmdd."""
    first, last = (F.lit(day) for day in spine)
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("date"))
    year, month, day = F.year("date"), F.month("date"), F.dayofmonth("date")
    return days.select(
        (year * 10000 + month * 100 + day).alias("date_id"),
        "date",
        year.alias("year"),
        month.alias("month"),
        day.alias("day"),
        F.quarter("date").alias("quarter_no"),
    )


def seed_if_empty(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """``existing``, or ``seed`` where ``existing`` has no row."""
    return existing.unionByName(seed.where(~existing.exists()))


def insert_missing(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``existing`` plus those ``rows`` whose key it lacks."""
    return existing.unionByName(rows.join(existing, key, "left_anti").select(existing.columns))


def add_column_if_absent(df: DataFrame, column: str, ddl_type: str) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(None).cast(ddl_type))


def backfill(df: DataFrame, mapping: DataFrame, key: str, column: str) -> DataFrame:
    """Fill NULLs of ``column`` from a mapping that is unique on ``key``."""
    fill = mapping.select(key, F.col(column).alias("_fill"))
    filled = df.join(fill, key, "left").withColumn(column, F.coalesce(column, "_fill"))
    return filled.select(df.columns)
