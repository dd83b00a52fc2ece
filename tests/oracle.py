"""Run a query and its SQL twin and compare the rows, column by column name."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _sorted(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def differences(spark_df, connection, sql: str) -> str | None:
    """None if equal, else a short text."""
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    types = {d[0]: str(d[1]) for d in result.description}
    other_types = {f.name: _TYPES[f.dataType.simpleString()] for f in spark_df.schema.fields}
    if types != other_types:
        return f"types {sorted(set(other_types.items()) ^ set(types.items()))}"
    expected = _sorted(columns, result.fetchall())
    actual = _sorted(spark_df.columns, spark_df.collect())
    if expected == actual:
        return None
    only_sql = [r for r in expected if r not in set(actual)][:3]
    only_spark = [r for r in actual if r not in set(expected)][:3]
    return f"rows {len(actual)} != {len(expected)}; spark {only_spark}; sql {only_sql}"
