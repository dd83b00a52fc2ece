"""The scalar functions as SQL functions, for use in ``spark.sql``."""

import datetime as dt

from pyspark.sql import SparkSession

from .dates import parse_date_sql
from .names import aliases_sql, compact_sql, initials_sql, normal_sql, synonyms_sql
from .revenue import parse_revenue_sql


def register(spark: SparkSession, as_of: dt.date) -> None:
    functions = {
        "normalize_company_name": ("string", normal_sql("name")),
        "normalize_company_compact": ("string", compact_sql("name")),
        "company_name_initials": ("string", initials_sql("name")),
        "company_name_synonyms": ("array<string>", synonyms_sql("name")),
        "company_name_aliases": ("array<string>", aliases_sql("name")),
        "parse_date": ("date", parse_date_sql("name", f"date'{as_of.isoformat()}'")),
        "parse_revenue": (
            "struct<currency: string, actual: double, min: double, max: double>",
            parse_revenue_sql("name"),
        ),
    }
    for function, (returns, body) in functions.items():
        spark.sql(
            f"create or replace temporary function {function}(name string) "
            f"returns {returns} return {body}"
        )
