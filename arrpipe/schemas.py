"""Table schemas and the column lists the ingest gates check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The input columns and fields every file must have.
ARTICLE_COLUMNS = [
    "article_id", "title", "company_name", "published_date", "category",
    "revenue", "summary", "url", "author", "word_count",
]
COMPANY_FIELDS = [
    "founded_year", "headquarters", "employee_count", "industry", "is_public", "stock_ticker",
]

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """A schema from "name type, ..."; unlike ``fromDDL`` it needs no session."""
    fields = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


COMPANY_VALUE = _struct(
    "founded_year int, headquarters string, employee_count int, "
    "industry string, is_public boolean, stock_ticker string"
)

_COMPANY = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in COMPANY_VALUE.fields)
# The names and types of the tables' columns.
_FACT = (
    "observation_id bigint, article_id string, title string, category_group string, "
    "category_name string, company_matched string, company_name string, revenue_min_usd double, "
    "revenue_max_usd double, revenue_actual_usd double, revenue_range_order int, "
    "revenue_range_name string, industry string, founded_year int, company_age int, "
    "headquarters string, employee_count int, public_private_status string, "
    "stock_ticker string, industry_category string, published_date date, "
    "company_size_category string, year int, month int, mon string, quarter_no string"
)
_COLUMNS = {
    "bronze_articles": ", ".join(f"{c} string" for c in ARTICLE_COLUMNS)
    + ", file_name string, file_timestamp timestamp, insert_datetime timestamp, batch_id int",
    "bronze_company_metadata": f"company_name string, {_COMPANY}"
    + ", file_name string, file_timestamp timestamp, insert_datetime timestamp, is_current boolean",
    "bronze_file_log": "batch_id int, file_name string, file_timestamp timestamp, reason string, "
    "status string, quarantined_at timestamp, processed_at timestamp, alert_processed string, path string",
    "dim_company": f"id bigint, company_name string, {_COMPANY}"
    + ", insert_batch_id int, updated_batch_id int, inserted_at timestamp, updated_at timestamp",
    "dim_category": "id int, name string, category_group string, insert_datetime timestamp",
    "dim_revenue_range": "range_id int, min_revenue_usd double, max_revenue_usd double, "
    "range_name string, range_order int",
    "dim_date": "date_id int, date date, year int, month int, day int, quarter_no int",
    "dim_currency_conversion": "id int, base_currency string, usd_conversion double, "
    "is_current boolean",
    "silver_observations": "observation_id bigint, article_id string, title string, company_id bigint, "
    "company_match_kind string, company_name_raw string, published_date_as_source string, "
    "published_date date, category_id int, revenue_as_source string, revenue_currency string, "
    "revenue_actual double, revenue_actual_usd double, revenue_min double, "
    "revenue_min_actual_usd double, revenue_max double, revenue_max_actual_usd double, "
    "revenue_range_id int, summary string, url string, author string, word_count int, "
    "insert_batch_id int, updated_batch_id int, inserted_at timestamp, updated_at timestamp, "
    "is_current boolean",
    "silver_quarantine": ", ".join(f"{c} string" for c in ARTICLE_COLUMNS)
    + ", file_name string, file_timestamp timestamp, batch_id int, reason string",
    "name_matches": "company_name string, priority int, company_id bigint, seen_id bigint, rules string",
    "run_audit": "table_name string, counter string, n bigint, recorded_at timestamp",
    "silver_articles": _FACT,
    "gold_fact_arr_observation": f"{_FACT}, arr_usd double, gold_loaded_at timestamp",
}
SCHEMAS: dict[str, T.StructType] = {name: _struct(columns) for name, columns in _COLUMNS.items()}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``df`` in the declared order; a column it lacks is added as NULL."""
    present = set(df.columns)
    return df.selectExpr(
        *(
            f"cast({f.name if f.name in present else 'null'} as {f.dataType.simpleString()}) "
            f"as {f.name}"
            for f in SCHEMAS[table].fields
        )
    )
