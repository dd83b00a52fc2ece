"""Observation rows, the fact table, the gold table and the use-case mart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse_date, parse_revenue, to_int
from .match import match_exact
from .money import bucket, to_usd

# What counts as AI/ML, the years and the amount of the use case.
_AI_GROUP = "AI/ML"
_AI_CATEGORIES = ["machine learning", "ai/ml", "ai & ml", "artificial intelligence"]
_AI_INDUSTRIES = ["ai/ml", "machine learning", "artificial intelligence"]
_USE_CASE_YEARS = (2022, 2024)
_USE_CASE_MIN_USD = 50_000_000

_USD = {
    "revenue_actual": "revenue_actual_usd",
    "revenue_min": "revenue_min_actual_usd",
    "revenue_max": "revenue_max_actual_usd",
}


def category_lookup(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Add category_id by equal, case-sensitive name."""
    found = categories.select(F.col("name").alias("category"), F.col("id").alias("category_id"))
    return articles.join(found, "category", "left")


def observations(
    articles: DataFrame, companies: DataFrame, categories: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Bronze articles with typed columns and dimension keys, before any money conversion.

    Texts are parsed before the keys are joined, as a name that several companies share repeats its article.
    """
    now = F.lit(as_of).cast("timestamp")
    typed = (
        articles.withColumn("_rev", parse_revenue("revenue"))
        .withColumns(
            {
                # Raw names are kept by article id: without one there is none.
                "company_name_raw": F.when(F.col("article_id").isNotNull(), F.col("company_name")),
                "published_date_as_source": F.col("published_date"),
                "published_date": parse_date("published_date", as_of.date()),
                "revenue_as_source": F.col("revenue"),
                "revenue_currency": F.col("_rev.currency"),
                "revenue_actual": F.col("_rev.actual"),
                "revenue_min": F.col("_rev.min"),
                "revenue_max": F.col("_rev.max"),
                "word_count": to_int("word_count"),
                "insert_batch_id": F.col("batch_id"),
                "updated_batch_id": F.col("batch_id"),
                "inserted_at": now,
                "updated_at": now,
                "is_current": F.lit(True),
            }
        )
        .drop("_rev", "revenue", "batch_id")
    )
    return category_lookup(match_exact(typed, companies), categories).drop("company_name", "category")


def revalue(
    rows: DataFrame, rates: DataFrame, ranges: DataFrame, as_of: dt.datetime, contiguous: bool = False
) -> DataFrame:
    """USD amounts and range of current rows at today's rates and ranges.

    Rows that are history keep the values they had.
    """
    current = F.col("is_current")
    new = {source: f"_{name}" for source, name in _USD.items()}
    out = bucket(to_usd(rows, rates, new), ranges, *new.values(), "_range_id", contiguous)
    values = {name: F.col(f"_{name}") for name in _USD.values()}
    values |= {
        "revenue_range_id": F.col("_range_id"), "updated_at": F.lit(as_of).cast("timestamp")
    }
    return out.withColumns(
        {c: F.when(current, value).otherwise(F.col(c)) for c, value in values.items()}
    ).select(rows.columns)


def fact_articles(
    rows: DataFrame,
    companies: DataFrame,
    categories: DataFrame,
    ranges: DataFrame,
    dates: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """Current observations with their company, category, range and date attributes."""
    seen = rows.where("is_current").alias("seen")
    joined = (
        seen.join(companies.alias("firm"), F.col("firm.id") == F.col("seen.company_id"), "left")
        .join(categories.alias("topic"), F.col("topic.id") == F.col("seen.category_id"), "left")
        .join(ranges.alias("band"), F.col("band.range_id") == F.col("seen.revenue_range_id"), "left")
        .join(dates.alias("day"), F.col("day.date") == F.col("seen.published_date"), "left")
    )
    kind, staff = F.col("seen.company_match_kind"), F.col("firm.employee_count")
    exact = F.col("seen.revenue_actual_usd")
    public = F.col("firm.is_public")
    values = {
        "observation_id": F.col("seen.observation_id"),
        "article_id": F.col("seen.article_id"),
        "title": F.col("seen.title"),
        "category_group": F.col("topic.category_group"),
        "category_name": F.col("topic.name"),
        "company_matched": F.coalesce(kind, F.lit("Not matched")),
        "company_name": F.when(kind.isNotNull(), F.col("firm.company_name")).otherwise(F.col("seen.company_name_raw")),
        "revenue_min_usd": F.coalesce("seen.revenue_min_actual_usd", exact),
        "revenue_max_usd": F.coalesce("seen.revenue_max_actual_usd", exact),
        "revenue_actual_usd": exact,
        "revenue_range_order": F.col("band.range_order"),
        "revenue_range_name": F.col("band.range_name"),
        **{c: F.col(f"firm.{c}") for c in ("industry", "founded_year", "headquarters", "employee_count", "stock_ticker")},
        "company_age": F.lit(as_of.year) - F.col("firm.founded_year"),
        "public_private_status": F.when(public, "Public").when(~public, "Private").otherwise("Unknown"),
        "industry_category": F.concat_ws(" - ", "firm.industry", "topic.category_group"),
        "published_date": F.col("seen.published_date"),
        "company_size_category": F.when(staff < 10000, "Small").when(staff <= 30000, "Medium")
        .when(staff > 30000, "Large").otherwise("Unknown"),
        "year": F.col("day.year"),
        "month": F.col("day.month"),
        "mon": F.date_format("seen.published_date", "MMM"),
        "quarter_no": F.concat_ws("", F.lit("Q"), F.col("day.quarter_no")),
    }
    return joined.select(*(value.alias(name) for name, value in values.items()))


def gold_fact(fact: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The fact with its annual revenue figure: exact, else the middle of the range."""
    middle = (F.col("revenue_min_usd") + F.col("revenue_max_usd")) / 2
    return fact.withColumns(
        {
            "arr_usd": F.coalesce("revenue_actual_usd", middle),
            "gold_loaded_at": F.lit(as_of).cast("timestamp"),
        }
    )


def ai_revenue_mart(gold: DataFrame) -> DataFrame:
    """AI/ML observations of 2022-2024 with more than 50 million USD."""
    return gold.where(
        (
            (F.col("category_group") == _AI_GROUP)
            | F.lower("category_name").isin(_AI_CATEGORIES)
            | F.lower("industry").isin(_AI_INDUSTRIES)
        )
        & F.col("year").between(*_USE_CASE_YEARS)
        & (F.col("arr_usd") > _USE_CASE_MIN_USD)
    )
