"""Raw tables to dimensions, observations and the fact table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import marts, match, state
from ..schemas import conform
from ..sources import seeds
from ..sources.staging import stage
from ..sources.tables import Tables
from .options import Options


def seed_dimensions(spark: SparkSession, tables: Tables, as_of: dt.datetime) -> None:
    """Fill dimensions that are empty; carry the others over."""
    first = seeds.categories(spark, as_of)
    category = seeds.seed_if_empty(tables.latest("dim_category"), first)
    tables.replace("dim_category", seeds.backfill(category, first, "id", "category_group"))
    for name, seed in (
        ("dim_revenue_range", seeds.revenue_ranges(spark)),
        ("dim_date", seeds.dates(spark)),
    ):
        tables.replace(name, seeds.seed_if_empty(tables.latest(name), seed))
    rates = seeds.currencies(spark)
    known = seeds.seed_if_empty(tables.latest("dim_currency_conversion"), rates)
    dollar = rates.where("base_currency = 'USD'")
    tables.replace("dim_currency_conversion", seeds.insert_missing(known, dollar, "base_currency"))


def run_silver(
    spark: SparkSession, tables: Tables, as_of: dt.datetime, options: Options = Options()
) -> None:
    draft = tables.draft()
    seed_dimensions(spark, tables, as_of)
    tables.replace(
        "dim_company",
        state.upsert_companies(
            tables.latest("dim_company"), draft.current("bronze_company_metadata"), as_of, options.only_changed
        ),
        {"never_updated": F.count_if(F.col("updated_batch_id").isNull())},
    )
    companies = draft.latest("dim_company")
    categories, ranges = draft.latest("dim_category"), draft.latest("dim_revenue_range")

    bronze = draft.appended("bronze_articles", row_id="_row")
    known = tables.current_and_history("silver_observations")
    current = tables.current("silver_observations")
    if options.require_id:
        tables.append("silver_quarantine", state.without_id(bronze, tables.appended("silver_quarantine")))
    before = known.agg(F.coalesce(F.max("observation_id"), F.lit(0)).alias("id")).first()["id"]
    run = state.dense_ids(
        state.new_observations(bronze, known, options.require_id),
        ["article_id", "batch_id"],
        "observation_id",
        F.lit(before),
        spread=["_row"],
    )
    batch = conform(marts.observations(run, companies, categories, as_of), "silver_observations")
    if options.latest_only:
        batch = state.newest_only(batch, "article_id", ["insert_batch_id", "observation_id"])
    # Of the current rows, those that the batch leaves current.
    arrived = run.where("article_id is not null").select("article_id").distinct()  # the batch's, without its joins
    still_open = current.where("company_id is null").join(arrived, "article_id", "left_anti")
    open_rows = still_open.unionByName(batch.where("is_current and company_id is null"))
    names = stage(match.article_names(open_rows, bronze, options.all_versions), "article-names")
    best = match.update_best(names, companies, tables.latest("name_matches"), options.aliases)
    tables.replace("name_matches", best)
    found = match.best_of_articles(names, draft.latest("name_matches"))
    rows = state.scd2_and_match(current, batch, found, arrived)
    rates = draft.latest("dim_currency_conversion")
    tables.replace_current(
        "silver_observations",
        marts.revalue(rows, rates, ranges, as_of, options.contiguous),
        {
            "current": F.count_if("is_current"),
            "inserted": F.count_if(F.col("observation_id") > before),
            "matched_fuzzy": F.count_if(F.col("is_current") & (F.col("company_match_kind") == "Fuzzy")),
        },
    )
    tables.replace(
        "silver_articles",
        marts.fact_articles(
            draft.current("silver_observations"), companies, categories, ranges,
            draft.latest("dim_date"), as_of.date(),
        ),
    )
