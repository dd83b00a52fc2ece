"""The fact table to the gold table and its extracts."""

from __future__ import annotations

import datetime as dt

from ..operators import marts
from ..sources.export import write_csv
from ..sources.tables import Tables


def run_gold(tables: Tables, as_of: dt.datetime) -> None:
    fact = tables.draft().latest("silver_articles")
    tables.replace("gold_fact_arr_observation", marts.gold_fact(fact, as_of))


def export(tables: Tables, output: str) -> None:
    """CSV extracts of the published observations, fact, gold table and use-case mart."""
    gold = tables.latest("gold_fact_arr_observation")
    write_csv(tables.current_and_history("silver_observations"), f"{output}/silver_observations")
    write_csv(tables.latest("silver_articles"), f"{output}/silver_articles")
    write_csv(gold, f"{output}/ai_articles_enriched")
    write_csv(marts.ai_revenue_mart(gold), f"{output}/ai_ml_arr_gt_50m_2022_2024")
