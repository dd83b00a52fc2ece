"""Currency conversion and revenue bucketing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_usd(
    df: DataFrame, rates: DataFrame, amounts: dict[str, str], currency: str = "revenue_currency"
) -> DataFrame:
    """Add ``amounts`` (input column to output column) in USD at the current rate.

    Any currency that the table has a current rate for is converted. One without gives
    NULL, but USD falls back to 1:1. Of several current rates the lowest id counts. The
    rates are unique by currency; how they are joined is left to the planner, which knows their size.
    """
    current = (
        rates.where("is_current")
        .groupBy(F.col("base_currency").alias(currency))
        .agg(F.min_by("usd_conversion", "id").alias("_rate"))
    )
    rate = F.coalesce("_rate", F.when(F.col(currency) == "USD", 1.0))
    out = df.join(current, currency, "left")
    usd = {name: F.round(F.col(source) * rate, 2) for source, name in amounts.items()}
    kept = [c for c in df.columns if c not in usd]
    return out.select(*kept, *(value.alias(name) for name, value in usd.items()))


def contiguous_bounds(ranges: DataFrame) -> Column:
    """The ranges as one sorted array of (lower bound, range id), each open up to the next lower bound.

    Of ranges with one lower bound the first by order counts. Range 0 stands for unknown and has no bound. One
    row per range is collected: the dimension is a handful of rows. A scalar subquery.
    """
    lower = ranges.where("range_id <> 0 and min_revenue_usd is not null").groupBy(
        F.col("min_revenue_usd").alias("lower")
    ).agg(F.min_by("range_id", F.struct("range_order", "range_id")).alias("range_id"))
    return lower.agg(F.sort_array(F.collect_list(F.struct("lower", "range_id"))).alias("bounds")).scalar()


def _place(bounds: str, value: str) -> str:
    """How many lower bounds are at most ``value``, by halving; SQL text.

    Twenty halvings serve 2^20 ranges; the width is the constant, not the number of ranges.
    """
    step = (
        f"(s, i) -> if(s.lo >= s.hi, s, if({bounds}[cast(floor((s.lo + s.hi) / 2) as int)].lower <= {value}, "
        "named_struct('lo', cast(floor((s.lo + s.hi) / 2) as int) + 1, 'hi', s.hi), "
        "named_struct('lo', s.lo, 'hi', cast(floor((s.lo + s.hi) / 2) as int))))"
    )
    return f"aggregate(sequence(1, 20), named_struct('lo', 0, 'hi', size({bounds})), {step}, s -> s.lo)"


def bucket(
    df: DataFrame, ranges: DataFrame, actual: str, low: str, high: str, out: str, contiguous: bool = False
) -> DataFrame:
    """Add the range of the exact amount, else of the midpoint of low and high, else 0.

    With ``contiguous`` a range reaches up to the next one's lower bound, so no amount from the lowest bound up falls
    between two; it is found by binary search in the sorted lower bounds.

    The first range by order with min <= v <= max wins; 0 stands for unknown. The
    ranges become one array constant (a scalar subquery), so no join is needed.
    """
    if contiguous:
        value = F.coalesce(actual, (F.col(low) + F.col(high)) / 2)
        placed = df.withColumns({"_bounds": contiguous_bounds(ranges), "_value": value})
        at = F.expr(_place("_bounds", "_value"))
        found = F.when(F.col("_value").isNotNull(), F.get("_bounds", at - 1)["range_id"])
        return placed.withColumn(out, F.coalesce(found, F.lit(0))).drop("_bounds", "_value")
    table = (
        ranges.where("range_id <> 0")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("range_order", "range_id", "min_revenue_usd", "max_revenue_usd")
                )
            ).alias("ranges")
        )
        .scalar()
    )
    value = F.coalesce(actual, (F.col(low) + F.col(high)) / 2)
    hits = F.filter(
        "_ranges",
        lambda r: (value >= r["min_revenue_usd"])
        & (r["max_revenue_usd"].isNull() | (value <= r["max_revenue_usd"])),
    )
    range_id = F.coalesce(F.get(hits, F.lit(0))["range_id"], F.lit(0))
    return df.withColumn("_ranges", table).withColumn(out, range_id).drop("_ranges")
