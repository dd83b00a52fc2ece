"""Versioned and merged state: pure functions from (state, batch) to the next state."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import COMPANY_FIELDS, conform
from ..sources.staging import stage
from .match import fill_company

_INDEX_BITS = 33  # row index within a partition, as in monotonically_increasing_id


def next_batch_id(df: DataFrame, *columns: str) -> Column:
    """1 + the greatest batch id in ``columns``, 1 for no rows; a scalar subquery."""
    ids = [F.coalesce(F.col(c), F.lit(0)) for c in columns]
    greatest = ids[0] if len(ids) == 1 else F.greatest(*ids)
    return df.agg((F.coalesce(F.max(greatest), F.lit(0)) + 1).cast("int").alias("id")).scalar()


def dense_ids(
    rows: DataFrame, order: list[str], id_column: str, after: Column, spread: list[str] | None = None
) -> DataFrame:
    """Number rows ``after`` + 1, +2, ... by ``order`` (NULLs last) without a global window.

    Rows are range-partitioned and sorted on ``order`` and then a hash of the
    ``spread`` columns (default: the whole row), so that a hot value of ``order`` spreads
    over partitions; name a column unique per row where full copies may be frequent.
    The sorted rows are written to the shared checkpoint folder, which fixes their
    positions: counting reads one column of that table, numbering reads it all, and an
    executor lost in between changes nothing. What remains is a running sum over one
    count per partition.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    keys.append(F.col("_spread").asc())
    placed = (
        rows.withColumn("_spread", F.xxhash64(*(spread or rows.columns)))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_spread")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    fixed = stage(placed, "ids")
    partition = F.shiftrightunsigned("_at", _INDEX_BITS)
    counts = fixed.groupBy(partition.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the window and the broadcast are bounded by their number.
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_n"))
    index = F.col("_at").bitwiseAND((1 << _INDEX_BITS) - 1)
    return (
        fixed.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn(id_column, (after + F.col("_n") + index + 1).cast("bigint"))
        .select(id_column, *rows.columns)
    )


def max_id(df: DataFrame, column: str) -> Column:
    """The greatest id, 0 for no rows; a scalar subquery."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint").alias("id")).scalar()


def _key_sums(df: DataFrame) -> DataFrame:
    """Per batch, a fingerprint of its article ids: count, xor and sum of hashes."""
    key = F.xxhash64("article_id")
    return df.where("article_id is not null").groupBy("batch_id").agg(
        F.count("*").alias("n"),
        F.bit_xor(key).alias("x"),
        F.sum(key.bitwiseAND(0xFFFFFF)).alias("s"),
    )


NO_ARTICLE_ID = "article_id is missing"


def new_observations(bronze: DataFrame, silver: DataFrame, require_id: bool = False) -> DataFrame:
    """Bronze rows whose (article_id, batch_id) silver lacks; a NULL never counts as present.

    With ``require_id`` rows without an article id are left out; ``without_id`` has them.

    Nearly always that is the newest batch and the rows without an id, which plain
    filters find: the files of old batches are then skipped by their statistics. An old
    batch can hold more only if its ids and silver's differ, which one aggregate over
    narrow columns tells; just those batches are compared by key.
    """
    newest = silver.agg(F.coalesce(F.max("insert_batch_id"), F.lit(0)).alias("b")).first()["b"]
    old = bronze.where(F.col("batch_id") <= newest)
    present = silver.select("article_id", F.col("insert_batch_id").alias("batch_id"))
    differing = (
        _key_sums(old).join(_key_sums(present), ["batch_id", "n", "x", "s"], "left_anti")
        .select("batch_id")
    )
    missing = old.join(differing, "batch_id", "left_semi").where("article_id is not null").join(
        present, ["article_id", "batch_id"], "left_anti"
    )
    ahead = bronze.where(F.col("batch_id") > newest)
    if require_id:
        return ahead.where("article_id is not null").unionByName(missing.select(bronze.columns))
    return (
        ahead.unionByName(old.where("article_id is null"))
        .unionByName(missing.select(bronze.columns))
    )


def without_id(bronze: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Bronze rows without an article id, with a reason, of batches after those that ``quarantine`` holds."""
    done = max_id(quarantine, "batch_id")
    return bronze.where(F.col("article_id").isNull() & (F.col("batch_id") > done)).withColumn(
        "reason", F.lit(NO_ARTICLE_ID)
    )


def newest_only(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Flag ``is_current``: of the rows with one key, those greatest by ``order``; every row without a key.

    End ``order`` with a column unique per row to get exactly one. Only the key and the order are shuffled and
    aggregated, so a key that many rows share costs one narrow row per task.
    """
    greatest = (
        batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order)).alias("_newest"))
    )
    flag = F.col(key).isNull() | F.struct(*order).eqNullSafe(F.col("_newest"))
    columns = [c for c in batch.columns if c != "is_current"]
    return batch.join(greatest, key, "left").select(*columns, flag.alias("is_current"))


def expire(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Current rows whose key is in ``batch`` stop being current; other rows stay as they are."""
    hit = batch.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        state.join(hit, key, "left")
        .withColumn("is_current", F.col("is_current") & F.col("_hit").isNull())
        .select(state.columns)
    )


def scd2(state: DataFrame, batch: DataFrame, key: str, latest_only: list[str] | None = None) -> DataFrame:
    """``expire``, then append the batch; all its rows become current.

    With ``latest_only``, only a key's row that is greatest by these columns does.
    """
    flagged = newest_only(batch, key, latest_only) if latest_only else batch.withColumn("is_current", F.lit(True))
    return expire(state, batch, key).unionByName(flagged.select(state.columns))


def scd2_and_match(
    state: DataFrame, batch: DataFrame, best: DataFrame, arrived: DataFrame | None = None
) -> DataFrame:
    """``scd2`` by article_id and ``match.apply_best`` in one join of the wide rows.

    The batch's rows are current as their own ``is_current`` says. ``arrived`` has the distinct article ids
    of the batch, where they are known without its joins.

    Both act on article_id, so their narrow sides are joined first. The wide side then
    takes part in a single join, which adaptive execution can split at a hot article_id.
    """
    hits = batch.where("article_id is not null").select("article_id").distinct() if arrived is None else arrived
    changes = hits.withColumn("_hit", F.lit(True)).join(
        best.select("article_id", F.col("company_id").alias("_found")), "article_id", "full"
    )
    rows = (
        state.withColumn("_new", F.lit(False))
        .unionByName(
            batch.select(state.columns).withColumn("_new", F.lit(True))
        )
        .join(changes, "article_id", "left")
        .withColumn("is_current", F.col("is_current") & (F.col("_new") | F.col("_hit").isNull()))
    )
    return fill_company(rows).select(state.columns)


def scd2_by_file(state: DataFrame, batch: DataFrame, key: str, file_order: str) -> DataFrame:
    """``scd2`` for several files applied in order: the last file with a key is current."""
    latest = batch.groupBy(key).agg(F.max(file_order).alias("_latest"))
    flagged = batch.join(latest, key).withColumn(
        "is_current", F.col(file_order).eqNullSafe(F.col("_latest"))
    )
    return expire(state, batch, key).unionByName(flagged.select(state.columns))


def upsert_companies(
    dim: DataFrame, metadata: DataFrame, as_of: dt.datetime, only_changed: bool = False
) -> DataFrame:
    """Merge current company metadata into the dimension by name.

    Every matched row takes the new values and the next company batch id, changed
    or not; new names get dense ids in name order; no row is deleted. With ``only_changed``
    a matched row whose values, NULLs included, are those it has keeps its batch id and time.
    """
    batch_id = next_batch_id(dim, "insert_batch_id", "updated_batch_id")
    now = F.lit(as_of).cast("timestamp")
    source = metadata.where("is_current").select("company_name", *COMPANY_FIELDS)
    matched = dim.alias("d").join(
        source.withColumn("_hit", F.lit(True)).alias("s"), "company_name", "left"
    )
    hit = F.col("_hit").isNotNull()
    if only_changed:
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in COMPANY_FIELDS]
        hit = hit & ~reduce(Column.__and__, same)
    kept = matched.select(
        "d.id",
        "company_name",
        *(F.when(hit, F.col(f"s.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in COMPANY_FIELDS),
        "insert_batch_id",
        F.when(hit, batch_id).otherwise(F.col("updated_batch_id")).alias("updated_batch_id"),
        "inserted_at",
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    added = new_company_keys(dim, source).withColumns(
        {"insert_batch_id": batch_id, "inserted_at": now}
    )
    return kept.unionByName(conform(added, "dim_company"))


def new_company_keys(dim: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of ``source`` with a name the dimension lacks, under dense new ids."""
    new = source.join(dim, "company_name", "left_anti")
    return dense_ids(new, ["company_name"], "id", max_id(dim, "id"))


def audit_counts(dim: DataFrame) -> DataFrame:
    """Row count, and how many rows no later batch has updated."""
    return dim.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("updated_batch_id").isNull()).alias("never_updated"),
    )
