"""Laws of versioned state, dense ids and incremental selection."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from arrpipe.operators import ledger, match, money, state
from arrpipe.schemas import empty
from arrpipe.sources import seeds
from arrpipe.sources.staging import checkpoint_dir

AS_OF = dt.datetime(2026, 1, 1)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_dense_ids_follow_the_order(spark):
    n = 5000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 > 0, F.format_string("A%04d", (F.col("id") * 7919) % n)).alias("a"),
        (F.col("id") % 3).cast("int").alias("b"),
    )
    out = state.dense_ids(rows, ["a", "b"], "i", F.lit(100)).collect()
    keys = [(r["a"] is None, r["a"] or "", r["b"]) for r in sorted(out, key=lambda r: r["i"])]
    assert sorted(r["i"] for r in out) == list(range(101, 101 + n))
    assert keys == sorted(keys)


def test_dense_ids_spread_a_hot_key(spark):
    """A third of all rows under one key lands in several partitions, copies too with a row id."""
    rows = spark.range(0, 30000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"),
        F.lit(1).alias("b"),
        F.col("id").alias("row"),
    )
    parts = rows.repartitionByRange(8, "a", F.xxhash64("row")).withColumn(
        "p", F.spark_partition_id()
    )
    assert parts.where("a = 'hot'").select("p").distinct().count() > 1
    out = state.dense_ids(rows, ["a", "b"], "i", F.lit(0), spread=["row"])
    assert out.select(F.countDistinct("i"), F.max("i"), F.count("*")).first() == (30000,) * 3
    assert out.columns == ["i", "a", "b", "row"]


def test_dense_ids_above_32_bits(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("a"))
    out = state.dense_ids(rows, ["a"], "i", F.lit(2**31 + 5))
    assert dict(out.dtypes)["i"] == "bigint"
    assert sorted(r["i"] for r in out.collect()) == list(range(2**31 + 6, 2**31 + 16))


def test_dense_ids_of_nothing(spark):
    assert state.dense_ids(empty(spark, "dim_company"), ["company_name"], "id", F.lit(0)).count() == 0


def test_new_observations(spark):
    bronze = spark.createDataFrame(
        [("a", 1, 0), ("b", 1, 1), (None, 1, 2), ("a", 2, 3), (None, 2, 4), ("b", 1, 5)],
        "article_id string, batch_id int, k int",
    )
    silver = spark.createDataFrame(
        [("a", 1), (None, 1)], "article_id string, insert_batch_id int"
    )
    out = state.new_observations(bronze, silver)
    # 'b' is missing twice, a NULL id never counts as present, batch 2 is new.
    assert rows_of(out, "k") == [(1,), (2,), (3,), (4,), (5,)]
    everything = bronze.withColumnRenamed("batch_id", "insert_batch_id")
    assert rows_of(state.new_observations(bronze, everything), "k") == [(2,), (4,)]
    # Batch 2 is the newest; a gap in an old batch is found by its ids.
    gap = everything.where("k <> 1 and k <> 5")
    assert rows_of(state.new_observations(bronze, gap), "k") == [(1,), (2,), (4,), (5,)]
    none = everything.limit(0)
    assert state.new_observations(bronze, none).count() == 6


def test_scd2(spark):
    stored = spark.createDataFrame(
        [("a", 1, False), ("a", 2, True), ("b", 1, True), (None, 1, True)],
        "article_id string, v int, is_current boolean",
    )
    batch = spark.createDataFrame([("a", 3), ("c", 1), (None, 2), ("c", 2)], "article_id string, v int")
    out = state.scd2(stored, batch, "article_id")
    assert rows_of(out.where("is_current"), "article_id", "v") == sorted(
        [("a", 3), ("b", 1), ("c", 1), ("c", 2), (None, 1), (None, 2)], key=repr
    )
    assert rows_of(out.where("not is_current"), "article_id", "v") == [("a", 1), ("a", 2)]


def test_scd2_and_match_is_scd2_then_match(spark):
    schema = ("article_id string, v int, company_id int, company_match_kind string, "
              "is_current boolean")
    stored = spark.createDataFrame(
        [("a", 1, None, None, True), ("b", 1, None, None, True), ("c", 1, 9, "Exact", True),
         ("d", 1, None, None, False), (None, 1, None, None, True)], schema,
    )
    batch = spark.createDataFrame(
        [("a", 2, None, None, True), ("e", 1, 3, "Exact", True), (None, 2, None, None, True)], schema
    )
    best = spark.createDataFrame(
        [("a", 5), ("b", 6), ("c", 7), ("d", 8), ("e", 4), ("z", 1)],
        "article_id string, company_id int",
    )
    together = state.scd2_and_match(stored, batch, best)
    apart = match.apply_best(state.scd2(stored, batch, "article_id"), best)
    assert rows_of(together, *stored.columns) == rows_of(apart, *stored.columns)
    assert ("a", 2, 5, "Fuzzy", True) in rows_of(apart, *stored.columns)
    assert ("a", 1, None, None, False) in rows_of(apart, *stored.columns)


def companies(spark, rows):
    return spark.createDataFrame(rows, "company_name string, founded_year int").withColumns(
        {c: F.lit(None).cast(t) for c, t in
         {"headquarters": "string", "employee_count": "int", "industry": "string",
          "is_public": "boolean", "stock_ticker": "string"}.items()}
    ).withColumn("is_current", F.lit(True))


def test_upsert_grows_ids_and_keeps_rows(spark):
    dim = empty(spark, "dim_company")
    first = state.upsert_companies(dim, companies(spark, [("b", 1), ("a", 2)]), AS_OF)
    assert rows_of(first, "id", "company_name", "insert_batch_id", "updated_batch_id") == [
        (1, "a", 1, None), (2, "b", 1, None)
    ]
    second = state.upsert_companies(first, companies(spark, [("b", 7), ("0", 3)]), AS_OF)
    assert rows_of(second, "id", "company_name", "founded_year", "insert_batch_id", "updated_batch_id") == [
        (1, "a", 2, 1, None), (2, "b", 7, 1, 2), (3, "0", 3, 2, None)
    ]
    assert state.audit_counts(second).first() == (3, 2)


def test_last_file_is_current(spark):
    stored = empty(spark, "bronze_company_metadata").select("company_name", "file_name", "is_current")
    batch = spark.createDataFrame(
        [("a", "in/x.json"), ("a", "in/sub/x.json"), ("b", "in/sub/x.json")],
        "company_name string, file_name string",
    ).withColumn("_order", F.split("file_name", "/"))
    out = state.scd2_by_file(stored, batch, "company_name", "_order")
    assert rows_of(out.where("is_current"), "company_name", "file_name") == [
        ("a", "in/x.json"), ("b", "in/sub/x.json")
    ]
    assert out.count() == 3


def test_seeding(spark):
    nothing = empty(spark, "dim_category")
    first = seeds.categories(spark, AS_OF)
    seeded = seeds.seed_if_empty(nothing, first)
    assert seeded.count() == len(seeds.CATEGORIES)
    assert seeds.seed_if_empty(seeded.limit(3), first).count() == 3
    assert seeds.dates(spark).count() == 2557
    assert seeds.dates(spark).agg(F.min("date_id"), F.max("date_id")).first() == (20200101, 20261231)


@pytest.mark.parametrize("make", [seeds.revenue_ranges, seeds.currencies])
def test_seeds_are_plan_constants(spark, make):
    """A known small size lets the planner broadcast them."""
    size = make(spark)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 10_000


def test_repair(spark):
    log = spark.createDataFrame(
        [(v,) for v in (None, "false", "F", "0", "Y", "N", "true")], "alert_processed string"
    )
    out = [r[0] for r in ledger.repair_alerts(log).collect()]
    assert out == ["N", "N", "N", "N", "Y", "N", "true"]


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.sparkContext.getCheckpointDir()
    assert checkpoint_dir(spark) == (named or spark.sparkContext.getCheckpointDir())


def test_newest_only(spark):
    rows = spark.createDataFrame(
        [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4), (None, 1, 5), (None, 1, 6), ("c", None, 7), ("c", None, 8)],
        "k string, b int, id int",
    )
    current = state.newest_only(rows, "k", ["b", "id"]).where("is_current")
    assert sorted(r["id"] for r in current.collect()) == [3, 4, 5, 6, 8]
    # Ties on the whole order stay together.
    assert state.newest_only(rows, "k", ["b"]).where("is_current and k = 'a'").count() == 2
    assert state.newest_only(rows.limit(0), "k", ["b"]).count() == 0


def test_only_changed_keeps_the_batch(spark):
    stored = companies(spark, [("a", 1), ("b", None), ("c", 3)]).withColumn("is_current", F.lit(True))
    dim = state.upsert_companies(empty(spark, "dim_company"), stored, AS_OF)
    later = companies(spark, [("a", 1), ("b", None), ("c", None), ("d", 4)]).withColumn("is_current", F.lit(True))
    out = {r["company_name"]: r for r in state.upsert_companies(dim, later, AS_OF, only_changed=True).collect()}
    assert {n: r["updated_batch_id"] for n, r in out.items()} == {"a": None, "b": None, "c": 2, "d": None}
    assert out["a"]["updated_at"] is None and out["c"]["founded_year"] is None and out["d"]["insert_batch_id"] == 2


@pytest.mark.parametrize("n_ranges", [1, 2, 9, 100])
def test_contiguous_ranges(spark, n_ranges):
    """Binary search against a plain walk over the sorted bounds."""
    ranges = spark.createDataFrame(
        [(0, 0.0, 0.0, "?", 0)] + [(i, i * 10.0 + 1, i * 10.0 + 10, str(i), i) for i in range(1, n_ranges + 1)],
        "range_id int, min_revenue_usd double, max_revenue_usd double, range_name string, range_order int",
    )
    values = [None, -5.0, 0.0, 10.9, 11.0, 20.5, 21.0, 500.5, 1e12, float("inf")]
    rows = spark.createDataFrame([(v, None, None) for v in values] + [(None, 20.0, 21.0)], "a double, l double, h double")
    got = [r["out"] for r in money.bucket(rows, ranges, "a", "l", "h", "out", contiguous=True).collect()]

    def walk(v):
        return max((i for i in range(1, n_ranges + 1) if v is not None and i * 10.0 + 1 <= v), default=0)

    assert got == [walk(v) for v in [*values, 20.5]]
    assert got[5] == 1
    assert money.bucket(rows, ranges, "a", "l", "h", "out").collect()[5]["out"] == 0
    none = money.bucket(rows, ranges.limit(0), "a", "l", "h", "out", contiguous=True)
    assert {r["out"] for r in none.collect()} == {0}
