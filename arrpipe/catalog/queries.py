"""One query per operator, each over whole tables; results hold no load times."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aliases, compact, initials, normal, parse_date, parse_revenue
from ..functions import register, synonyms, to_int
from ..functions.names import AliasRules, keys
from ..operators import gates, ledger, marts, match, money, state
from ..plans import batch, bronze
from ..schemas import ARTICLE_COLUMNS, COMPANY_FIELDS, conform, empty
from ..sources import export, landing, seeds
from ..sources.staging import checkpoint_dir, stage
from .inputs import AS_OF, articles, companies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_VALUE_COLUMNS = ["revenue_actual_usd", "revenue_min_actual_usd", "revenue_max_actual_usd"]


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


# -- shared steps ----------------------------------------------------------------------


def _observations(spark: SparkSession, rows: DataFrame, firms: DataFrame) -> DataFrame:
    """Typed, exactly matched, converted and bucketed articles, all current; keyed by k."""
    typed = marts.observations(rows, firms, seeds.categories(spark, AS_OF), AS_OF)
    typed = conform(
        typed.withColumn("observation_id", F.col("k")), "silver_observations"
    )
    return marts.revalue(typed, seeds.currencies(spark), seeds.revenue_ranges(spark), AS_OF)


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = companies(spark, sf_dir)
    return marts.fact_articles(
        _observations(spark, articles(spark, sf_dir), firms), firms,
        seeds.categories(spark, AS_OF), seeds.revenue_ranges(spark), seeds.dates(spark),
        AS_OF.date(),
    )


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.gold_fact(_fact(spark, sf_dir), AS_OF).drop("gold_loaded_at")


def _changed(df: DataFrame) -> DataFrame:
    """A later delivery: public or unclassified companies with one employee more."""
    return df.where("is_public or is_public is null").withColumn(
        "employee_count", F.col("employee_count") + 1
    )


def _metadata(df: DataFrame, file_name: str, is_current: bool = True) -> DataFrame:
    named = df.withColumns({"file_name": F.lit(file_name), "is_current": F.lit(is_current)})
    return conform(named, "bronze_company_metadata")


_METADATA_OUT = ["company_name", *COMPANY_FIELDS, "file_name", "is_current"]


def _stored_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company dimension that lacks the unlisted companies."""
    rows = companies(spark, sf_dir).where("stock_ticker is not null")
    return conform(
        rows.withColumns(
            {
                "insert_batch_id": F.when(F.col("is_public"), 2).otherwise(1),
                "updated_batch_id": F.when(F.col("employee_count") > 20000, 4),
            }
        ),
        "dim_company",
    )


def _export_articles(df: DataFrame, path: str, columns: list[str]) -> None:
    # The reader's own escape and single-line records, as in landing files.
    df.select(*columns).write.options(header=True, ignoreTrailingWhiteSpace=False).csv(path)


def _export_companies(df: DataFrame, path: str) -> None:
    """JSON objects keyed by company name, about a thousand companies a file."""
    n_files = 1 + df.count() // 1000
    name = F.to_json(F.array("company_name"))
    pair = F.concat(
        F.substr(name, F.lit(2), F.length(name) - 2),
        F.lit(":"),
        F.to_json(F.struct(*COMPANY_FIELDS), {"ignoreNullFields": "false"}),
    )
    objects = df.groupBy(F.pmod(F.xxhash64("company_name"), F.lit(n_files)).alias("part")).agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ","), F.lit("}")).alias("value")
    )
    objects.write.partitionBy("part").text(path)


def _deliver(spark: SparkSession, df: DataFrame, root: str, sep: str, parts: int) -> None:
    """Write ``parts`` CSV files, /part=<i>/one.csv below ``root``, in place of what stands there."""
    folder = f"{root}.parts"
    part = F.pmod(F.xxhash64("title", "url"), F.lit(parts)).alias("part")
    df.select("*", part).repartition(parts, "part").write.mode("overwrite").partitionBy("part").options(
        header=True, sep=sep, escape='"'
    ).csv(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path_of = jvm.org.apache.hadoop.fs.Path
    fs = path_of(root).getFileSystem(conf)
    for written in fs.globStatus(path_of(f"{folder}/part=*/part-*")):
        target = path_of(f"{root}/{written.getPath().getParent().getName()}/one.csv")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        fs.rename(written.getPath(), target)
    fs.delete(path_of(folder), True)


# -- ingest ----------------------------------------------------------------------------


@_query
def csv_ingest_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write articles in two column orders, find the files, pass the gate, read them back."""
    root, rows = _scratch(spark), articles(spark, sf_dir)
    _export_articles(rows.where("batch_id < 3"), f"{root}/a", ARTICLE_COLUMNS)
    _export_articles(rows.where("batch_id = 3"), f"{root}/b/c", ["k", *ARTICLE_COLUMNS[::-1]])
    _, loaded = bronze.gate_articles(spark, landing.discover(spark, root, "csv"))
    return loaded.select(*ARTICLE_COLUMNS)


@_query
def csv_schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per delivery folder: gate outcome and rows loaded."""
    root, rows = _scratch(spark), articles(spark, sf_dir)
    without = [c for c in ARTICLE_COLUMNS if c not in ("revenue", "author")]
    _export_articles(rows.where("batch_id = 1"), f"{root}/complete", ARTICLE_COLUMNS)
    _export_articles(rows.where("batch_id = 2"), f"{root}/short", without)
    _export_articles(
        rows.where("batch_id = 3").withColumnRenamed("title", "Title"), f"{root}/cased",
        ["Title" if c == "title" else c for c in ARTICLE_COLUMNS],
    )
    files, loaded = bronze.gate_articles(spark, landing.discover(spark, root, "csv"))
    folder = F.element_at(F.split("path", "/"), -2).alias("folder")
    counts = loaded.groupBy("file_name").agg(F.count("*").alias("n"))
    logged = ledger.log_rows(files.select(*ledger.FILE_KEY, "reason"), 1, AS_OF)
    return (
        files.select(folder, "file_name")
        .join(logged.select("file_name", "status", "reason"), "file_name")
        .join(counts, "file_name", "left")
        .groupBy("folder", "status", "reason")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    )


@_query
def csv_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paths delivered three times: in order, with columns reversed and another separator, without revenue.

    Their number follows the rows, a hundred thousand or so a file.
    """
    root, rows = _scratch(spark), articles(spark, sf_dir)
    parts = 2 + rows.count() // 300_000
    outcomes = []
    layouts = [(ARTICLE_COLUMNS, ","), (ARTICLE_COLUMNS[::-1], ";"), ([c for c in ARTICLE_COLUMNS if c != "revenue"], ",")]
    for delivery, (columns, sep) in enumerate(layouts, 1):
        _deliver(spark, rows.where(F.col("batch_id") == delivery).select(columns), f"{root}/in", sep, parts)
        files, loaded = bronze.gate_articles(spark, landing.discover(spark, f"{root}/in", "csv"), {"sep": sep})
        counted = loaded.agg(
            F.count("title").alias("n"), F.count_if(F.col("article_id").startswith("A")).alias("n_ids"),
            F.count("word_count").alias("n_words"),
        )
        status = F.when(F.col("reason").isNull(), "success").otherwise("quarantined").alias("status")
        gated = files.select(status).distinct().select("*", F.lit(delivery).alias("delivery"))
        counted = counted.withColumn("delivery", F.lit(delivery))
        outcomes.append(stage(gated.join(counted, "delivery"), "redelivery"))
    return reduce(DataFrame.unionByName, outcomes)


@_query
def json_ingest_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write companies as JSON objects keyed by name, a thousand or so a file; read them back."""
    root = _scratch(spark)
    _export_companies(companies(spark, sf_dir), root)
    _, loaded = bronze.gate_companies(spark, landing.discover(spark, root, "txt"))
    return loaded.select("company_name", *COMPANY_FIELDS)


@_query
def json_schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small JSON document per article, in seven shapes, two of them good."""
    some = '"founded_year":1999,"headquarters":null,"employee_count":1,"industry":"x"'
    rest = '"is_public":true,"stock_ticker":'
    value = (
        F.when(F.col("k") % 7 == 0, f'{{"Acme":{{{some}}}}}')
        .when(F.col("k") % 7 == 1, f'{{"Acme":{{{some},{rest}null}}}}')
        # Text fields take any JSON value; whole numbers must fit.
        .when(F.col("k") % 7 == 2, f'{{"Acme":{{{some},{rest}7203}}}}')
        .when(F.col("k") % 7 == 3, '{"Acme":[1]}')
        .when(F.col("k") % 7 == 4, '["Acme"]')
        .when(F.col("k") % 7 == 5, f'{{"Acme":{{{some.replace(":1,", ":3000000000,")},{rest}null}}}}')
        .otherwise('{"Acme":')
    )
    objects = articles(spark, sf_dir).select(
        F.col("k").cast("string").alias("path"), value.alias("value")
    )
    bad, loaded = gates.check_companies(landing.parse_objects(objects))
    outcome = bad.select("path", "reason").unionByName(
        loaded.select("path", F.concat_ws(" ", F.lit("loaded"), "stock_ticker").alias("reason"))
    )
    return outcome.groupBy("reason").agg(F.count("*").alias("n"))


@_query
def file_ledger_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily author files not loaded before; the same name with a newer time counts as new."""
    delivered = articles(spark, sf_dir).select(
        F.concat("author", F.lit(".csv")).alias("file_name"),
        F.timestamp_seconds(F.col("k") * 86400).alias("file_timestamp"),
        "category",
    )
    loaded = delivered.where("category in ('AI/ML', 'Cloud')")
    pending = ledger.pending(delivered.drop("category"), loaded)
    return pending.select("file_name", F.to_date("file_timestamp").alias("day"))


@_query
def file_ledger_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author files of four folders and three days, known by path and time: equal names elsewhere are other files."""
    delivered = articles(spark, sf_dir).select(
        F.concat("author", F.lit(".csv")).alias("file_name"),
        F.concat(F.lit("/in/"), F.col("k") % 4, F.lit("/"), "author", F.lit(".csv")).alias("path"),
        F.timestamp_seconds((F.col("k") % 3) * 86400).alias("file_timestamp"),
        "category",
    )
    loaded = delivered.where("category in ('AI/ML', 'Cloud')")
    pending = ledger.pending(delivered.drop("category"), loaded, identity="path")
    day = F.unix_date(F.to_date("file_timestamp")).cast("bigint").alias("day")
    return pending.groupBy("path", day).agg(F.count("*").alias("n"))


@_query
def file_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with their conditional timestamps; a reason means quarantine."""
    files = articles(spark, sf_dir).select(
        F.col("url").alias("file_name"),
        F.lit(None).cast("timestamp").alias("file_timestamp"),
        F.when(F.col("word_count") == "many", "bad word count").alias("reason"),
    )
    rows = articles(spark, sf_dir)
    log = ledger.log_rows(files, state.next_batch_id(rows, "batch_id"), AS_OF)
    return log.select(
        "batch_id", "file_name", "reason", "status", "alert_processed",
        F.col("quarantined_at").isNotNull().alias("has_quarantined_at"),
        F.col("processed_at").isNotNull().alias("has_processed_at"),
    )


@_query
def ledger_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = "case k % 6 when 0 then null when 1 then 'false' when 2 then 'F' when 3 then '0' " \
           "when 4 then 'Y' else 'N' end"
    log = articles(spark, sf_dir).select("k", F.expr(flag).alias("alert_processed"))
    return ledger.repair_alerts(log)


@_query
def article_batch_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir)
    return rows.agg((F.coalesce(F.max("batch_id"), F.lit(0)) + 1).alias("batch_id"))


# -- dimensions ------------------------------------------------------------------------


@_query
def seed_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded category dimension with the articles of each."""
    dim = seeds.seed_if_empty(empty(spark, "dim_category"), seeds.categories(spark, AS_OF))
    used = marts.category_lookup(articles(spark, sf_dir), dim).groupBy("category_id").count()
    return dim.join(used, F.col("id") == F.col("category_id"), "left").select(
        "id", "name", "category_group", F.coalesce("count", F.lit(0)).alias("n_articles")
    )


@_query
def seed_category_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension that already has rows is not seeded."""
    names = articles(spark, sf_dir).groupBy("category").agg(F.min("k").alias("k"))
    dim = conform(
        names.select(F.col("k").cast("int").alias("id"), F.col("category").alias("name")),
        "dim_category",
    )
    seeded = seeds.seed_if_empty(dim, seeds.categories(spark, AS_OF))
    return seeded.select("id", "name", "category_group")


@_query
def backfill_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles' categories as an old dimension without groups, filled by name."""
    old = articles(spark, sf_dir).select("k", F.col("category").alias("name"))
    dim = seeds.add_column_if_absent(old, "category_group", "string").withColumn(
        "category_group", F.when(F.col("name") == "Cloud", "Kept").otherwise(F.col("category_group"))
    )
    return seeds.backfill(dim, seeds.categories(spark, AS_OF), "name", "category_group")


@_query
def seed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded revenue ranges with the articles in each."""
    dim = seeds.seed_if_empty(empty(spark, "dim_revenue_range"), seeds.revenue_ranges(spark))
    rows = _observations(spark, articles(spark, sf_dir), companies(spark, sf_dir))
    used = rows.groupBy(F.col("revenue_range_id").alias("range_id")).count()
    return dim.join(used, "range_id", "left").select(
        *dim.columns, F.coalesce("count", F.lit(0)).alias("n_articles")
    )


@_query
def seed_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that lack the dollar get it; articles per currency."""
    old = seeds.currencies(spark).where("base_currency <> 'USD'")
    rates = seeds.seed_if_empty(old, seeds.currencies(spark))
    dim = seeds.insert_missing(rates, seeds.currencies(spark), "base_currency")
    used = (
        articles(spark, sf_dir)
        .select(parse_revenue("revenue")["currency"].alias("base_currency"))
        .groupBy("base_currency").count()
    )
    return dim.join(used, "base_currency", "left").select(
        *dim.columns, F.coalesce("count", F.lit(0)).alias("n_articles")
    )


@_query
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar with the articles published on each day."""
    used = (
        articles(spark, sf_dir)
        .select(parse_date("published_date", AS_OF.date()).alias("date"))
        .groupBy("date").count()
    )
    return seeds.dates(spark).join(used, "date", "left").select(
        "date_id", "date", "year", "month", "day", "quarter_no",
        F.coalesce("count", F.lit(0)).alias("n_articles"),
    )


# -- state -----------------------------------------------------------------------------


@_query
def scd2_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = companies(spark, sf_dir)
    stored = _metadata(rows.where("stock_ticker is not null"), "one.json")
    out = state.scd2(stored, _metadata(_changed(rows), "two.json"), "company_name")
    return out.select(_METADATA_OUT)


@_query
def scd2_company_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one run: the one that sorts last is current."""
    rows = companies(spark, sf_dir)
    stored = _metadata(rows, "one.json")
    batch_rows = _metadata(_changed(rows), "two.json").unionByName(
        _metadata(rows.where("stock_ticker is not null"), "three.json")
    )
    ordered = batch_rows.withColumn("_order", F.split("file_name", "/"))
    out = state.scd2_by_file(stored, ordered, "company_name", "_order")
    return out.select(_METADATA_OUT)


@_query
def upsert_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = _stored_companies(spark, sf_dir)
    delivered = _metadata(_changed(companies(spark, sf_dir)), "two.json")
    return state.upsert_companies(dim, delivered, AS_OF).drop("inserted_at", "updated_at")


@_query
def upsert_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies delivered, some changed: the others keep their batch id."""
    rows = companies(spark, sf_dir)
    more = F.coalesce("is_public", F.lit(True)).cast("int")
    delivered = _metadata(rows.withColumn("employee_count", F.col("employee_count") + more), "two.json")
    out = state.upsert_companies(_stored_companies(spark, sf_dir), delivered, AS_OF, only_changed=True)
    return out.drop("inserted_at", "updated_at")


@_query
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids, in name order, for companies the dimension lacks."""
    rows = companies(spark, sf_dir).select("company_name", "headquarters")
    return state.new_company_keys(_stored_companies(spark, sf_dir), rows)


@_query
def company_batch_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = _stored_companies(spark, sf_dir)
    batch_id = state.next_batch_id(dim, "insert_batch_id", "updated_batch_id")
    return dim.agg(F.count("*").alias("n")).select("n", batch_id.alias("batch_id"))


@_query
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.audit_counts(_stored_companies(spark, sf_dir))


@_query
def new_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches 1 and 2 are known but for one category; batch 3 is new."""
    rows = articles(spark, sf_dir)
    known = rows.where("batch_id < 3 and category <> 'Gardening'").withColumnRenamed(
        "batch_id", "insert_batch_id"
    )
    return state.new_observations(rows, known).select("k", "article_id", "batch_id")


@_query
def new_observations_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, but rows without an id are kept out, with a reason; batch 1's were before."""
    rows = articles(spark, sf_dir)
    known = rows.where("batch_id < 3 and category <> 'Gardening'").withColumnRenamed(
        "batch_id", "insert_batch_id"
    )
    kept_out = state.without_id(rows, rows.where("article_id is null and batch_id = 1"))
    new = state.new_observations(rows, known, require_id=True).withColumn("reason", F.lit(None).cast("string"))
    return new.unionByName(kept_out).select("k", "article_id", "batch_id", "reason")


@_query
def scd2_latest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches 2 and 3 arrive in one run: only an article's newest row is current."""
    rows = articles(spark, sf_dir).select("k", "article_id", "batch_id", "title")
    stored = rows.where("batch_id < 2").withColumn("is_current", F.lit(True))
    return state.scd2(stored, rows.where("batch_id > 1"), "article_id", ["batch_id", "k"])


@_query
def scd2_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("k", "article_id", "batch_id", "title")
    stored = rows.where("batch_id < 3").withColumn("is_current", F.col("batch_id") == 2)
    return state.scd2(stored, rows.where("batch_id = 3"), "article_id")


@_query
def observation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("k", "article_id", "batch_id")
    return state.dense_ids(
        rows, ["article_id", "batch_id", "k"], "observation_id", state.max_id(rows, "batch_id")
    )


# -- text ------------------------------------------------------------------------------


def _per_article(spark: SparkSession, sf_dir: str, source: str, value: Column) -> DataFrame:
    return articles(spark, sf_dir).select("k", source, value.alias("value"))


def _sorted_text(array: Column) -> Column:
    return F.array_join(F.sort_array(array), "|")


@_query
def word_count_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_article(spark, sf_dir, "word_count", to_int("word_count"))


@_query
def published_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_article(spark, sf_dir, "published_date", parse_date("published_date", AS_OF.date()))


@_query
def revenue_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("k", parse_revenue("revenue").alias("r")).select("k", "r.*")


@_query
def company_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_article(spark, sf_dir, "company_name", normal("company_name"))


@_query
def company_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_article(spark, sf_dir, "company_name", compact("company_name"))


@_query
def company_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_article(spark, sf_dir, "company_name", initials("company_name"))


@_query
def company_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth kind of article is about a company with synonyms."""
    named = articles(spark, sf_dir).withColumn(
        "company_name",
        F.expr("case batch_id when 1 then 'Facebook AI Research' when 2 then 'Azure Inc.' "
               "else company_name end"),
    )
    return named.select("k", _sorted_text(synonyms("company_name")).alias("value"))


@_query
def company_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_article(spark, sf_dir, "company_name", _sorted_text(aliases("company_name")))


@_query
def company_aliases_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without initials of one letter and without empty aliases."""
    value = _sorted_text(aliases("company_name", min_initials=2, drop_empty_keys=True))
    return _per_article(spark, sf_dir, "company_name", value)


@_query
def company_synonyms_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers also go by their nation, two spellings each, from a table of synonyms."""
    firms = companies(spark, sf_dir).where("industry = 'Artificial Intelligence'")
    table = firms.select(
        compact("company_name").alias("compact"), F.col("id").alias("place"),
        F.explode(F.array(F.upper("headquarters"), F.concat(F.lit("HQ "), "headquarters"))).alias("synonym"),
    )
    keyed = keys(articles(spark, sf_dir), "company_name", AliasRules(synonyms=table))
    value = F.coalesce(_sorted_text(F.col("aliases")), F.lit(""))
    return keyed.select("k", "company_name", "last_alias", value.alias("value"))


@_query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same functions called by name from SQL."""
    register(spark, AS_OF.date())
    return spark.sql(
        """
        select k, normalize_company_name(company_name) n, normalize_company_compact(company_name) c,
          company_name_initials(company_name) i, size(company_name_aliases(company_name)) n_aliases,
          parse_date(published_date) d, parse_revenue(revenue).currency currency
        from {a}
        """,
        a=articles(spark, sf_dir),
    )


# -- money -----------------------------------------------------------------------------


@_query
def usd_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = articles(spark, sf_dir).select("k", parse_revenue("revenue").alias("r")).select(
        "k", F.when(F.col("k") % 13 == 5, "CHF").otherwise(F.col("r.currency")).alias("revenue_currency"),
        "r.actual", "r.min", "r.max",
    )
    # A currency that texts can't name has a rate too. Without a dollar rate USD converts 1:1; of two current rates the lower id counts.
    rates = seeds.currencies(spark).where("base_currency <> 'USD'")
    rates = rates.unionByName(rates.where("base_currency = 'EUR'").withColumns(
        {"id": F.lit(9), "usd_conversion": F.lit(7.0)}
    )).unionByName(rates.where("base_currency = 'EUR'").withColumns(
        {"id": F.lit(10), "base_currency": F.lit("CHF"), "usd_conversion": F.lit(1.25)}
    ))
    amounts = {"actual": "actual_usd", "min": "min_usd", "max": "max_usd"}
    return money.to_usd(parsed, rates, amounts)


@_query
def revenue_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, articles(spark, sf_dir), companies(spark, sf_dir))
    return rows.select(
        F.col("observation_id").alias("k"), *_VALUE_COLUMNS, "revenue_range_id"
    )


@_query
def revenue_bucket_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the amounts, which often falls between two ranges, in ranges that reach up to the next."""
    rows = _observations(spark, articles(spark, sf_dir), companies(spark, sf_dir))
    sevenths = {f"_{c}": F.col(c) / 7 for c in _VALUE_COLUMNS}
    out = money.bucket(rows.withColumns(sevenths), seeds.revenue_ranges(spark), *sevenths, "_range", contiguous=True)
    return out.select(
        F.col("observation_id").alias("k"), *_VALUE_COLUMNS, F.col("_range").alias("revenue_range_id")
    )


# -- matching --------------------------------------------------------------------------


@_query
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match.match_exact(articles(spark, sf_dir), companies(spark, sf_dir))
    return out.select("k", "company_name", "company_id", "company_match_kind")


@_query
def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = marts.category_lookup(articles(spark, sf_dir), seeds.categories(spark, AS_OF))
    return out.select("k", "category", "category_id")


@_query
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per distinct name and rule, the lowest company id that satisfies the rule."""
    return match.candidates(
        articles(spark, sf_dir).where("company_name is not null"), companies(spark, sf_dir)
    )


@_query
def match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.best_by_article(articles(spark, sf_dir), companies(spark, sf_dir))


@_query
def match_best_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without initials of one letter and without empty keys."""
    return match.best_by_article(articles(spark, sf_dir), companies(spark, sf_dir), AliasRules(2, True))


@_query
def match_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the newest version of an article decides, if it has no exact match."""
    rows, firms = articles(spark, sf_dir), companies(spark, sf_dir)
    newest = match.match_exact(state.newest_only(rows, "article_id", ["batch_id", "k"]), firms)
    open_rows = newest.where("is_current and company_id is null").withColumnRenamed("company_name", "company_name_raw")
    return match.best_by_article(match.article_names(open_rows, rows, all_versions=False), firms)


@_query
def match_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over growing articles and companies; each compares only what the last one hasn't."""
    # Every run reads both several times: the inputs are derived once.
    rows = stage(articles(spark, sf_dir).select("batch_id", "company_name"), "articles")
    firms = stage(companies(spark, sf_dir).select("id", "company_name"), "companies")
    last = firms.agg(F.max("id").alias("id")).first()["id"] or 0
    best = empty(spark, "name_matches")
    for run in (1, 2, 3):
        names, known = rows.where(F.col("batch_id") <= run), firms.where(F.col("id") <= last * run / 3)
        best = stage(match.update_best(names, known, best), "name-matches")
    return best.select("company_name", "priority", "company_id")


@_query
def match_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an exact match take the best candidate of their article."""
    named, firms = articles(spark, sf_dir), companies(spark, sf_dir)
    rows = match.match_exact(named, firms).select(
        "k", "article_id", "company_id", "company_match_kind",
        F.col("company_name").alias("company_name_raw"), F.lit(True).alias("is_current"),
    )
    unmatched = rows.where("company_id is null").select("article_id").distinct()
    best = match.best_by_article(named.join(unmatched, "article_id", "left_semi"), firms)
    return match.apply_best(rows, best).select(
        F.col("k").cast("int").alias("k"), "company_id", "company_match_kind", "company_name_raw"
    )


# -- fact and marts --------------------------------------------------------------------


@_query
def fact_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fact(spark, sf_dir)


@_query
def gold_arr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir)


@_query
def mart_ai_arr_50m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.ai_revenue_mart(_gold(spark, sf_dir))


@_query
def csv_export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart written as CSV and read back."""
    path, mart = _scratch(spark), mart_ai_arr_50m(spark, sf_dir)
    export.write_csv(mart, path)
    return export.read_csv(spark, path, mart)


@_query
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one batch over all articles and companies wrote, as the batch itself counted it."""
    root = _scratch(spark)
    _export_companies(companies(spark, sf_dir), f"{root}/in/companies")
    _export_articles(articles(spark, sf_dir), f"{root}/in/articles", ARTICLE_COLUMNS)
    tables = batch.run(spark, f"{root}/in", f"{root}/tables", as_of=AS_OF, suffixes=("csv", "txt"))
    counts = tables.appended("run_audit").where("table_name <> 'bronze_file_log'")
    return counts.select("table_name", "counter", "n")


@_query
def landing_to_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole batches from landing files to the gold table: versions 1 and 2, then 3."""
    root, rows = _scratch(spark), articles(spark, sf_dir)
    _export_companies(companies(spark, sf_dir), f"{root}/in/companies")
    for folder, part, columns in (
        ("one", rows.where("batch_id < 3"), ARTICLE_COLUMNS),
        ("two", rows.where("batch_id = 3"), ARTICLE_COLUMNS[::-1]),
    ):
        _export_articles(part, f"{root}/in/{folder}", columns)
        tables = batch.run(
            spark, f"{root}/in", f"{root}/tables", as_of=AS_OF, suffixes=("csv", "txt")
        )
    return tables.latest("gold_fact_arr_observation").drop("observation_id", "gold_loaded_at")
