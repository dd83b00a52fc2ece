"""Exact and approximate matching of article company names to companies.

A candidate is a company whose normal form, compact form or any alias equals one
of the name, or whose compact form contains, or is contained in, that of the name
(both of four characters or more). The best candidate has the lowest
(priority, id); priority 0 means its normal form is the name's last alias.

Only the best candidate is ever needed, so the company side of every join is
first reduced to one row per key, its lowest id. No join can then multiply rows:
a key shared by a third of all names and companies costs one row per name, never
a row per pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.names import AliasRules
from ..sources.staging import stage

MIN_CONTAINED = 4
_RULES = AliasRules()


def match_exact(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """Add company_id and company_match_kind by equal, case-sensitive name."""
    found = companies.select("company_name", F.col("id").alias("company_id"))
    return articles.join(found, "company_name", "left").withColumn(
        "company_match_kind", F.when(F.col("company_id").isNotNull(), "Exact")
    )


def _named(df: DataFrame) -> DataFrame:
    return df.where("company_name is not null")


def _rule_keys(last: str) -> Column:
    """Rows (rule, key) of one name; the key of rule 'last' is the column ``last``."""
    fixed = {"normal": "normal", "compact": "compact", "last": last}
    tagged = F.concat(
        F.array(*(F.struct(F.lit(r).alias("rule"), F.col(c).alias("key")) for r, c in fixed.items())),
        F.transform("aliases", lambda a: F.struct(F.lit("alias").alias("rule"), a.alias("key"))),
    )
    return F.inline(tagged)


def _pieces(haystacks: DataFrame, needles: DataFrame) -> DataFrame:
    """Substrings of ``hay`` that could be a ``needle``: same length, same leading part.

    Needles are classed by length, 2^c to 2^(c+1) - 1 characters, and known by a fingerprint of their first
    2^c. A class gives a haystack one window per position, whatever the lengths in it; only windows whose
    fingerprint some needle has are cut, at the lengths of those needles. Which classes a window can
    skip is looked up by its first four characters: at most 36^4 rows of fixed width, as compact
    names hold only [a-z0-9]; hence the broadcast. A window carries no more text than its class can need.
    """
    shapes = (
        needles.where(F.length("needle") >= MIN_CONTAINED)
        .select("needle", F.length("needle").alias("n"), F.expr("length(bin(length(needle))) - 1").alias("class"))
        .select(
            F.left("needle", F.lit(MIN_CONTAINED)).alias("gram"), "class", "n",
            F.expr("xxhash64(left(needle, shiftleft(1, class)))").alias("print"),
        )
    )
    grams = shapes.groupBy("gram").agg(F.bit_or(F.expr("shiftleft(1, class)")).alias("classes"))
    # At most 2^c lengths each.
    sizes = shapes.groupBy("class", "print").agg(F.collect_set("n").alias("sizes"))
    kept = [c for c in haystacks.columns if c != "hay"]
    fitting = f"sequence({MIN_CONTAINED.bit_length() - 1}, length(bin(length(hay) - at + 1)) - 1)"
    windows = (
        haystacks.where(F.length("hay") >= MIN_CONTAINED)
        .select("*", F.explode(F.expr(f"sequence(1, length(hay) - {MIN_CONTAINED - 1})")).alias("at"))
        .withColumn("gram", F.expr(f"substr(hay, at, {MIN_CONTAINED})"))
        .join(F.broadcast(grams), "gram")
        .select("*", F.explode(F.expr(f"filter({fitting}, c -> (shiftright(classes, c) & 1) = 1)")).alias("class"))
        .select(
            *kept, "class",
            F.expr("xxhash64(substr(hay, at, shiftleft(1, class)))").alias("print"),
            F.expr("substr(hay, at, shiftleft(2, class) - 1)").alias("rest"),
        )
    )
    return (
        windows.join(sizes, ["class", "print"])
        .select(*kept, "rest", F.explode(F.expr("filter(sizes, n -> n <= length(rest))")).alias("n"))
        .select(*kept, F.expr("left(rest, n)").alias("piece"))
    )


def _by_key(left: DataFrame, right: DataFrame, rules: AliasRules) -> DataFrame:
    """(company_name, rule, id) by equal normal form, compact form or alias.

    Rule 'last' holds the candidates of priority 0, whose normal form is the name's
    last alias.
    """
    counts = F.col("key") != "" if rules.drop_empty_keys else F.lit(True)
    shared = F.col("compact") != "" if rules.drop_empty_keys else F.lit(True)
    own_alias = F.array_contains("aliases", F.col("normal"))
    company_keys = (
        right.select("id", own_alias.alias("own"), _rule_keys("normal"))
        .where(counts)
        .groupBy("rule", "key")
        .agg(F.min("id").alias("any_id"), F.min(F.when(F.col("own"), F.col("id"))).alias("own_id"))
    )
    # A company whose normal form is ``last_alias`` has this compact form. It is a candidate
    # if one of the following holds, or if its normal form is an alias of its own.
    compact_last = F.regexp_replace("last_alias", "[^a-z0-9]", "")
    surely = (
        (F.col("normal") == F.col("last_alias"))
        | ((F.col("compact") == compact_last) & shared)
        | (
            (F.length("compact") >= MIN_CONTAINED)
            & (F.length(compact_last) >= MIN_CONTAINED)
            & (F.contains("compact", compact_last) | F.contains(compact_last, F.col("compact")))
        )
    )
    is_last = F.col("rule") == "last"
    equal = (
        left.select("company_name", surely.alias("surely"), _rule_keys("last_alias"))
        .join(company_keys, ["rule", "key"])
        .select(
            "company_name", "rule",
            F.when(is_last & ~F.col("surely"), F.col("own_id"))
            .otherwise(F.col("any_id")).alias("id"),
        )
        .where("id is not null")
    )
    # The rest: companies whose normal form is no alias of their own (a '/' inside, say
    # "A/B") that share another alias with the name. Such a normal form always has a
    # character outside [a-z0-9], or none at all.
    odd_companies = (
        right.where(~own_alias)
        .select("id", F.col("normal").alias("last_alias"), F.explode("aliases").alias("key"))
        .groupBy("last_alias", "key")
        .agg(F.min("id").alias("id"))
    )
    odd = (
        left.where((F.col("last_alias") != compact_last) | (F.col("last_alias") == ""))
        .select("company_name", "last_alias", F.explode("aliases").alias("key"))
        .join(odd_companies, ["last_alias", "key"])
        .select("company_name", F.lit("last").alias("rule"), "id")
    )
    return equal.unionByName(odd)


def _by_containment(names: DataFrame, firms: DataFrame) -> DataFrame:
    """(company_name, rule, id) where one compact form contains the other."""
    long_enough = F.length("compact") >= MIN_CONTAINED
    left = names.where(long_enough).select("company_name", "compact")
    right = (
        firms.where(long_enough)
        .groupBy("compact")
        .agg(F.min("id").alias("id"))
    )
    pieces_of_names = _pieces(
        left.withColumnRenamed("compact", "hay"), right.select(F.col("compact").alias("needle"))
    )
    pieces_of_companies = (
        _pieces(
            right.withColumnRenamed("compact", "hay"), left.select(F.col("compact").alias("needle"))
        )
        .groupBy("piece")
        .agg(F.min("id").alias("id"))
    )
    contains = pieces_of_names.join(right.withColumnRenamed("compact", "piece"), "piece")
    contained = left.withColumnRenamed("compact", "piece").join(pieces_of_companies, "piece")
    return contains.select("company_name", F.lit("contains").alias("rule"), "id").unionByName(
        contained.select("company_name", F.lit("contained").alias("rule"), "id")
    )


def _spread(named: DataFrame) -> DataFrame:
    """Rows with distinct names over all cores: short names compress well, so by their bytes they would
    meet in a few tasks, which the keys keep busy for long."""
    spark = named.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return named.repartition(parts)  # by key it would fall away, as the rows come grouped by it


def _found(names: DataFrame, companies: DataFrame, rules: AliasRules = _RULES) -> DataFrame:
    # Five branches start from the keys of names and companies: work those out once, per distinct name. Of
    # companies with one name only the lowest id can count.
    distinct = _spread(_named(names.select("company_name")).distinct())
    keyed = stage(N.keys(distinct, "company_name", rules), "names")
    listed = _named(companies.select("id", "company_name")).groupBy("company_name").agg(F.min("id").alias("id"))
    firms = stage(N.keys(_spread(listed), "company_name", rules).drop("company_name"), "firms")
    return _by_key(keyed, firms, rules).unionByName(_by_containment(keyed, firms))


def candidates(names: DataFrame, companies: DataFrame, rules: AliasRules = _RULES) -> DataFrame:
    """(company_name, rule, company_id): per distinct name and rule, the lowest matching id.

    The rules are normal, compact, alias, contains (the name holds the company) and
    contained (the company holds the name).
    """
    return (
        _found(names, companies, rules)
        .where("rule <> 'last'")
        .groupBy("company_name", "rule")
        .agg(F.min("id").alias("company_id"))
    )


def _lowest(rows: DataFrame, key: str) -> DataFrame:
    """The lowest (priority, company_id) of each key; rows without a company don't count."""
    pair = F.when(F.col("company_id").isNotNull(), F.struct("priority", "company_id"))
    return rows.groupBy(key).agg(F.min(pair).alias("best")).select(key, "best.*")


def best_by_name(names: DataFrame, companies: DataFrame, rules: AliasRules = _RULES) -> DataFrame:
    """(company_name, priority, company_id): the best candidate of each distinct name that has one."""
    priority = F.when(F.col("rule") == "last", 0).otherwise(1)
    found = _found(names, companies, rules)
    return _lowest(
        found.select("company_name", priority.alias("priority"), F.col("id").alias("company_id")), "company_name"
    )


def update_best(
    names: DataFrame, companies: DataFrame, kept: DataFrame, rules: AliasRules = _RULES
) -> DataFrame:
    """(company_name, priority, company_id, seen_id, rules): each distinct name's best candidate, NULL if it has none.

    ``kept`` is what an earlier call returned, or an empty table. Companies are only ever added, under ever
    greater ids, and ``seen_id`` says up to which id a name has met them. So kept names meet
    companies above the least seen_id among them, and names that ``kept`` lacks, or
    has from other ``rules``, meet all. As a best candidate is a minimum, meeting a company twice is harmless.
    """
    tag = rules.tag()
    wanted = stage(
        _named(names.select("company_name")).distinct()
        .join(kept.where(F.col("rules") == tag).drop("rules"), "company_name", "left"),
        "wanted-names",
    )
    known = wanted.where("seen_id is not null")
    latest = companies.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("id")).first()["id"]
    seen = known.agg(F.min("seen_id").alias("id")).first()["id"]
    found = [
        known.select("company_name", "priority", "company_id"),
        best_by_name(wanted.where("seen_id is null"), companies, rules),
    ]
    if seen is not None and seen < latest:
        found.append(best_by_name(known, companies.where(F.col("id") > seen), rules))
    best = _lowest(reduce(DataFrame.unionByName, found), "company_name")
    return wanted.select("company_name").join(best, "company_name", "left").select(
        "*", F.lit(latest).cast("bigint").alias("seen_id"), F.lit(tag).alias("rules")
    )


def article_names(open_rows: DataFrame, bronze: DataFrame, all_versions: bool = True) -> DataFrame:
    """(article_id, company_name) pairs that decide the matches of observations without a company.

    By default every version of an article in ``bronze`` has a say, else only the open rows' own names.
    """
    if all_versions:
        ids = open_rows.select("article_id").distinct()
        pairs = bronze.join(ids, "article_id", "left_semi").select("article_id", "company_name")
    else:
        pairs = open_rows.select("article_id", F.col("company_name_raw").alias("company_name"))
    return pairs.where("article_id is not null and company_name is not null")


def best_of_articles(pairs: DataFrame, best: DataFrame) -> DataFrame:
    """(article_id, priority, company_id): the best of the candidates that an article's names have."""
    found = best.where("company_id is not null").select("company_name", "priority", "company_id")
    return _lowest(pairs.join(found, "company_name"), "article_id")


def best_by_article(
    article_names: DataFrame, companies: DataFrame, rules: AliasRules = _RULES
) -> DataFrame:
    """(article_id, priority, company_id): the best candidate over all names of an article."""
    named = article_names.where("article_id is not null and company_name is not null")
    pairs = stage(named.select("article_id", "company_name"), "article-names")
    return best_of_articles(pairs, best_by_name(pairs, companies, rules))


def fill_company(rows: DataFrame) -> DataFrame:
    """Take ``_found`` as the company of current rows without one, kind 'Fuzzy'."""
    fuzzy = F.col("is_current") & F.col("company_id").isNull() & F.col("_found").isNotNull()
    return rows.withColumns(
        {
            "company_match_kind": F.when(fuzzy, "Fuzzy").otherwise(F.col("company_match_kind")),
            "company_id": F.when(fuzzy, F.col("_found")).otherwise(F.col("company_id")),
        }
    )


def apply_best(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Give current rows without a company the best candidate of their article."""
    found = best.select("article_id", F.col("company_id").alias("_found"))
    return fill_company(rows.join(found, "article_id", "left")).select(rows.columns)
