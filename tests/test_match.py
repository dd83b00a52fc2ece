"""Keyed matching against one OR-ed join of all pairs, and its plans under skew."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from arrpipe.catalog import oracles, queries
from arrpipe.operators import match
from arrpipe.schemas import SCHEMAS, empty
from arrpipe.sources.staging import stage

WORDS = ["acme", "ai", "a", "b", "bolt", "中文", "公司", "meta", "lab", "x-ray", "co", "&", "azure",
         "facebook", "ring", "tech", "technology", "Ltd", "Inc.", "labs", "group", "r&d"]
SEPARATORS = [" ", " ", " ", "", "/", " / ", "-", "  "]


def random_name(rng: random.Random) -> str:
    name = rng.choice(WORDS)
    for _ in range(rng.randint(0, 3)):
        name += rng.choice(SEPARATORS) + rng.choice(WORDS)
    if rng.random() < 0.25:
        name += f" ({rng.choice(WORDS)}{rng.choice(SEPARATORS)}{rng.choice(WORDS)})"
    return rng.choice([name, name.upper(), name.title()])


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    odd = ["", " ", "/", "(/)", "(a/b)", "A/B", "A / B", "a/b (c/d)", "()", "/ inc", "1/2/3"]
    long = "acme" + "technology" * 12
    firms = sorted({random_name(rng) for _ in range(250)} | set(odd) | {long, long + "ring"})
    rng.shuffle(firms)
    texts = [random_name(rng) for _ in range(400)] + odd + [None, "x" + long + "ringx", long[:90]]
    articles = [(f"A{i % 300}" if i % 7 else None, t) for i, t in enumerate(texts)]
    companies = list(enumerate(firms, 1))

    connection = duckdb.connect()
    connection.execute("create table articles(article_id varchar, company_name varchar)")
    connection.executemany("insert into articles values (?, ?)", articles)
    connection.execute("create table companies(id integer, company_name varchar)")
    connection.executemany("insert into companies values (?, ?)", companies)
    a = spark.createDataFrame(articles, "article_id string, company_name string")
    c = spark.createDataFrame(companies, "id int, company_name string")

    expected = connection.execute(
        f"with {oracles._PAIRS} select company_name, rule, min(id) from (select company_name, id, "
        "unnest([case when by_normal then 'normal' end, case when by_compact then 'compact' end, "
        "case when by_alias then 'alias' end, case when holds then 'contains' end, "
        "case when is_held then 'contained' end]) rule from pairs) u where rule is not null "
        "group by all"
    ).fetchall()
    found = [tuple(r) for r in match.candidates(a, c).collect()]
    assert sorted(found) == sorted(expected)

    expected = connection.execute(f"with {oracles._BEST} select * from best").fetchall()
    found = [tuple(r) for r in match.best_by_article(a, c).collect()]
    assert sorted(found) == sorted(expected)
    assert {p for _, p, _ in expected} == {0, 1}


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_shared_key_costs_one_row_per_name(spark):
    """Every name and company shares initials and first letters: no join multiplies rows."""
    n = 3000
    names = spark.range(n).select(F.format_string("Gizmo%05d", "id").alias("company_name"))
    firms = spark.range(n).select(
        (F.col("id") + 1).cast("int").alias("id"), F.format_string("Gadget%05d", "id").alias("company_name")
    )
    out = match.best_by_name(names, firms)
    assert out.agg(F.count("*"), F.min("company_id"), F.max("company_id")).first() == (n, 1, 1)
    df = match._found(names, firms)
    assert df.count() <= 3 * n


def test_no_nested_loop_and_no_python(spark):
    rows = spark.range(100).select(F.concat(F.lit("Acme "), "id").alias("company_name"), "id")
    plan = _final_plan(match.best_by_name(rows, rows))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_hot_name_is_split(spark):
    """A name that half the articles carry is split by the adaptive skew join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = 40000
        rows = spark.range(0, n, 1, 8).select(
            F.col("id").cast("string").alias("article_id"),
            F.when(F.col("id") % 2 == 0, "Hot Name").otherwise(F.concat(F.lit("N"), "id"))
            .alias("company_name"),
        )
        firms = spark.range(500).select(
            F.col("id").cast("int").alias("id"), F.concat(F.lit("N"), "id").alias("company_name")
        )
        assert "skew=true" in _final_plan(match.match_exact(rows, firms))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_two_long_names_take_linear_rows(spark):
    """Names of 5,000 characters, one inside the other: a few rows per position, whatever the lengths."""
    rng = random.Random(5)
    inner = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(4990))
    outer = "start" + inner + "finis"
    hay = spark.createDataFrame([("long", outer)], "company_name string, hay string")
    needles = spark.createDataFrame([(inner,)] + [(outer[i:i + 600 + i],) for i in range(0, 800, 8)], "needle string")
    pieces = match._pieces(hay, needles)
    assert pieces.count() < 5 * len(outer)
    found = {r["piece"] for r in pieces.collect()}
    assert {r["needle"] for r in needles.collect()} <= found
    names = spark.createDataFrame([(outer,)], "company_name string")
    firms = spark.createDataFrame([(3, inner), (4, outer[:200]), (5, outer + "x")], "id int, company_name string")
    got = {(r["rule"], r["company_id"]) for r in match.candidates(names, firms).collect()}
    assert ("contains", 3) in got and ("contained", 5) in got


def test_lengths_at_the_edges_of_classes(spark):
    """Needles of 3 to 130 characters at every place of a haystack, against plain search."""
    rng = random.Random(9)
    text = "".join(rng.choice("ab") for _ in range(200))
    lengths = [3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 66, 67, 127, 128, 129]
    wanted = {text[at:at + n] for n in lengths for at in (0, 1, 50, 200 - n)} | {"b" * 40, text + "a"}
    hay = spark.createDataFrame([("x", text)], "company_name string, hay string")
    needles = spark.createDataFrame([(w,) for w in sorted(wanted)], "needle string")
    pieces = {r["piece"] for r in match._pieces(hay, needles).collect()}
    assert {w for w in wanted if len(w) >= 4 and w in text} <= pieces
    assert all(p in text for p in pieces)


def rows_by_name(df):
    return {r["company_name"]: (r["priority"], r["company_id"]) for r in df.collect()}


@pytest.mark.parametrize("rules", [match.AliasRules(), match.AliasRules(2, True)])
def test_three_runs_equal_full_matching(spark, rules):
    rng = random.Random(11)
    texts = sorted({random_name(rng) for _ in range(150)})
    firms = sorted({random_name(rng) for _ in range(90)})
    rng.shuffle(texts)
    rng.shuffle(firms)
    named = spark.createDataFrame(list(enumerate(texts)), "i int, company_name string")
    listed = spark.createDataFrame(list(enumerate(firms, 1)), "id bigint, company_name string")
    kept = empty(spark, "name_matches")
    # The third run doesn't ask for every name of the second; the fourth asks for some of them again.
    for (low, high), upto in (((0, 60), 30), ((0, 110), 60), ((50, 150), 60), ((0, 150), 90)):
        names, known = named.where(f"i >= {low} and i < {high}"), listed.where(f"id <= {upto}")
        kept = stage(match.update_best(names, known, kept, rules), "kept")
        full = rows_by_name(match.best_by_name(names, known, rules))
        asked = {t for i, t in enumerate(texts) if low <= i < high}
        assert rows_by_name(kept) == {t: full.get(t, (None, None)) for t in asked}


def test_kept_names_meet_new_companies_only(spark):
    """A planted best candidate stays, as its name isn't compared again; other rules compare it anew."""
    names = spark.createDataFrame([("Acme",), ("Bolt",), (None,), ("Acme",)], "company_name string")
    firms = spark.createDataFrame([(1, "Acme"), (2, "Bolt"), (8, "Acme Inc.")], "id bigint, company_name string")
    tag = match.AliasRules().tag()
    kept = spark.createDataFrame([("Acme", 2, 5, 8, tag)], SCHEMAS["name_matches"])
    assert rows_by_name(match.update_best(names, firms, kept)) == {"Acme": (2, 5), "Bolt": (1, 2)}
    # Seen up to 2: only company 8 is new to it.
    behind = kept.withColumn("seen_id", F.lit(2).cast("bigint"))
    assert rows_by_name(match.update_best(names, firms, behind))["Acme"] == (1, 8)
    assert rows_by_name(match.update_best(names, firms, kept, match.AliasRules(2)))["Acme"] == (0, 1)
    nothing = match.update_best(names.limit(0), firms.limit(0), kept)
    assert nothing.count() == 0


def test_rules_are_told_apart(spark):
    table = spark.createDataFrame([("acme", 1, "roadrunner"), ("acme", 2, "coyote")], "compact string, place int, synonym string")
    rules = [match.AliasRules(), match.AliasRules(2), match.AliasRules(1, True), match.AliasRules(synonyms=table),
             match.AliasRules(synonyms=table.limit(1)), match.AliasRules(synonyms=table.limit(0))]
    assert len({r.tag() for r in rules}) == len(rules)
    firms = spark.createDataFrame([(1, "Coyote"), (2, "Zed")], "id bigint, company_name string")
    names = spark.createDataFrame([("ACME Ltd",)], "company_name string")
    assert rows_by_name(match.best_by_name(names, firms, match.AliasRules(2, synonyms=table))) == {"ACME Ltd": (0, 1)}
    assert rows_by_name(match.best_by_name(names, firms, match.AliasRules(2))) == {}


def test_companies_of_one_name_are_keyed_once(spark, monkeypatch):
    staged = {}

    def kept(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(match, "stage", kept)
    firms = spark.range(1, 201).select("id", F.concat(F.lit("Acme "), (F.col("id") % 4).cast("string")).alias("company_name"))
    names = spark.createDataFrame([("acme 0",), ("Acme 1 Inc.",), ("nobody",)], "company_name string")
    best = {r["company_name"]: r["company_id"] for r in match.best_by_name(names, firms).collect()}
    assert (best["acme 0"], best["Acme 1 Inc."]) == (4, 1)
    assert sorted(r["id"] for r in staged["firms"].collect()) == [1, 2, 3, 4]


def test_incremental_query_derives_its_inputs_once(spark, monkeypatch):
    read = []

    def spied(names, companies, kept, *rules):
        read.extend(names.inputFiles() + companies.inputFiles())
        return names.select("company_name").limit(0).withColumns(
            {c: F.lit(None).cast(t) for c, t in (("priority", "int"), ("company_id", "bigint"), ("seen_id", "bigint"), ("rules", "string"))}
        )

    monkeypatch.setattr(match, "update_best", spied)
    queries.QUERIES["match_incremental"](spark, "/root/testdata/sf0.001")
    assert read and not [path for path in read if "/root/testdata" in path]
