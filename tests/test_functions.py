"""Rule tables of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from arrpipe import functions as fn

AS_OF = dt.date(2026, 11, 30)


def evaluate(spark, values, *columns):
    """The values of ``columns`` for each text ``x``."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i")
    out = [tuple(r) for r in rows.select(*columns).collect()]
    return [r[0] for r in out] if len(columns) == 1 else out


REVENUE = {
    "$1.5B": ("USD", 1.5e9, None, None),
    "€10 - €20M": ("EUR", None, 10.0, 2e7),
    "$10 - 20M": ("USD", None, 10.0, 2e7),
    "£3.2 bn - £1bn": ("GBP", None, 1e9, 3.2e9),
    "5 USD": ("USD", 5.0, None, None),
    "5 million usd": ("USD", 5e6, None, None),
    "usd5mm": (None,) * 4,
    "EUR5": (None,) * 4,
    "5EUR": ("EUR", 5.0, None, None),
    "USDx 5": (None,) * 4,
    "US$ 7k": ("USD", 7e3, None, None),
    "€5 $6": ("USD", 5.0, None, None),
    "$5 months": ("USD", 5e6, None, None),
    "$5 Billion": ("USD", 5e9, None, None),
    "$5 million": ("USD", 5e6, None, None),
    "$1.2.3": (None,) * 4,
    "-$5M": ("USD", 5e6, None, None),
    "¥1,000 thousand": ("JPY", 1e6, None, None),
    "approx. $5M": (None,) * 4,
    "$5 - ": ("USD", 5.0, None, None),
    " - $5": ("USD", 5.0, None, None),
    "$5-6M": ("USD", 5.0, None, None),
    "$5 - n/a": (None,) * 4,
    "$1 - 2 - 3": ("USD", None, 1.0, 2.0),
    "5EUREUR m": ("EUR", 5e6, None, None),
    "12M": (None,) * 4,
    "$": (None,) * 4,
    "   ": (None,) * 4,
    "": (None,) * 4,
    None: (None,) * 4,
}


def test_revenue(spark):
    out = evaluate(spark, list(REVENUE), fn.parse_revenue("x"))
    assert dict(zip(REVENUE, map(tuple, out))) == REVENUE


DATES = {
    "2024-03-05": "2024-03-05",
    "2024-3-5": "2024-03-05",
    "2024-03-05T10:00:00Z": "2024-03-05",
    "03/05/2024": "2024-03-05",
    "13/02/2023": "2023-02-13",
    "31/31/2024": None,
    "Mar 5, 2024": "2024-03-05",
    "SEPT. 3rd, 2022": "2022-09-03",
    "5 June 2021": "2021-06-05",
    "20240305": "2024-03-05",
    "filed on 2024-03-05 by x": "2024-03-05",
    "signed 1 May 2020, amended 2024-03-05": "2020-05-01",
    "March 2023": "2023-03-30",
    "Feb 2023": "2023-02-28",
    "2023": "2023-11-30",
    "5 May": "2026-05-05",
    "May 5": "2026-05-05",
    "29 Feb": None,
    "Feb 30 2023": None,
    "2023-02-30": None,
    "2024-13-01": None,
    "0000-01-01": None,
    "12024-03-05": None,
    "n/a": None,
    "": None,
    None: None,
}


def test_more_date_shapes(spark):
    shapes = {
        "2024/03/05": "2024-03-05", "03-05-2024": "2024-03-05", "31.12.2023": "2023-12-31", "3/5/24": "2024-03-05",
        "5-Mar-2024": "2024-03-05", "Mar-05-2024": "2024-03-05", "2024 March 5": "2024-03-05", "5th of March 2024": "2024-03-05",
        "2024-03": "2024-03-30", "03/2024": "2024-03-30", "report for March 2023, final": "2023-03-30", "1/2/77": "1977-01-02",
        "1/2/75": "2075-01-02", "at 10.11.12.13": None, "13/2024": None, "0/0/24": None,
    }
    out = evaluate(spark, list(shapes), fn.parse_date("x", AS_OF).cast("string"))
    assert dict(zip(shapes, out)) == shapes


def test_dates(spark):
    out = evaluate(spark, list(DATES), fn.parse_date("x", AS_OF).cast("string"))
    assert dict(zip(DATES, out)) == DATES


NUMBERS = {
    "12": 12, "2.5": 2, "3.5": 4, "2.7": 3, "-2.5": -2, " 7 ": 7, "\t7\n": 7, "1_000": 1000,
    "1__0": None, "_1": None, "12d": None, "0x10": None, "nan": None, "inf": None, "1,200": None,
    "1e3": 1000, "3e9": None, "1e400": None, "1.": 1, ".5": 0, "+5": 5, ".": None, "": None,
    None: None,
}


def test_numbers(spark):
    out = evaluate(spark, list(NUMBERS), fn.to_int("x"))
    assert dict(zip(NUMBERS, out)) == NUMBERS


NAMES = {
    "Acme, Inc.": ("acme,", "acme", "a", ["acme,", "acme", "a"]),
    "ACME (NYSE: ACM)": ("acme", "acme", "a", ["acme", "a", "nyseacm"]),
    "Acme Co. Ltd": ("acme co.", "acmeco", "ac", ["acme co.", "acmeco", "ac"]),
    "Acme\x0bLabs": ("acme\x0blabs", "acmelabs", "a\x0bl", ["acme\x0blabs", "acmelabs", "a\x0bl"]),
    "A / B": ("a / b", "ab", "a/b", ["a", "b", "ab", "a/b"]),
    "A/": ("a/", "a", "a", ["a", ""]),
    "International Business Machines": (
        "international business machines", "internationalbusinessmachines", "ibm",
        ["international business machines", "internationalbusinessmachines", "ibm"],
    ),
    "中文 公司": ("中文 公司", "", "中公", ["中文 公司", "", "中公"]),
    "Facebook AI Research": (
        "facebook ai", "facebookai", "fa", ["facebook ai", "facebookai", "fa", "meta ai", "metaai"]
    ),
    "Azure": ("azure", "azure", "a", ["azure", "a", "microsoft"]),
    "Co": ("co", "co", "c", ["co", "c"]),
    "": ("", "", "", [""]),
    None: (None, None, None, []),
}


def test_names(spark):
    out = evaluate(
        spark, list(NAMES), fn.normal("x"), fn.compact("x"), fn.initials("x"), fn.aliases("x")
    )
    assert dict(zip(NAMES, out)) == NAMES


def test_keys_agree_with_functions(spark):
    from arrpipe.functions import names

    rows = spark.createDataFrame([(n,) for n in NAMES if n is not None], "x string")
    both = names.keys(rows, "x").select(
        "normal", "compact", "aliases", fn.normal("x"), fn.compact("x"), fn.aliases("x")
    )
    for normal, compact, aliases, *again in both.collect():
        assert [normal, compact, aliases] == again


@pytest.mark.parametrize(
    "call, expected",
    [
        ("normalize_company_name('Acme Inc.')", "acme"),
        ("normalize_company_compact('Ac-me')", "acme"),
        ("company_name_initials('Big Blue')", "bb"),
        ("company_name_synonyms('azure')", ["microsoft"]),
        ("company_name_aliases('Big Blue')", ["big blue", "bigblue", "bb"]),
        ("parse_date('5 May')", dt.date(2026, 5, 5)),
        ("parse_revenue('$5M').actual", 5e6),
    ],
)
def test_sql_functions(spark, call, expected):
    fn.register(spark, AS_OF)
    assert spark.sql(f"select {call} v").first()["v"] == expected


def test_bucket(spark):
    from arrpipe.operators import money
    from arrpipe.sources import seeds

    cases = [
        (0.5, None, None, 0), (1.0, None, None, 1), (10000.0, None, None, 1),
        (10000.5, None, None, 0), (10001.0, None, None, 2), (1e8, None, None, 5),
        (1e11, None, None, 8), (1e12, None, None, 9), (None, 1e6, 3e6, 4), (None, 1e6, None, 0),
        (5.0, 1e6, 3e6, 1), (None, None, None, 0), (-3.0, None, None, 0),
    ]
    rows = spark.createDataFrame(cases, "a double, lo double, hi double, expected int")
    out = money.bucket(rows, seeds.revenue_ranges(spark), "a", "lo", "hi", "range_id")
    assert out.where("not (range_id <=> expected)").collect() == []
    # Overlapping ranges: the first by order wins.
    overlapping = seeds.revenue_ranges(spark).unionByName(
        spark.createDataFrame([(77, 0.0, None, "all", -1)], seeds.revenue_ranges(spark).schema)
    )
    out = money.bucket(rows.where("a >= 0"), overlapping, "a", "lo", "hi", "range_id")
    assert {r["range_id"] for r in out.collect()} == {77}


def test_usd(spark):
    from arrpipe.operators import money
    from arrpipe.sources import seeds

    rows = spark.createDataFrame(
        [("USD", 2.0), ("EUR", 2.0), ("JPY", 450.0), ("CHF", 2.0), (None, 2.0), ("GBP", None)],
        "revenue_currency string, a double",
    )
    rates = seeds.currencies(spark)
    no_dollar = rates.where("base_currency <> 'USD'").withColumn(
        "is_current", F.col("base_currency") != "EUR"
    )
    for table, euro in ((rates, 2.2), (no_dollar, None)):
        out = money.to_usd(rows, table, {"a": "usd"}).collect()
        assert {(r["revenue_currency"], r["usd"]) for r in out} == {
            ("USD", 2.0), ("EUR", euro), ("JPY", 3.0), ("CHF", None), (None, None), ("GBP", None)
        }
