"""Whole batches over small landing folders."""

import datetime as dt
import json
import os

import pytest

from arrpipe.plans import bronze, gold, silver
from arrpipe.plans.batch import run
from arrpipe.plans.options import Options
from arrpipe.functions.names import AliasRules
from arrpipe.operators import marts, match
from arrpipe.schemas import ARTICLE_COLUMNS
from arrpipe.sources import landing, seeds
from arrpipe.sources.tables import Tables

DAY = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
BASE = dict(
    article_id="1", title="t", company_name="Acme", published_date="2023-05-01", category="AI/ML",
    revenue="$60M", summary="s", url="u", author="a", word_count="12",
)
FIRM = dict(
    founded_year=1999, headquarters="X", employee_count=10, industry="AI/ML", is_public=True,
    stock_ticker=None,
)


def put_csv(path, header, *articles):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    rows = [{**BASE, **a} for a in articles]
    lines = [",".join(header)] + [",".join(r.get(c.strip(' "'), "") for c in header) for r in rows]
    path.write_text("\n".join(lines) + "\n")


def log_of(tables):
    return {r["file_name"]: (r["status"], r["reason"], r["batch_id"])
            for r in tables.appended("bronze_file_log").collect()}


def test_gates(spark, tmp_path):
    source = tmp_path / "in"
    put_csv(source / "a.csv", ARTICLE_COLUMNS, {"title": "a"})
    put_csv(source / "sub dir" / "b+1 [x].csv", ["extra", *ARTICLE_COLUMNS[::-1]], {"title": "b"})
    put_csv(source / "padded.csv", [f" {c} " for c in ARTICLE_COLUMNS], {"title": "p"})
    put_csv(source / "quoted.csv", [f'"{c}"' for c in ARTICLE_COLUMNS], {"title": "q"})
    put_csv(source / "only_header.csv", ARTICLE_COLUMNS)
    put_csv(source / "missing.csv", [c for c in ARTICLE_COLUMNS if c not in ("title", "url")], {})
    put_csv(source / "twice.csv", [*ARTICLE_COLUMNS, "TITLE"], {})
    (source / "empty.csv").write_text("")
    (source / "blank.csv").write_text("\n  \n")
    (source / "gap.csv").write_text("\n" + (source / "a.csv").read_text().replace(",a,", ",g,", 1))
    good = {"Acme": FIRM, "Globex": {**FIRM, "extra": {"x": 1}}}
    files = {
        "good": json.dumps(good), "bad": "{oops", "nothing": "", "root": "[1]", "no_keys": "{}",
        "value": json.dumps({"Acme": FIRM, "B": 3}),
        "field": json.dumps({"Acme": {"founded_year": 1}}),
        "type": json.dumps({"Acme": {**FIRM, "is_public": "yes"}}),
    }
    for name, text in files.items():
        (source / f"{name}.json").write_text(text)
    tables = run(spark, str(source), str(tmp_path / "tables"), as_of=DAY[0])

    log = log_of(tables)
    loaded = {"a.csv", "b+1 [x].csv", "padded.csv", "quoted.csv", "only_header.csv", "gap.csv", "good.json"}
    assert {f for f, (status, _, _) in log.items() if status == "success"} == loaded
    assert len(log) == 18 and {b for _, _, b in log.values()} == {1}
    reasons = {f: reason for f, (_, reason, _) in log.items()}
    assert reasons["missing.csv"].startswith("Schema mismatch. Missing columns: ['title', 'url']. Found: [")
    assert "'title1'" in reasons["twice.csv"] and "'TITLE10'" in reasons["twice.csv"]
    assert reasons["empty.csv"].endswith("Found: [].") and reasons["blank.csv"].endswith("Found: [].")
    assert reasons["bad.json"] == reasons["nothing.json"] == "Invalid JSON"
    assert reasons["root.json"] == reasons["no_keys.json"]
    assert reasons["value.json"] == "Schema mismatch for company 'B': value must be an object."
    assert reasons["field.json"].endswith("Missing fields: ['headquarters', 'employee_count', 'industry', 'is_public', 'stock_ticker'].")
    assert reasons["type.json"] == "Schema mismatch for company 'Acme'. Wrong type: ['is_public']."
    titles = sorted(r["title"] for r in tables.appended("bronze_articles").collect())
    assert titles == ["a", "b", "g", "p", "q"]
    assert tables.latest("dim_company").count() == 2


def test_batches(spark, tmp_path):
    source, root, out = tmp_path / "in", str(tmp_path / "tables"), tmp_path / "out"
    put_csv(source / "a.csv", ARTICLE_COLUMNS,
            {"article_id": "1"}, {"article_id": "2", "company_name": "Initech (US)"},
            {"article_id": "", "company_name": "Acme Inc."})
    (source / "m.json").write_text(json.dumps({"Acme": FIRM}))
    run(spark, str(source), root, as_of=DAY[0])

    # The same files again: nothing new, but a NULL id never counts as present.
    tables = run(spark, str(source), root, as_of=DAY[1])
    assert len(log_of(tables)) == 2
    assert tables.appended("bronze_articles").count() == 3
    observed = tables.current_and_history("silver_observations")
    assert sorted(r["observation_id"] for r in observed.collect()) == [1, 2, 3, 4]
    assert observed.where("not is_current").count() == 0
    assert tables.latest("dim_company").first()["updated_batch_id"] == 2

    # A re-delivery under the old name, with a newer time, and a company that arrives late.
    put_csv(source / "a.csv", ARTICLE_COLUMNS, {"article_id": "1", "revenue": "EUR 40M - 60M"})
    os.utime(source / "a.csv", (2e9, 2e9))
    (source / "n.json").write_text(json.dumps({"Initech": FIRM, "Acme": {**FIRM, "founded_year": 2001}}))
    tables = run(spark, str(source), root, str(out), as_of=DAY[2])
    observed = tables.current_and_history("silver_observations")
    first = {r["insert_batch_id"]: r for r in observed.where("article_id = '1'").collect()}
    assert (first[1]["is_current"], first[2]["is_current"]) == (False, True)
    assert first[1]["updated_at"] == DAY[1]
    assert (first[2]["revenue_min_actual_usd"], first[2]["revenue_max_actual_usd"]) == (4.4e7, 6.6e7)
    second = observed.where("article_id = '2'").first()
    assert (second["company_match_kind"], second["company_name_raw"]) == ("Fuzzy", "Initech (US)")
    gold_rows = {r["article_id"]: r for r in tables.latest("gold_fact_arr_observation").collect()}
    assert gold_rows["1"]["arr_usd"] == 5.5e7 and gold_rows["1"]["company_age"] == 25
    assert gold_rows["2"]["company_matched"] == "Fuzzy" and gold_rows["2"]["company_name"] == "Initech"
    history = tables.current_and_history("bronze_company_metadata")
    assert history.where("company_name = 'Acme' and not is_current").first()["founded_year"] == 1999
    mart = spark.read.option("header", True).csv(str(out / "ai_ml_arr_gt_50m_2022_2024"))
    assert mart.count() == tables.latest("gold_fact_arr_observation").count()


def test_a_run_that_dies_is_invisible_and_replayed(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "tables")
    put_csv(source / "a.csv", ARTICLE_COLUMNS, {"article_id": "1"})
    (source / "m.json").write_text(json.dumps({"Acme": FIRM}))
    dead = Tables(spark, root)
    bronze.run_bronze(spark, dead, str(source), DAY[0])
    silver.run_silver(spark, dead, DAY[0])
    gold.run_gold(dead, DAY[0])
    again = Tables(spark, root)
    assert again.version == 0 and again.appended("bronze_file_log").count() == 0
    tables = run(spark, str(source), root, as_of=DAY[1])
    assert tables.appended("bronze_articles").count() == 1
    assert tables.current("silver_observations").first()["inserted_at"] == DAY[1]
    assert Tables(spark, root).version == 1


def test_both_kinds_of_files_are_needed(spark, tmp_path):
    put_csv(tmp_path / "a.csv", ARTICLE_COLUMNS, {})
    with pytest.raises(FileNotFoundError):
        landing.discover(spark, str(tmp_path), "json")


def test_reader_options(spark, tmp_path):
    """By default a quoted line break ends the row, as in the plain reader; options change that."""
    line = ",".join(['"x\ny"' if c == "title" else "v" for c in ARTICLE_COLUMNS])
    (tmp_path / "a.csv").write_text(",".join(ARTICLE_COLUMNS) + "\n" + line + "\n")
    files = landing.discover(spark, str(tmp_path), "csv")
    for options, n in ((None, 2), ({"multiLine": True}, 1)):
        _, rows = bronze.gate_articles(spark, files, options)
        assert rows.count() == n


def test_redelivery_under_one_path(spark, tmp_path):
    source, path = tmp_path / "in", tmp_path / "in" / "a.csv"
    deliveries = [(ARTICLE_COLUMNS, ","), (ARTICLE_COLUMNS[::-1], ";"), ([c for c in ARTICLE_COLUMNS if c != "revenue"], ",")]
    seen = []
    for header, sep in deliveries:
        put_csv(path, header, {"article_id": "7", "word_count": "99"})
        path.write_text(path.read_text().replace(",", sep))
        files, rows = bronze.gate_articles(spark, landing.discover(spark, str(source), "csv"), {"sep": sep})
        seen.append((files.first()["reason"] is None, [(r["article_id"], r["word_count"], r["revenue"]) for r in rows.collect()]))
    assert seen == [(True, [("7", "99", "$60M")]), (True, [("7", "99", "$60M")]), (False, [])]


def test_wide_header(spark, tmp_path):
    put_csv(tmp_path / "in" / "wide.csv", [*(f"x{i}" for i in range(2000)), *ARTICLE_COLUMNS], {"title": "w"})
    put_csv(tmp_path / "in" / "a.csv", ARTICLE_COLUMNS, {"title": "a"})
    _, rows = bronze.gate_articles(spark, landing.discover(spark, str(tmp_path / "in"), "csv"))
    assert sorted(r["title"] for r in rows.collect()) == ["a", "w"]


def test_hidden_and_repeated_files(spark, tmp_path):
    source = tmp_path / "in"
    for name in ("_x.csv", ".x.csv", "_dir/x.csv", "one/same.csv", "two/same.csv", "two/empty.csv"):
        put_csv(source / name, ARTICLE_COLUMNS, {"title": name})
        os.utime(source / name, (1_700_000_000, 1_700_000_000))
    (source / "two" / "empty.csv").write_text("")
    os.utime(source / "two" / "empty.csv", (1_700_000_000, 1_700_000_000))
    (source / "c.json").write_text(json.dumps({"Acme": {**FIRM, "stock_ticker": 7203}}))
    (source / "big.json").write_text(json.dumps({"Big": {**FIRM, "employee_count": 3_000_000_000}}))
    for identity, titles in (("name", ["one/same.csv"]), ("path", ["one/same.csv", "two/same.csv"])):
        tables = run(spark, str(source), str(tmp_path / identity), as_of=DAY[0], identity=identity)
        assert sorted(r["title"] for r in tables.appended("bronze_articles").collect()) == titles
        log = {r["path"].split("/in/")[1]: r for r in tables.appended("bronze_file_log").collect()}
        assert set(log) == {"_x.csv", ".x.csv", "_dir/x.csv", "one/same.csv", "two/same.csv", "two/empty.csv", "c.json", "big.json"}
        assert all(log[n]["status"] == "quarantined" and "starts with" in log[n]["reason"] for n in ("_x.csv", ".x.csv", "_dir/x.csv"))
        assert log["two/empty.csv"]["file_timestamp"] == dt.datetime.fromtimestamp(1_700_000_000, dt.timezone.utc).replace(tzinfo=None)
        assert log["c.json"]["status"] == "success" and log["big.json"]["reason"].endswith("Wrong type: ['employee_count'].")
        assert [r["stock_ticker"] for r in tables.latest("dim_company").collect()] == ["7203"]
        again = run(spark, str(source), str(tmp_path / identity), as_of=DAY[1], identity=identity)
        assert again.appended("bronze_file_log").count() == len(log)


def test_a_run_leaves_no_staged_tables(spark, tmp_path):
    from arrpipe.sources.staging import checkpoint_dir

    put_csv(tmp_path / "in" / "a.csv", ARTICLE_COLUMNS, {"title": "a"})
    (tmp_path / "in" / "c.json").write_text(json.dumps({"Acme": FIRM}))
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    run(spark, str(tmp_path / "in"), str(tmp_path / "tables"), as_of=DAY[0])
    assert set(os.listdir(folder)) == before
    (tmp_path / "in" / "b.csv").write_text((tmp_path / "in" / "a.csv").read_text())
    with pytest.raises(Exception):
        run(spark, str(tmp_path / "in"), str(tmp_path / "tables"), as_of=DAY[1], csv_options={"mode": "no such mode", "sep": ""})
    assert set(os.listdir(folder)) == before


def test_superseded_snapshots_are_deleted(spark, tmp_path):
    source, results = tmp_path / "in", {}
    source.mkdir()
    (source / "c.json").write_text(json.dumps({"Acme": FIRM}))
    for day in range(3):
        put_csv(source / f"{day}.csv", ARTICLE_COLUMNS, *[{"article_id": str(i), "title": f"t{day}"} for i in range(day, 9)])
        for keep in (None, 2):
            tables = run(spark, str(source), str(tmp_path / f"t{keep}"), as_of=DAY[day], keep=keep)
            results[keep] = [
                sorted(map(str, rows.collect()))
                for rows in (tables.latest("silver_articles"), tables.current_and_history("silver_observations"), tables.latest("dim_company"))
            ]
    assert results[None] == results[2]

    def versions(keep, name, part=""):
        return sorted(p.parent.name if part else p.name for p in (tmp_path / f"t{keep}" / name).glob(f"version=*/{part}".rstrip("/")))

    every = ["version=1", "version=2", "version=3"]
    for name in ("silver_articles", "dim_date", "dim_company", "gold_fact_arr_observation"):
        assert versions(None, name) == every and versions(2, name) == every[1:]
    assert versions(2, "silver_observations", "is_current=true") == every[1:]
    assert versions(2, "bronze_articles") == every
    older = Tables(spark, str(tmp_path / "t2"))
    older.version = 2
    assert older.latest("silver_articles").count() > 0 and older.current("silver_observations").count() > 0
    with pytest.raises(ValueError):
        older.retire(0)


def audit_of(tables, day):
    return {(r["table_name"], r["counter"]): r["n"]
            for r in tables.appended("run_audit").collect() if r["recorded_at"] == day}


def test_audit_and_incremental_matches(spark, tmp_path):
    """Runs count what they write; matches over several runs equal matching all at once."""
    source, root = tmp_path / "in", str(tmp_path / "tables")
    names = ["Acme", "Initech (US)", "Umbrella Labs", "Hooli", "Zzz", "Vandelay Ltd"]
    arrivals = [{"Acme": FIRM}, {"Initech": FIRM}, {"Umbrella": FIRM, "Hooli Inc.": {**FIRM, "founded_year": 2001}}]
    for day, firms in enumerate(arrivals):
        put_csv(source / f"{day}.csv", ARTICLE_COLUMNS,
                *({"article_id": str(i), "company_name": n} for i, n in enumerate(names) if i % 3 >= day))
        (source / f"{day}.json").write_text(json.dumps(firms))
        tables = run(spark, str(source), root, as_of=DAY[day])
        observed = tables.current("silver_observations")
        audit = audit_of(tables, DAY[day])
        assert audit["silver_observations", "current"] == observed.count() == 6
        assert audit["silver_observations", "inserted"] == (6, 4, 2)[day]
        assert audit["silver_observations", "matched_fuzzy"] == observed.where("company_match_kind = 'Fuzzy'").count()
        assert audit["dim_company", "written"] == tables.latest("dim_company").count() == (1, 2, 4)[day]
        assert audit["dim_company", "never_updated"] == tables.latest("dim_company").where("updated_batch_id is null").count()
        assert audit["silver_articles", "written"] == audit["gold_fact_arr_observation", "written"] == 6
        assert audit["bronze_file_log", "written"] == 2
        firms_now = tables.latest("dim_company")
        full = {r["company_name"]: r["company_id"] for r in match.best_by_name(tables.appended("bronze_articles"), firms_now).collect()}
        exact = {r["company_name"]: r["id"] for r in firms_now.collect()}
        got = {r["company_name_raw"]: r["company_id"] for r in observed.collect()}
        assert got == {n: exact.get(n, full.get(n)) for n in names}
    assert {n for n, c in got.items() if c is None} == {"Zzz", "Vandelay Ltd"}


def test_options(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "tables")
    options = Options(AliasRules(2, True), all_versions=False, only_changed=True, latest_only=True, require_id=True, contiguous=True)
    (source).mkdir()
    (source / "m.json").write_text(json.dumps({"Acme": FIRM, "Globex": FIRM}))
    put_csv(source / "a.csv", ARTICLE_COLUMNS, {"article_id": "1", "title": "old"}, {"article_id": "1", "company_name": "Amber"},
            {"article_id": "", "title": "nameless"}, {"article_id": "2", "revenue": "$10000.5", "company_name": "\u516c\u53f8"})
    run(spark, str(source), root, as_of=DAY[0], options=options)
    (source / "n.json").write_text(json.dumps({"Acme": FIRM, "Globex": {**FIRM, "founded_year": 2002}}))
    tables = run(spark, str(source), root, as_of=DAY[1], options=options)
    rows = {(r["article_id"], r["is_current"]): r for r in tables.current_and_history("silver_observations").collect()}
    assert set(rows) == {("1", True), ("1", False), ("2", True)}
    assert rows["2", True]["revenue_range_id"] == 1 and rows["2", True]["company_id"] is None
    kept_out = tables.appended("silver_quarantine").collect()
    assert [(r["title"], r["reason"]) for r in kept_out] == [("nameless", "article_id is missing")]
    assert {r["company_name"]: r["updated_batch_id"] for r in tables.latest("dim_company").collect()} == {"Acme": None, "Globex": 2}


def test_old_spellings_in_the_log_are_repaired(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "tables")
    put_csv(source / "a.csv", ARTICLE_COLUMNS, {})
    (source / "m.json").write_text(json.dumps({"Acme": FIRM}))
    tables = run(spark, str(source), root, as_of=DAY[0])
    log = f"{root}/bronze_file_log/version=1"
    old = spark.read.schema(tables.appended("bronze_file_log").schema).parquet(log).collect()
    rows = [dict(r.asDict(), alert_processed=flag) for r, flag in zip(old, [None, "F"])]
    spark.createDataFrame(rows, tables.appended("bronze_file_log").schema).write.mode("overwrite").parquet(log)
    assert [r["alert_processed"] for r in run(spark, str(source), root, as_of=DAY[1]).appended("bronze_file_log").collect()] == ["N", "N"]


def test_texts_are_parsed_once_per_article(spark):
    """Below the join with the companies, as companies that share a name repeat the article."""
    articles = spark.createDataFrame([tuple(BASE.values()) + (1,)], ", ".join(f"{c} string" for c in BASE) + ", batch_id int")
    firms = spark.createDataFrame([(1, "Acme"), (2, "Acme")], "id bigint, company_name string")
    rows = marts.observations(articles, firms, seeds.categories(spark, DAY[0]), DAY[0])
    assert sorted(r["company_id"] for r in rows.collect()) == [1, 2]
    assert {(r["revenue_actual"], r["published_date"], r["word_count"]) for r in rows.collect()} == {(60e6, dt.date(2023, 5, 1), 12)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsed = next(i for i, line in enumerate(plan) if "_rev" in line and "AS" in line and "regexp_extract" in line)
    assert parsed > max(i for i, line in enumerate(plan) if "Join LeftOuter" in line)


def test_company_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"Acme": FIRM}))
    _, rows = bronze.gate_companies(spark, landing.discover(spark, str(tmp_path), "json"))
    assert [r["company_name"] for r in rows.collect()] == ["Acme"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Relation" in line and line.rstrip().endswith(" text")]
