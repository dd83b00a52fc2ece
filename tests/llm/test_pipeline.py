"""The pipeline's stages, one by one and as a run."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from arrpipe.llm import decontaminate, mix, shards

SF_DIR = "/root/testdata/sf0.001"


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mix", "shards"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = entry.queries()["pipeline"](spark, SF_DIR)
    assert rows.columns[: len(docs.columns)] == docs.columns
    out = rows.collect()
    assert 0 < len(out) < 3 * docs.count()
    assert max(Counter(r.doc_id for r in out).values()) <= 3
    for s, slots in Counter(r.shard for r in out).items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(slots))
    bad = {r.doc_id for r in decontaminate.scan(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).where("contaminated").collect()}
    assert bad and not bad & {r.doc_id for r in out}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, stage):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some good words in a row", "en", None, 5), (3, "x y z " * 9000, "de", "b", 1),
         (4, "the same text again and again", "en", "a", 2), (4, "the same text again and again", "en", "a", 2)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).withColumns({"shard": F.lit("clash"), "_row": F.lit(1), "row": F.lit(2), "key": F.lit(3), "class": F.lit(4)})
    out = stage(spark, docs, SF_DIR)
    assert out.count() <= 18
    if stage is not corpus_pipeline.sharded_documents:
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0


@pytest.mark.parametrize(
    ("module", "stage"), [(decontaminate, corpus_pipeline.clean_documents), (mix, corpus_pipeline.mixed_documents), (shards, corpus_pipeline.sharded_documents)],
    ids=["decontamination", "mix", "shards"],
)
def test_no_plan_holds_many_steps(spark, monkeypatch, capsys, module, stage):
    """The driver plans a query again after each of its exchanges, so its memory follows the largest plan."""
    exchanges = []

    def planned(df):
        capsys.readouterr()
        df.explain()
        exchanges.append(len(re.findall(r"Exchange ", capsys.readouterr().out)))

    def staged(df, name, as_before=module.stage):
        planned(df)
        return as_before(df, name)

    monkeypatch.setattr(module, "stage", staged)
    planned(stage(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR))
    assert max(exchanges) <= 10, exchanges
