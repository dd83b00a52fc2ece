"""The mix: targets, closeness, caps, repeats."""

import random

from pyspark.sql import functions as F

from arrpipe.llm import mix


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_level_off(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 990), (None, 0)], "source string, source_size long")
    rows = {r.source: r.target for r in mix.targets(sizes, (5, 2, 1), 3.0, 1.0).collect()}
    # a stops at 30, the null source at 0; 1970 are shared 2 : 1
    assert rows["a"] == 30 and rows[None] == 0
    assert abs(rows["b"] - 1970 * 2 / 3) < 1e-9 and abs(rows["c"] - 1970 / 3) < 1e-9


def test_sources_come_near_their_targets(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), "x " * r.randint(0, 60)) for i in range(2000)]
    sizes = mix.sizes(_docs(spark, rows))
    chosen = mix.apply(sizes.drop("u"), mix.plan(sizes))
    again = mix.apply(sizes.drop("u"), mix.plan(sizes))
    assert sorted(map(str, chosen.collect())) == sorted(map(str, again.collect()))
    per = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    for p in per:
        assert abs(p.taken - p.target) <= 5 and p.most <= 3
    # inclusion follows the target, not the size
    inside = chosen.where("source = 'a'").agg(F.avg("copies"), F.first("target") / F.first("source_size")).first()
    assert abs(inside[0] - inside[1]) < 0.08


def test_edges(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "b", "one two"), (3, "b", "one two"), (None, None, "x y z"), (4, None, " \t\n")]
    docs = _docs(spark, rows).withColumn("target", F.lit("clash")).withColumn("u", F.lit(1))
    sizes = mix.sizes(docs)
    out = mix.apply(docs, mix.plan(sizes)).collect()
    assert len(out) == 6 and all(0 <= r.copies <= 3 for r in out)
    mixed = mix.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    empty = docs.limit(0)
    assert mix.mixed(empty).collect() == []
    blank = _docs(spark, [(1, "a", None), (2, "b", "")])
    assert mix.mixed(blank).collect() == []


def _near(spark, rows, words):
    docs = _docs(spark, rows)
    sizes = mix.sizes(docs)
    chosen = mix.apply(docs, mix.plan(sizes)).withColumn("size", mix.size_words())
    per = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(p.taken - p.target) <= words for p in per), per


def test_a_document_with_half_of_the_words(spark):
    rows = [(i, "a", "x " * 20) for i in range(200)] + [(2000 + i, "b", "y " * 20) for i in range(200)]
    # The long document's id puts it first in the order of its source, or within what the source takes.
    for long in (1024, 1008):
        _near(spark, [*rows, (long, "b", "y " * 4000)], 20)


def test_rounds_step_over_many(spark):
    r = random.Random(5)
    rows = [(i, "a", "x " * 20) for i in range(400)] + [(None, "b", "y " * 30)] * 60
    rows += [(1000 + i, "b", "y " * r.choice([5, 5, 5, 5, 40, 300, 1500])) for i in range(300)]
    _near(spark, rows, 200)  # a hundredth of b's room
