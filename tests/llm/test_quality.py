"""Held-out accuracy, defined edges, and the solver."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from arrpipe.llm import quality
from arrpipe.llm.common import stage
from arrpipe.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op10_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    low = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.96
    assert sum(r.predicted == 0 for r in low) / len(low) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "good fine words" if i % 2 else "bad *** junk") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(quality.train_rows(), F.col("doc_id") % 2).otherwise(1 - F.col("doc_id") % 2).alias("quality"))
    rows = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "a " * 50_000), (3, "b"), (None, "c"), (4, "good"), (5, "bad *** bad")], "doc_id long, text string"
    ).selectExpr("*", "'clash' as score", "'x' as y")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 1), (5, 0), (5, 0), (None, 1), (6, None), (7, 3)], "doc_id long, quality int")
    for l in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.scored(docs, quality.fit(docs, l, where=F.lit(True))).collect()
        assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if not r.text}) == 1
    assert quality.scored(docs.limit(0), quality.fit(docs, labels, where=F.lit(True))).collect() == []


def test_dual_coordinate_descent_reaches_the_optimum():
    random = np.random.default_rng(2)
    x = random.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.sign(x[:, 0] + 0.2 * random.normal(size=60))
    ids = [np.arange(5)] * 60
    w, b = quality.descend(ids, list(x), y, 5)

    def cost(w, b):
        share = (y > 0).mean()
        upper = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        return 0.5 * (w @ w + b * b) + (upper * np.maximum(0, 1 - y * (x @ w + b))).sum()

    best = cost(w, b)
    for _ in range(200):
        assert best <= cost(w + random.normal(size=5) * 0.05, b + random.normal() * 0.05) + 1e-2


def wordy(spark, n, partitions=3):
    """Documents of two classes that share most of their words, and labels of which a tenth are wrong."""
    random = np.random.default_rng(5)
    words = [f"{'Bad' if i % 7 == 0 else 'w'}{i}{'!' if i % 5 == 0 else ''}" for i in range(90)]
    rows = []
    for i in range(n):
        label = int(random.random() < 0.6)
        pool = words[:70] if label else words[20:]
        text = " ".join(random.choice(pool, size=random.integers(1, 25)))
        rows.append((i, text, 1 - label if random.random() < 0.1 else label))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(partitions, "text")
    return df.select("doc_id", "text"), df.select("doc_id", "quality"), rows


def plain_features(text):
    """The indicators of a text, from the docstring: words, their pairs, and punctuation around words."""
    mask, out, words = 2**64 - 1, set(), []
    for unit in text.encode().split():
        marks = bytes(b for b in range(33, 127) if not chr(b).isalnum())
        word = unit.strip(marks)
        left = unit[: unit.find(word)] if word else unit
        around = left + unit[len(left) + len(word) :]
        words.append(zlib.crc32(word))
        out.add(zlib.crc32(word))
        if around:
            out.add(zlib.crc32(b"+" + around) + 2**32)
    out |= {(a * 0x9E3779B97F4A7C15 + b + 1) & mask for a, b in zip(words, words[1:])}
    return sorted({(x * 0xC2B2AE3D27D4EB4F & mask) >> (64 - quality.BITS) for x in out})


def test_fit_and_scores_equal_a_plain_fit(spark):
    docs, labels, rows = wordy(spark, 120)
    size = 2**quality.BITS
    sets = [plain_features(t) for _, t, _ in rows]
    counts = {1: {}, 0: {}}
    for ids, (_, _, label) in zip(sets, rows, strict=True):
        for i in ids:
            counts[label][i] = counts[label].get(i, 0) + 1
    total = {c: sum(counts[c].values()) + size for c in (0, 1)}
    ratio = {
        i: math.log((counts[1].get(i, 0) + 1) / total[1]) - math.log((counts[0].get(i, 0) + 1) / total[0])
        for ids in sets for i in ids
    }
    vectors = []
    for ids in sets:
        norm = math.sqrt(sum(ratio[i] ** 2 for i in ids))
        vectors.append({i: ratio[i] / norm for i in ids})
    share = sum(label for *_, label in rows) / len(rows)
    weights, bias, alpha = {}, 0.0, [0.0] * len(rows)
    random = np.random.default_rng(0)
    for _ in range(15):
        moved = 0.0
        for k in random.permutation(len(rows)).tolist():
            x, label = vectors[k], rows[k][2]
            y, upper = (1, 0.5 / share) if label else (-1, 0.5 / (1 - share))
            margin = sum(weights.get(i, 0.0) * v for i, v in x.items()) + bias
            new = min(max(alpha[k] - (y * margin - 1) / (1 + sum(v * v for v in x.values())), 0.0), upper)
            step, alpha[k] = (new - alpha[k]) * y, new
            for i, v in x.items():
                weights[i] = weights.get(i, 0.0) + step * v
            bias += step
            moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    pull = 3 * sum(map(abs, weights.values())) / size
    found = {r.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, labels, where=F.lit(True))).collect()}
    for (i, _, _), x in zip(rows, vectors, strict=True):
        margin = sum((weights[k] + pull) * v for k, v in x.items()) + bias
        assert abs(found[i] - 1 / (1 + math.exp(-2 * margin))) < 1e-4


def test_model_does_not_follow_partitions(spark):
    models = []
    for partitions in (1, 5):
        docs, labels, _ = wordy(spark, 300, partitions)
        models.append(quality.fit(stage(docs.orderBy(F.rand(partitions)), "wordy"), labels, where=F.lit(True), group_rows=80))
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].intercept == models[1].intercept


def test_averaged_groups_are_near_one_model(spark):
    """Groups of about 1,500 rows; the production size is 4,000."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    one, groups = (quality.fit(docs, labels, group_rows=g) for g in (quality.FIT_ROWS, 2_000))
    a, b = ({r.doc_id: r.score for r in quality.scored(docs, m).collect()} for m in (one, groups))
    assert np.mean([(a[k] >= 0.5) == (b[k] >= 0.5) for k in a]) > 0.98
    assert np.mean([abs(a[k] - b[k]) for k in a]) < 0.05
