"""Top-k against scoring everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrpipe.llm import topk


def brute(rows, k, every):
    valid = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None for x in v)}
    out = set()
    for i, v in valid:
        if i % every:
            continue
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j) for j, w in valid if j != i)
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)}
    return out


def run(spark, rows, k, every):
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("rank", F.lit("clash")).repartition(3)
    return {tuple(r) for r in topk.search(df, F.col("vec_id") % every == 0, k).collect()}


@pytest.mark.parametrize("clustered", [False, True])
def test_equals_brute_force(spark, monkeypatch, clustered):
    for name, value in (("BLOCK", 16), ("TILE", 8), ("SEGMENT_BLOCKS", 3), ("PIVOTS", 5)):
        monkeypatch.setattr(topk, name, value)
    random = np.random.default_rng(4)
    centres = random.normal(size=(6, 8)) * 40
    v = np.floor(random.normal(size=(400, 8)) * 6 + (centres[random.integers(0, 6, 400)] if clustered else 0))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, v[3].tolist()) for i in range(150)] + [(5, v[5].tolist())]
    assert run(spark, rows, 7, 10) == brute(rows, 7, 10)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (None, [1.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, [0.0, 0.0]), (5, [-1.0, 4.0]), (5, [-1.0, 4.0]), (6, [2.0**40, 2.0**40]), (8, [1.0, 2.0])]
    two = [(i, v) for i, v in rows if not (v and len(v) == 3)]
    assert run(spark, rows, 20, 2) == brute(two, 20, 2)
    assert run(spark, [], 3, 1) == set()
    assert run(spark, [(0, [3.0])], 3, 1) == set()


def test_quantised(spark):
    df = spark.createDataFrame([([0.5, -0.01],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([],), ([float("-inf")],)], "e array<float>")
    assert [r[0] for r in df.select(topk.quantised("e")).collect()] == [[32.0, -1.0], None, None, None, None, None]
