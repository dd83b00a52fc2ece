"""Hard negatives against scoring everything, and the tree's bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrpipe.llm import negatives


def brute(rows, every):
    by_id = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None for x in v):
            by_id[i] = min(by_id.get(i, (label, tuple(v))), (label, tuple(v)))
    out = set()
    for i, (label, v) in by_id.items():
        if i % every:
            continue
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j, other) for j, (other, w) in by_id.items() if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out |= {(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(fits[:5], 1)}
    return out


def run(spark, rows, every, partitions=3):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, vector array<double>, window string, segment int").repartition(partitions)
    found = negatives.mine(negatives.valid_rows(df, F.col("vector")), F.col("vec_id") % every == 0).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def clustered(n, dim, clusters, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(clusters, dim)) * 60
    which = random.integers(0, clusters, n)
    v = np.floor(random.normal(size=(n, dim)) * 6 + centres[which])
    return [(i, int(random.integers(0, 4)), x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("clusters", [1, 12])
def test_equals_brute_force(spark, monkeypatch, clusters):
    for name, value in (("ARITY", 4), ("SAMPLE", 200), ("LEAF_ROWS", 30), ("NODE_SAMPLE", 8), ("SEGMENT", 40), ("SLICE", 9)):
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(500, 8, clusters, 5)
    rows += [(1000 + i, i % 2, rows[3][2]) for i in range(200)] + [(7, 0, rows[7][2]), (7, 3, rows[8][2]), rows[9]]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_edges(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, None), (2, 1, []), (None, 1, [1.0, 1.0]), (3, None, [1.0, 2.0]), (4, 1, [0.0, 0.0]), (5, 2, [0.0, 0.0]),
            (6, 1, [-1.0, -4.0]), (8, 2, [-1.0, -3.0]), (9, 2, [1.0, 2.0]), (10, 1, [2.0**28 + 1, 2.0**28 + 1]), (11, 2, [2.0**28 + 1, 1.0]), (12, 2, [2.0**28 + 1, 2.0**28 + 1])]
    assert run(spark, rows, 2) == brute(rows, 2)
    odd = [(20, 1, [1.0, 2.0, 3.0])]
    assert run(spark, rows + odd, 2) == brute(rows, 2)
    assert run(spark, [], 1) == set() and run(spark, [(0, 1, [3.0])], 1) == set()
    assert run(spark, [(0, 1, [3.0]), (1, 1, [3.0])], 1) == set()


def test_least_negative(spark):
    values = [0, 1, 4, 5, 6, 99, 100, 101, 12345, -1, -7, 2**62]
    df = spark.createDataFrame([(p,) for p in values], "p long").select("p", negatives.least_negative("p", 80))
    assert {r[0]: r[1] for r in df.collect()} == {p: -(-80 * p // 100) for p in values}


def test_tree_eliminates_siblings_and_loses_no_row():
    rows = clustered(3000, 6, 20, 2)
    v = np.array([r[2] for r in rows])
    norm2 = (v**2).sum(axis=1).max()
    tree = negatives._Tree([], 1, norm2)
    nodes, leaves = negatives.build(tree.lifted(v[:400]), 20)
    tree = negatives._Tree(nodes, leaves, norm2)
    leaf = tree.descend(tree.lifted(v))
    for at, path in enumerate(tree.paths()):
        if (leaf == at).any():
            tree.widen(path, tree.lifted(v[leaf == at]))
    anchors = np.hstack([v[:50], np.zeros((50, 1))])
    scores = (v[:50] @ v.T).astype(np.int64)
    top = np.sort(scores, axis=1)[:, -20:]
    least, most = top[:, [0, 15]], top[:, [5, 19]]
    reached = tree.reached(anchors, *tree.annuli(anchors, least, most))
    inside = ((scores[:, :, None] >= least[:, None]) & (scores[:, :, None] <= most[:, None])).any(axis=2)
    for i in range(50):
        assert reached[i][leaf[inside[i]]].all()
    assert leaves > 20 and reached.mean() < 0.5
    nothing = tree.annuli(anchors, most + 1, least)
    assert not tree.reached(anchors, *nothing).any()
