"""Near-duplicate classes against components of all pairs."""

import random

import numpy as np
import pytest

from arrpipe.llm import neardup
from arrpipe.llm.queries import QUERIES


def brute(docs, threshold=0.8, counts=False):
    """The least id of each document's class, over all pairs."""
    sets = [neardup.elements(t, counts=counts) for _, t in docs]
    ids = [2**63 - 1 if i is None else i for i, _ in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and neardup.similarity(sets[i], sets[j]) >= threshold:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(docs)):
        least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return sorted((ids[i], least[root(i)]) for i in range(len(docs)))


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((r["id"], r["class"]) for r in neardup.near_duplicates(df, **options).collect())


def family(r, words, n, size, edits):
    base = [r.choice(words) for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(size)] = r.choice(words)
        out.append(" ".join(w))
    return out


def test_families(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = family(r, words, 40, 200, 2) + family(r, words, 30, 120, 4) + family(r, words, 10, 30, 1) + family(r, words, 3, 3, 1)
    texts += [texts[0]] * 5 + [texts[0].upper()] + [" ".join(r.choice(words) for _ in range(80)) for _ in range(20)]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    assert run(spark, docs) == brute(docs)


def test_counts_as_weights(spark):
    r = random.Random(6)
    line = " ".join(f"x{i}" for i in range(12))
    docs = list(enumerate([" ".join([line] * n) for n in (1, 2, 3, 20, 21, 22, 24)] + family(r, [f"w{i}" for i in range(60)], 5, 80, 1)))
    assert run(spark, docs, weights="count") == brute(docs, counts=True)


def test_edges(spark):
    docs = [(1, None), (2, None), (3, ""), (4, "!!! ..."), (5, "one"), (6, "One."), (6, "two"), (None, "one two three four five six"), (7, "one two three four five six"), (7, "one two three four five six")]
    found = run(spark, docs)
    assert found == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 6), (7, 7), (7, 7), (2**63 - 1, 7)])
    assert run(spark, []) == []


def test_unique_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 3), (1, "a b c d e f", "x", 3), (2, "a b c d e f", "y", 4), (3, None, "z", 5)], "doc_id long, text string, tag string, class int")
    rows = neardup.unique(docs).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "a b c d e f", "x", 3), (3, None, "z", 5)]


def test_signature_agreement_is_weighted_jaccard():
    items = np.arange(1, 60, dtype=np.uint64)
    a, b = (items, np.linspace(0.1, 3, 59)), (items, np.linspace(3, 0.1, 59))
    s = neardup.signatures([a, b], 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(neardup.similarity(a, b), abs=0.03)
    assert (neardup.signatures([b], 4096)[0] == s[1]).all()


@pytest.mark.parametrize(("edits", "weights"), [(3, "set"), (1, "set"), (2, "count")])
def test_rest_loses_no_link(spark, monkeypatch, edits, weights):
    r = random.Random(edits)
    texts = family(r, [f"w{i}" for i in range(50)], 40, 60, edits) + family(r, ["a", "b", "c"], 20, 40, 2)
    texts += [" ".join(t.split()[:50]) for t in texts[:10]]
    docs = list(enumerate(texts))
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 0)
    assert run(spark, docs, weights=weights) == brute(docs, counts=weights == "count")


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op6_near_duplicates"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == brute(docs)
    assert sum(r.keep for r in rows) == len({r.class_id for r in rows})


def test_long_texts_are_worked_on_alone(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_BYTES", 100)
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "short"), (4, None), (5, "short")]
    found = {r["id"]: r["class"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}
