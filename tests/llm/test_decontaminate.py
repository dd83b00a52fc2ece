"""Decontamination against a window-by-window scan, by broadcast and by join."""

import hashlib

import pytest
from brute import words

from arrpipe.llm import decontaminate as d

BIG = " ".join(f"w{i}" for i in range(30))
ITEMS = [
    (1, BIG), (2, "tiny item"), (3, ""), (4, None), (None, "no id at all"), (5, " ".join(f"w{i}" for i in range(13))),
    (6, "The the the THE the the the the the the the the the the the"), (7, "tiny item"), (10, "été ça"),
]
DOCS = [
    (1, None), (2, ""), (3, "..."), (4, BIG.upper() + " tail"), (5, "head " + BIG[:40]), (6, "A TINY-item here"), (7, "tiny"),
    (8, "the " * 40), (9, "x " * 200 + "no id at all"), (10, " ".join(f"w{i}" for i in range(5, 18)) + " w99 " + BIG), (10, "other text"),
    (11, "x " * 4000 + " ".join(f"w{i}" for i in range(13))), (None, "ÉTÉ été ça été ça"), (12, "tiny item"), (12, "tiny item"),
]


def brute():
    out = []
    for doc, text in DOCS:
        w = words(text)
        hit, items = set(), set()
        for item, t in ITEMS:
            v = words(t)
            n = min(13, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[i : i + n]:
                        hit |= set(range(k, k + n))
                        items.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("limit", [d.BROADCAST_TOKENS, 0])
def test_equals_scan(spark, limit):
    docs = spark.createDataFrame([(*r, "clash") for r in DOCS], "doc_id long, text string, n_words string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = d.scan(docs, items, broadcast_tokens=limit).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == brute()


def test_clean_keeps_the_rest_with_all_columns(spark):
    docs = spark.createDataFrame([(*r, 7) for r in DOCS], "doc_id long, text string, key int").selectExpr("*", "1 as _key", "2 as _row")
    kept = d.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    bad = [x[0] for x in brute() if x[5]]
    assert sorted(str(r.doc_id) for r in kept) == sorted(x[0] for x in brute() if not x[5])
    assert "4" in bad and "11" not in bad and all(r.key == 7 for r in kept)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.scan(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in d.scan(docs, items.limit(0)).collect()} == {0}
