"""Suffix dedup against a dictionary of all 50-byte strings."""

import hashlib
import random

import pytest

from arrpipe.llm import suffixes
from arrpipe.llm.queries import QUERIES


def brute(docs):
    """Spans removed from each (id, text): bytes covered by a string that a smaller id holds."""
    least = {}
    data = [((2**63 - 1 if i is None else i), (t or "").encode()) for i, t in docs]
    for i, b in data:
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(i, least.get(b[k : k + 50], i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = suffixes.dedup(df, **options).collect()
    return sorted((r.doc, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(40)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(30)))
        text = " ".join(parts)
        if text and r.random() < 0.3:
            k = r.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        docs.append((i, text))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    docs = corpus(seed, 60)
    assert run(spark, docs) == brute(docs)


def test_edges(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))
    docs = [
        (None, long), (None, long), (3, long), (3, long), (3, long[:49]), (4, None), (5, ""), (6, "a" * 400), (7, "a" * 120),
        (8, "x" + long[100:149]), (9, "x" + long[100:150]), (10, long[200:400] * 5), (2, "zz" + long[1000:1060] + "\0" * 70), (1, "\0" * 60),
    ]
    assert run(spark, docs) == brute(docs)


def test_segments_and_buckets(spark, monkeypatch):
    docs = corpus(9, 30)
    docs.append((40, " ".join(t for _, t in docs)))
    text = " ".join(t for _, t in docs).encode()
    import numpy as np

    whole = suffixes.phrases(np.frombuffer(text, np.uint8), np.array([len(text)]))
    assert whole[4].min() >= 50 and whole[4].max() <= 84  # phrases are bounded
    assert run(spark, docs, bucket_bytes=300) == brute(docs)


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op4_suffix_dedup"](spark, sf_dir).collect()
    assert sorted(tuple(r) for r in rows) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def edges(n):
    """Documents of which every other one holds one passage, each between other words."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    return [(i, " ".join([*(word() for _ in range(15)), *([passage] if i % 2 else []), *(word() for _ in range(15))])) for i in range(n)]


@pytest.mark.parametrize("docs", [edges(300), corpus(5, 60)])
def test_hot_triggers(spark, docs):
    assert run(spark, docs, hot=2, bucket_bytes=2000) == brute(docs)


def test_a_hot_trigger_meets_in_no_group():
    import numpy as np
    import pyarrow as pa

    docs, buckets = edges(2000), 64
    batch = pa.RecordBatch.from_pydict({"doc": [i for i, _ in docs], "tag": [0] * len(docs), "data": [t.encode() for _, t in docs]})
    value, n = np.unique(np.concatenate([c[0] for c in suffixes._phrase_columns(iter([batch]))]), return_counts=True)
    hot = value[n >= 100]
    assert n.max() >= 1000  # one in every document with the passage

    def groups(batches):
        whole = pa.Table.from_batches(batches)
        return [whole.filter(pa.compute.equal(whole["bucket"], b)) for b in set(whole["bucket"].to_pylist())]

    parsed = groups(suffixes._parse(buckets, hot)(iter([batch])))
    sizes = [sum(len(suffixes.unpack_columns(x["blob"])[0]) for x in g.to_pylist() if x["kind"] == 0) for g in parsed]
    assert len(sizes) == buckets and max(sizes) < 2 * sum(sizes) / buckets  # triggers are small numbers; buckets are even
    judged = pa.concat_tables([suffixes._judge(g, hot) for g in groups(suffixes._parse(buckets, hot)(iter([batch])))])
    left = judged.filter(judged["open"]).to_pylist()
    most = max(sum(x["trigger"] == t for x in left) for t in hot.view(np.int64).tolist())
    assert most >= 900  # open phrases with one trigger
    opened = {}
    for x in left:
        opened.setdefault(x["doc"], []).append({k: x[k] for k in ("start", "length", "trigger")})
    some = pa.RecordBatch.from_pydict({"doc": list(opened), "tag": [0] * len(opened), "data": [docs[i][1].encode() for i in opened], "open": list(opened.values())})
    for g in groups(suffixes._fetch(buckets, hot)(iter([some]))):
        strings = sum(len(suffixes.unpack_columns(x["bytes"])[0]) for x in g.to_pylist() if x["kind"] == suffixes._STRINGS)
        # Groups of the strings are even, and none holds bytes of one hot trigger's phrases.
        assert strings < 300 and not any(x["trigger"] in hot.view(np.int64).tolist() for x in g.to_pylist() if x["kind"] == suffixes._PHRASE)
