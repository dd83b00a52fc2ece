"""Packing against encoding every text whole."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrpipe.llm import packing
from arrpipe.llm.queries import QUERIES, tokenizer_file

TOKENIZER = tokenizer_file("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string"


def whole_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(TOKENIZER).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 1] for e in found]


def check(rows, pieces, capacity=2048):
    """Every id lies in one piece, and sequences have no gaps; gives (tokens, padding)."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == {i for i, _ in rows}
    for (doc, _), ids in zip(rows, whole_ids([t for _, t in rows]), strict=True):
        own = sorted(by_doc[doc], key=lambda p: p["start"])
        joined = np.frombuffer(b"".join(bytes(p["ids"]) for p in own), "<u4").tolist()
        assert joined == ids
        assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
        assert {p["doc_tokens"] for p in own} == {len(ids)}
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        lengths = [p["length"] for p in parts]
        used = sum(lengths)
        assert used <= capacity and [p["offset"] for p in parts] == np.cumsum([0, *lengths])[:-1].tolist()
        padding += 0 if used & (used - 1) == 0 else capacity - used
    return sum(p["length"] for p in pieces), padding


def run(spark, rows, partitions=3, **options):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(partitions)
    return packing.pack(df, TOKENIZER, **options).collect()


def test_equals_whole_encoding(spark, monkeypatch):
    random = np.random.default_rng(3)
    words = ["the", "Que", "ciónés", "don't", "it's.", "x***", "É", "H̱", "ẞtraße", "3.14", "a…", "…b.", "≠", "≠", "<|endoftext|>", "<|endoftext|>.", "ﬁ", "İs", "日本語。", "\x1cq", " z", "é", "K", "''", "-"]
    gaps = [" ", "\n", "\t ", " ", " ", "\x1f", "\x0b"]
    rows = [(i, "".join(random.choice(words) + random.choice(gaps, p=[0.6, 0.2, 0.1, 0.03, 0.03, 0.02, 0.02]) for _ in range(int(random.lognormal(5, 1.5))))) for i in range(300)]
    rows += [(1000, ""), (1001, None), (1002, "x" * 5000), (1003, "a " * 9000), (1004, " \n "), (1005, "." * 3000)]
    monkeypatch.setattr(packing, "CACHE", 10)
    encoder = packing.Encoder(Path(TOKENIZER).read_text())
    for i in range(0, len(rows), 20):
        part = [t or "" for _, t in rows[i : i + 20]]
        assert [[*x.tolist(), 1] for x in encoder.encode(part)] == whole_ids(part)
        cut = [list(packing.slices(t, 50)) for t in part]
        assert ["".join(c) for c in cut] == part
        assert [sum((x.tolist() for x in encoder.encode(c)), []) + [1] for c in cut] == whole_ids(part)
    tokens, padding = check(rows, run(spark, rows))
    assert padding <= 0.02 * tokens


def test_classes():
    """Bins of class k hold k pieces; only the pieces of open bins are cut again."""
    bins = packing._Bins(0, 2048)
    random = np.random.default_rng(1)
    for doc in range(3000):
        bins.add(doc, np.zeros(int(random.integers(1, 5000)), np.uint32))
    closed, opened = list(bins.rows), sum(len(p) for p in bins.open.values())
    sizes = {}
    for r in closed:
        sizes.setdefault(r[5], []).append(r[2])
    for lengths in sizes.values():
        assert {2048 // n for n in lengths} == {len(lengths)}
    assert all(len(p) < k for k, p in bins.open.items())
    bins.finish()
    assert len(bins.rows) - len(closed) <= opened + opened + 12
    for n in range(1, 5000):
        assert sum(packing.cut_lengths(n)) == n and len(packing.cut_lengths(n)) <= 7


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_other_capacities(spark, capacity):
    rows = [(i, "word and " * i) for i in range(20)]
    check(rows, run(spark, rows, capacity=capacity), capacity)


def test_edges(spark):
    assert run(spark, []) == []
    same = run(spark, [(5, "a b"), (5, "a b"), (None, None)])
    assert sorted((p["doc_id"] or -1, p["doc_tokens"]) for p in same if p["start"] == 0) == [(-1, 1), (5, 3), (5, 3)]


def test_sequences(spark):
    rows = [(i, "some words here " * (i * 7 % 90)) for i in range(60)]
    df = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA).repartition(2)
    pieces = packing.pack(df, TOKENIZER).persist()
    for s in packing.sequences(pieces, pad_id=9).collect():
        ids = np.frombuffer(bytes(s["ids"]), "<u4")
        assert len(ids) == (s["n_tokens"] if s["n_tokens"].bit_count() == 1 else 2048)
        assert (ids[s["n_tokens"] :] == 9).all()
        own = sorted((p for p in pieces.where(F.col("sequence_id") == s["sequence_id"]).collect()), key=lambda p: p["offset"])
        assert b"".join(bytes(p["ids"]) for p in own) == ids[: s["n_tokens"]].astype("<u4").tobytes()
    pieces.unpersist()


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([d["doc_id"] for d in docs], whole_ids([d["text"] for d in docs]), strict=True))
    found = QUERIES["op12_harmonic_packing"](spark, "/root/testdata/sf0.001").collect()
    covered = dict.fromkeys(ids, 0)
    for p in found:
        part = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        covered[p["doc_id"]] += p["length"]
    assert covered == {i: len(x) for i, x in ids.items()}
