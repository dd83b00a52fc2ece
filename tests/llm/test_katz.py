"""Katz scores against a dictionary-based model, and the sum of its probabilities."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from arrpipe.llm import katz
from arrpipe.llm.queries import QUERIES

END = "</end>"


class Brute:
    def __init__(self, texts, order):
        self.grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            words = self.tokens(t)
            self.grams[1].update((w,) for w in words)
            for m in range(2, order + 1):
                padded = ["<s>"] * (m - 1) + words
                self.grams[m].update(tuple(padded[i : i + m]) for i in range(len(words)))
        self.n, self.v, self.order = sum(self.grams[1].values()), len(self.grams[1]), order
        self.followers = [defaultdict(dict) for _ in range(order + 1)]
        self.d = [None] * (order + 1)
        for m in range(2, order + 1):
            for g, c in self.grams[m].items():
                self.followers[m][g[:-1]][g[-1]] = c
            counts = Counter(self.grams[m].values())
            self.d[m] = katz.discounts([counts[r] for r in range(1, 7)])

    @staticmethod
    def tokens(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            lower = lower.replace(c, " ")
        return [w for w in lower.split(" ") if w] + [END]

    def p(self, word, context):
        m = len(context) + 1
        if m == 1:
            return (self.grams[1][(word,)] + 1) / (self.n + self.v + 1)
        seen = self.followers[m].get(tuple(context))
        shorter = context[1:]
        if not seen:
            return self.p(word, shorter)
        small = any(c <= 5 for c in seen.values())
        total = sum(seen.values()) + (not small)
        factor = lambda c: self.d[m][c - 1] if c <= 5 else 1.0
        if word in seen:
            return factor(seen[word]) * seen[word] / total
        kept = sum(factor(c) * c for c in seen.values()) / total
        return (1 - kept) / (1 - sum(self.p(w, shorter) for w in seen)) * self.p(word, shorter)

    def score(self, text):
        words = self.tokens(text)
        padded = ["<s>"] * (self.order - 1) + words
        return sum(math.log10(self.p(padded[i + self.order - 1], padded[i : i + self.order - 1])) for i in range(len(words)))

    def base(self, text):
        return sum(math.log10(self.p(w, [])) for w in self.tokens(text))


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


TEXTS = [
    "The cat sat on the mat", "the cat ran", "a Dog sat on the cat", None, "", "the the the the the the the",
    "the cat sat\ton the\nmat", "unknown words here", "a dog ran on the mat", "Été the cat \x00 x", "the cat sat on the mat",
] * 4


def check(rows, expected_texts, order, held=is_held):
    model = Brute([t for i, t in expected_texts if not held(i)], order)
    expected = {i: t for i, t in expected_texts}
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in expected_texts)
    for r in rows:
        text = expected[r.doc_id]
        words = model.tokens(text)
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(words) and r.train_tokens == model.n
        assert r.n_known == sum(model.grams[1][(w,)] > 0 for w in words)
        assert r.base_score == pytest.approx(model.base(text), rel=1e-9)
        assert r.score == pytest.approx(model.score(text), rel=1e-9)
    return model


@pytest.mark.parametrize(("order", "hot"), [(2, None), (2, 3), (3, None), (3, 3)])
def test_equals_brute_force(spark, order, hot):
    data = list(enumerate(TEXTS))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    model = check(katz.scores(df, order=order, hot=hot).collect(), data, order)
    for m in range(2, order + 1):
        for context in list(model.followers[m])[:5]:
            assert sum(model.p(w, list(context)) for (w,) in model.grams[1]) + model.p("no such", list(context)) == pytest.approx(1)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op9_katz_scores"](spark, sf_dir).collect(), data, katz.ORDER)


def test_null_ids_and_repeats(spark):
    rows = katz.scores(spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], "doc_id int, text string")).collect()
    assert len(rows) == 3 and len({round(r.score, 9) for r in rows}) == 1 and not rows[0].held_out


def test_empty_table(spark):
    assert katz.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
