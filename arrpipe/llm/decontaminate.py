"""Benchmark decontamination by a prefix-filtered containment join.

A record is a window of an item: 13 consecutive words, or all words of a shorter item. Its tokens
are its shingles of up to five words. A window occurs in a document only if its tokens do, so
it is enough to join on the window's *prefix*: tokens are ordered by rarity over all documents, and at
containment 1 the necessary prefix is the one rarest token of each window. A joined
occurrence fixes where the window would lie in the document; the positional bound asks that it starts at
or after the first word and the length bound that it ends within the document. What passes is
verified: every token of the window must stand at its place, which is exact equality of the
item-sized window, as tokens are compared by their words.

One pass over the documents keeps, per document, the positions of tokens that occur in
some item at all; all later steps work on this staged table. The items' tokens are broadcast up to
``broadcast_tokens`` of them. Beyond, documents emit their shingles and Spark joins them with
the items' on the shingle itself.

Defined results: null has no words; items and documents without words never match; a repeated
document row is a row of its own; items of one id are one item; a null item id counts as an item
named ''; empty tables give empty results or no hits; columns of the input whose names clash with the
ones added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, text_tag, words_of

WINDOW = 13
SHINGLE = 5
BROADCAST_TOKENS = 500_000  # at most some 100 MB in a task

_TOKEN = T.StructType([T.StructField("token", T.StringType()), T.StructField("at", T.IntegerType())])
_WINDOWS = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("window", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("tokens", T.ArrayType(_TOKEN)),
    ]
)


def _text(words: list[bytes]) -> str:
    return b" ".join(words).decode()


def _shingles(words: list[bytes], length: int) -> list[str]:
    return [_text(words[i : i + length]) for i in range(len(words) - length + 1)]


def _item_windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                for i in range(len(words) - size + 1 if size else 0):
                    part = words[i : i + size]
                    tokens = _shingles(part, min(shingle, size))
                    out.append(
                        {
                            "item_id": item or "", "window": _text(part), "length": size,
                            "tokens": [{"token": t, "at": k} for k, t in enumerate(tokens)],
                        }
                    )
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW_WINDOWS)

    return run


_ARROW_WINDOWS = pa.schema(
    [
        ("item_id", pa.string()), ("window", pa.string()), ("length", pa.int32()),
        ("tokens", pa.list_(pa.struct([("token", pa.string()), ("at", pa.int32())]))),
    ]
)
_HITS = "doc_id long, key string, n_words long, hits array<struct<token: string, at: int>>"
_ARROW_HITS = pa.schema(
    [
        ("doc_id", pa.int64()), ("key", pa.string()), ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("token", pa.string()), ("at", pa.int32())]))),
    ]
)


class _Vocabulary:
    """The items' tokens, for testing all shingles of a text at once.

    Words of items have small numbers; a shingle is looked up by a 64-bit mix of its words' numbers, and a
    find is compared word by word.
    """

    def __init__(self, tokens: list[str]) -> None:
        self.words: dict[bytes, int] = {}
        by_length: dict[int, list[list[int]]] = {}
        for token in tokens:
            ids = [self.words.setdefault(w, len(self.words)) for w in token.encode().split(b" ")]
            by_length.setdefault(len(ids), []).append(ids)
        self.tables = []
        for length, rows in sorted(by_length.items()):
            table = np.array(rows, dtype=np.int64)
            codes = self._codes(table, length)
            order = np.argsort(codes, kind="stable")
            self.tables.append((length, codes[order], table[order]))

    @staticmethod
    def _codes(rows: np.ndarray, length: int) -> np.ndarray:
        code = np.zeros(len(rows), dtype=np.uint64)
        for j in range(length):
            code = code * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64) + np.uint64(1)
        return code

    def find(self, words: list[bytes]) -> list[tuple[str, int]]:
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        found = []
        for length, codes, table in self.tables:
            if len(ids) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            code = self._codes(ids[at[:, None] + np.arange(length)], length)
            place = np.searchsorted(codes, code)
            last = len(codes) - 1
            match = codes[np.minimum(place, last)] == code
            for i, p in zip(at[match].tolist(), place[match].tolist(), strict=True):
                wanted = codes[p]
                while p <= last and codes[p] == wanted:
                    if (table[p] == ids[i : i + length]).all():
                        found.append((_text(words[i : i + length]), i))
                        break
                    p += 1
        return found


def _find(tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(tokens.value)
        for batch in batches:
            counts, hits = [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                counts.append(len(words))
                hits.append([{"token": t, "at": i} for t, i in vocabulary.find(words)])
            yield _hit_rows(batch, counts, hits)

    return run


def _hit_rows(batch: pa.RecordBatch, counts: list, hits: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, _ARROW_HITS.field(3).type)],
        schema=_ARROW_HITS,
    )


def _emit(lengths: list[int]):
    """Every shingle of the given lengths, for the join beyond the broadcast limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = words_of(batch.column(2)[i].as_py())
                hits = [{"token": t, "at": k} for n in lengths for k, t in enumerate(_shingles(words, n))]
                yield _hit_rows(batch.slice(i, 1), [len(words)], [hits])

    return run


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Staged: item_id, window (its words), length, tokens with their places."""
    return stage(
        items.select(F.col("item_id").cast("string"), F.col("text")).mapInArrow(_item_windows(window, shingle), _WINDOWS),
        "item-windows",
    )


def token_hits(docs: DataFrame, windows: DataFrame, broadcast_tokens: int) -> DataFrame:
    """Staged: doc_id, key, n_words, and the places where tokens of items occur; a row per document."""
    spark = docs.sparkSession
    tokens = windows.select(F.explode("tokens.token").alias("token")).distinct()
    source = docs.select(F.col("doc_id").cast("long"), doc_key().alias("key"), "text")
    few = [r[0] for r in tokens.limit(broadcast_tokens + 1).collect()]
    if len(few) <= broadcast_tokens:
        shared = spark.sparkContext.broadcast(sorted(few))
        return stage(source.mapInArrow(_find(shared), _HITS), "token-hits")
    lengths = sorted(r[0] for r in tokens.select(F.size(F.split("token", " "))).distinct().collect())
    emitted = source.mapInArrow(_emit(lengths), _HITS)
    found = (
        emitted.select("key", F.explode("hits").alias("hit")).select("key", "hit", F.col("hit.token").alias("token"))
        .join(tokens, "token", "left_semi")
        .groupBy("key").agg(F.collect_set("hit").alias("found"))
    )
    empty = F.array().cast("array<struct<token: string, at: int>>")
    return stage(
        emitted.drop("hits").join(found, "key", "left")
        .select("doc_id", "key", "n_words", F.coalesce("found", empty).alias("hits")),
        "token-hits",
    )


def doc_key() -> Column:
    """Tells documents apart: the id, and for rows with one id the text."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(text_tag()))


def occurrences(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Staged and verified: key, item_id, start and length of every window occurrence."""
    # Read three times: staged, so that repeated rows are dropped once and no plan holds all the steps.
    flat = stage(
        hits.where(F.size("hits") > 0).dropDuplicates(["key"])
        .select("key", "n_words", F.explode("hits").alias("hit")).select("key", "n_words", "hit.token", "hit.at"),
        "token-places",
    )
    # Rarity over all documents, of the items' tokens.
    rarity = flat.groupBy("token").agg(F.count("*").alias("n"))
    wanted = windows.select("window", "length", "tokens").distinct()
    # The prefix: the rarest token; a window with a token that no document has can't occur.
    prefix = (
        wanted.select("window", "length", F.size("tokens").alias("parts"), F.explode("tokens").alias("t"))
        .select("window", "length", "parts", F.col("t.token").alias("token"), F.col("t.at").alias("offset"))
        .join(rarity, "token")
        .groupBy("window", "length", "parts")
        .agg(F.count("*").alias("known"), F.min(F.struct("n", "token", "offset")).alias("rarest"))
        .where("known = parts")
        .select("window", "length", "parts", F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"))
    )
    start = F.col("at") - F.col("offset")
    candidates = stage(
        flat.join(prefix, "token")
        .withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .select("key", "start", "window", "length", "parts"),
        "window-candidates",
    )
    # Verification: all tokens of the window stand at their places. Places and candidates are distinct, so rows are counted.
    needed = wanted.select("window", F.explode("tokens").alias("t")).select("window", "t.token", F.col("t.at").alias("offset"))
    expected = candidates.join(needed, "window").select(
        "key", "start", "window", "length", "parts", "token", (F.col("start") + F.col("offset")).alias("at")
    )
    verified = (
        expected.join(flat.select("key", "token", "at"), ["key", "token", "at"])
        .groupBy("key", "start", "window", "length", "parts").agg(F.count("*").alias("held"))
        .where("held = parts")
    )
    owners = windows.select("window", "item_id").distinct()
    return stage(verified.join(owners, "window").select("key", "item_id", "start", "length"), "window-places")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, shas = [], [], []
        for spans, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            covered, end = 0, -1
            for s in sorted(spans, key=lambda x: x["start"]):
                first, last = max(s["start"], end), s["start"] + s["length"]
                if last > first:
                    covered, end = covered + last - first, last
            n_hit.append(covered)
            n_items.append(len(items))
            shas.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(shas, pa.string())],
            names=["key", "n_hit", "n_items", "items_sha256"],
        )


def scan(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
    share: int = 20, broadcast_tokens: int = BROADCAST_TOKENS,
) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if ``share * n_hit >= n_words`` and any word is hit.
    """
    windows = item_windows(items, window, shingle)
    hits = token_hits(docs, windows, broadcast_tokens)
    spans = occurrences(hits, windows).groupBy("key").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("item_id").alias("items")
    )
    hit = spans.mapInArrow(_report, "key string, n_hit long, n_items long, items_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        hits.select("doc_id", "key", "n_words").join(hit, "key", "left")
        .select(
            "doc_id", "key", "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.coalesce("items_sha256", none).alias("items_sha256"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = scan(docs, items).where("contaminated").select(F.col("key").alias("_key")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, doc_key().alias("_key")).join(bad, "_key", "left_anti").select("_row.*")
