"""Language-model scores with Katz backoff.

The model is learned from the training documents and read by all. The lowest order is
``(c + 1) / (N + V + 1)``, which keeps one share for all unknown words together. Above it,

    P(w | h) = d(c) c(h w) / c(h)           if c(h w) > 0
               alpha(h) P(w | shorter h)    otherwise

with Good-Turing discounts ``d`` for counts up to 5 and ``alpha(h)`` such that all words and the unknown
one sum to exactly 1. A context whose counts are all greater than 5 has no discounted mass; it
counts as ``c(h) + 1``. Discounts that counts of counts can't give (none of some count, or not within 0 and 1) are
``(r - 0.5) / r``. A context never seen in training passes the shorter one's probability on.

Tables. Texts become batches of tokens with numbers of their own; the unigram table gives each word a
global number and its count, and each batch gets back those of its words. N-grams are then
dealt over buckets by context, each batch's equal n-grams combined first, so a bucket holds whole contexts: it
counts, discounts, normalises and evaluates all tokens of its contexts, whose lower-order
probability came with them. Orders above the first are evaluated one after the other, each on the previous one's result. Contexts of
more than ``hot`` occurrences are dealt over several buckets by their next word; their sums, some 80 bytes for each of at most
``N / hot`` contexts, are added up and broadcast.

Discounts are known only when all buckets have counted, so buckets leave, per document (or token), sums in
which the discounts and the backoff weights are still open, and a second pass over these sums closes them.

Defined results: a null text is empty and scores its end token; a null id belongs to training if its hash says so (a null
hash: training); repeated rows count as often as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, mix64, pack_columns, pieces, release, stage, unpack_columns

ORDER = 2
CUTOFF = 5  # counts above aren't discounted
BUCKET_TOKENS = 2_000_000
_FLUSH = 2_000_000
_END = b" "  # no token holds a space
_BEGIN = np.uint64(2**64 - 1)

_BATCHES_DDL = "texts binary, words array<binary>, counts array<long>, ends long"
_BATCHES = pa.schema([("texts", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("ends", pa.int64())])
_GRAMS_DDL = "bucket int, batch long, stats boolean, blob binary"
_GRAMS = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("stats", pa.bool_()), ("blob", pa.binary())])
_SUMS_DDL = "batch long, stats boolean, blob binary, open binary, hot binary, seen array<long>"
_SUMS = pa.schema(
    [
        ("batch", pa.int64()), ("stats", pa.bool_()), ("blob", pa.binary()), ("open", pa.binary()), ("hot", pa.binary()),
        ("seen", pa.list_(pa.int64())),
    ]
)
_VALUES_DDL = "batch long, stats boolean, blob binary"
_VALUES = pa.schema([("batch", pa.int64()), ("stats", pa.bool_()), ("blob", pa.binary())])
_SCORES_DDL = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def tokens_of(text: str | None) -> list[bytes]:
    """Tokens without A-Z: maximal runs free of space and \\x09-\\x0D, which is where ``bytes.split`` cuts."""
    return text.encode().lower().split() if text else []


def held_out() -> Column:
    return F.coalesce(crc_of_id() % 7 == 2, F.lit(False))


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to batches of token numbers, with their words and training counts."""

    def flushed() -> pa.RecordBatch:
        number = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        sizes = np.array(lengths, dtype=np.int64)
        held = np.array(flags, dtype=bool)
        count = np.bincount(number, minlength=len(words))
        training = np.bincount(number[np.repeat(~held, sizes)], minlength=len(words))
        order = np.argsort(-count, kind="stable")  # frequent words have small numbers
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names = list(words)
        null = np.array([d is None for d in docs])
        blob = pack_columns(
            [
                np.array([d or 0 for d in docs], np.int64), null.astype(np.uint8), held.astype(np.uint8),
                sizes.astype(np.uint32), place[number].astype(np.uint32),
            ]
        )
        return pa.RecordBatch.from_pydict(
            {"texts": [blob], "words": [[names[i] for i in order]], "counts": [training[order]], "ends": [int((~held).sum())]}, schema=_BATCHES
        )

    words: dict[bytes, int] = {}
    docs, flags, lengths, ids, total = [], [], [], [], 0
    for batch in batches:
        for doc, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            units = tokens_of(text.as_py())
            units.append(_END)
            number = words.setdefault
            ids.append(np.fromiter((number(w, len(words)) for w in units), dtype=np.int64, count=len(units)))
            docs.append(doc)
            flags.append(flag)
            lengths.append(len(units))
            total += len(units)
            if total >= _FLUSH:
                yield flushed()
                words, docs, flags, lengths, ids, total = {}, [], [], [], [], 0
    if docs:
        yield flushed()


def _numbered(table: pa.Table) -> pa.Table:
    """The global numbers and counts of one batch's words, in the batch's order; its words counted here, and its end tokens."""
    place = table.column("place").to_numpy()
    order = np.argsort(place)
    blob = pack_columns([table.column("id").to_numpy()[order].astype(np.uint64), table.column("count").to_numpy()[order].astype(np.uint64)])
    own = table.column("own").to_numpy(zero_copy_only=False) & (table.column("count").to_numpy() > 0)
    return pa.table(
        {"batch": table.column("batch").slice(0, 1), "names": pa.array([blob], pa.binary()), "words": pa.array([int(own.sum())], pa.int64())}
    )


class _Batch:
    """A batch with global numbers: per document id, held-out flag and size; per token number and count."""

    def __init__(self, texts: bytes, names: bytes) -> None:
        self.doc, self.null, self.held, sizes, place = unpack_columns(texts)
        ids, counts = unpack_columns(names)
        self.size = sizes.astype(np.int64)
        self.token, self.count = ids[place], counts[place].astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.doc)), self.size)
        self.starts = np.cumsum(self.size) - self.size

    def contexts(self, length: int, begin_count: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token a code of the ``length`` tokens before it, and the least of their counts.

        One token is its own code, more are hashed.
        """
        inside = np.arange(len(self.token)) - self.starts[self.owner]
        code = np.full(len(self.token), length, np.uint64)
        rarest = np.full(len(self.token), 2**62, np.int64)
        for back in range(1, length + 1):
            token, count = np.full(len(code), _BEGIN), np.full(len(code), begin_count, np.int64)
            has = np.flatnonzero(inside >= back)
            token[has], count[has] = self.token[has - back], self.count[has - back]
            code = token if length == 1 else mix64(code * np.uint64(0x9E3779B97F4A7C15) + token)
            rarest = np.minimum(rarest, count)
        return code, rarest


def _log_base(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((count + 1.0) / (n + v + 1.0))


def _deal(level: int, last: bool, n: int, v: int, begin_count: int, buckets: int, hot: int):
    """Rows (batch, texts, names, lower) to n-grams of order ``level`` per bucket, and the batch's statistics.

    A slot is where a value is wanted: a document at the last level, a token before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                number = rows.column(0)[i].as_py()
                b = _Batch(rows.column(1)[i].as_py(), rows.column(2)[i].as_py())
                base = _log_base(b.count, n, v)
                lower = base if level == 2 else unpack_columns(rows.column(3)[i].as_py())[0]
                context, rarest = b.contexts(level - 1, begin_count)
                out: dict[str, list] = {name: [] for name in _GRAMS.names}

                def emit(*row):
                    for name, value in zip(_GRAMS.names, row, strict=True):
                        out[name].append(value)

                if last:
                    known = np.add.reduceat((b.count > 0).astype(np.int64), b.starts)
                    blob = pack_columns([b.doc, b.null, b.held, b.size, known, np.add.reduceat(base, b.starts)])
                    emit(number % buckets, number, True, blob)
                else:
                    emit(number % buckets, number, True, pack_columns([b.size]))
                parts = np.where(rarest > hot, np.minimum(buckets, rarest // hot + 1), 1)
                home = (mix64(context) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                shift = (mix64(b.token) >> np.uint64(16)).astype(np.int64) % parts
                bucket = ((home.astype(np.int64) + shift) % buckets).astype(np.int64)
                slot = b.owner if last else np.arange(len(b.token))
                order = np.lexsort((slot, b.token, context, bucket))
                del home, shift, rarest, base
                bucket, context, token, slot = bucket[order], context[order], b.token[order], slot[order]
                lower, train, split = lower[order], (b.held[b.owner] == 0)[order], (parts > 1)[order]
                del b, order, parts
                new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
                new_pair = new_bucket.copy()
                new_pair[1:] |= (context[1:] != context[:-1]) | (token[1:] != token[:-1])
                new_slot = new_pair.copy()
                new_slot[1:] |= slot[1:] != slot[:-1]
                cuts = np.flatnonzero(new_bucket)
                for a, e in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                    pair, place = a + np.flatnonzero(new_pair[a:e]), a + np.flatnonzero(new_slot[a:e])
                    values, code = np.unique(lower[pair], return_inverse=True)
                    many = np.diff(np.append(np.searchsorted(place, pair), len(place)))
                    blob = pack_columns(
                        [
                            np.diff(context[pair], prepend=np.uint64(0)), token[pair], values, code.astype(np.uint32),
                            split[pair].astype(np.uint8), np.add.reduceat(train[a:e].astype(np.int64), pair - a).astype(np.uint32),
                            many.astype(np.uint32), slot[place].astype(np.uint32), np.diff(np.append(place, e)).astype(np.uint32),
                        ]
                    )
                    emit(int(bucket[a]), number, False, blob)
                yield pa.RecordBatch.from_pydict(out, schema=_GRAMS)

    return run


def _sums(table: pa.Table) -> pa.Table:
    """One bucket: counts, and per slot what is known before the discounts are."""
    out: dict[str, list] = {name: [] for name in _SUMS.names}
    loaded, owners = [], []
    for batch, stats, blob in zip(*(table.column(c).to_pylist() for c in ("batch", "stats", "blob")), strict=True):
        if stats:
            for name, value in zip(_SUMS.names, (batch, True, blob, None, None, None), strict=True):
                out[name].append(value)
        else:
            loaded.append(unpack_columns(blob))
            owners.append(batch)
    if not loaded:
        return pa.Table.from_pydict(out, schema=_SUMS)
    base = np.cumsum([0, *(len(c[1]) for c in loaded)])
    context = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in loaded])
    token = np.concatenate([c[1] for c in loaded])
    lower = np.concatenate([c[2][c[3]] for c in loaded])
    split = np.concatenate([c[4] for c in loaded]).astype(bool)
    train = np.concatenate([c[5] for c in loaded]).astype(np.int64)
    pair = np.concatenate([np.repeat(np.arange(len(c[6])), c[6]) + start for c, start in zip(loaded, base[:-1], strict=True)])
    slot = np.concatenate([(np.uint64(i) << np.uint64(32)) | c[7].astype(np.uint64) for i, c in enumerate(loaded)])
    times = np.concatenate([c[8] for c in loaded]).astype(np.int64)
    del loaded

    order = np.lexsort((token, context))
    c_, t_ = context[order], token[order]
    new_context = np.concatenate([[True], c_[1:] != c_[:-1]])
    new_pair = new_context.copy()
    new_pair[1:] |= t_[1:] != t_[:-1]
    heads = np.flatnonzero(new_pair)
    count = np.add.reduceat(train[order], heads)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new_pair) - 1
    # Per context: total, number of words for each discounted count, undiscounted mass, lower-order mass of seen words.
    first = np.flatnonzero(new_context[heads])
    small = np.stack([np.add.reduceat((count == r).astype(np.int64), first) for r in range(1, CUTOFF + 1)], axis=1)
    total = np.add.reduceat(count, first)
    large = np.add.reduceat(np.where(count > CUTOFF, count, 0), first)
    mass = np.add.reduceat(np.where(count > 0, 10.0 ** lower[order][heads], 0.0), first)
    of = np.cumsum(new_context[heads]) - 1
    name, is_hot = c_[heads][first], split[order][heads][first]

    n, ctx = count[which], of[which]
    seen, hot_pair = n > 0, is_hot[ctx]
    bottom = total[ctx] + (small[ctx].sum(axis=1) == 0)
    with np.errstate(divide="ignore"):
        value = np.where(seen, np.log10(np.maximum(n, 1)) - np.where(hot_pair, 0.0, np.log10(np.maximum(bottom, 1))), lower)
    pending = np.where(seen, hot_pair, hot_pair | (total[ctx] > 0))

    slots, at = np.unique(slot, return_inverse=True)
    acc = [np.bincount(at, weights=value[pair] * times, minlength=len(slots))]
    for r in range(1, CUTOFF + 1):
        acc.append(np.bincount(at, weights=(n[pair] == r) * times, minlength=len(slots)).astype(np.uint32))
    owner = np.array(owners, np.int64)[(slots >> np.uint64(32)).astype(np.int64)]
    blob = pack_columns([owner, (slots & np.uint64(2**32 - 1)).astype(np.uint32), *acc])

    p = np.flatnonzero(pending[pair])
    key, back = np.unique(ctx[pair[p]] * np.int64(len(slots)) + at[p], return_inverse=True)
    unseen = np.bincount(back, weights=~seen[pair[p]] * times[p], minlength=len(key)).astype(np.uint32)
    hits = np.bincount(back, weights=seen[pair[p]] * times[p], minlength=len(key)).astype(np.uint32)
    used, local = np.unique(key // max(1, len(slots)), return_inverse=True)

    def told(of_contexts: np.ndarray) -> list[np.ndarray]:
        return [name[of_contexts], total[of_contexts], large[of_contexts], mass[of_contexts], *small[of_contexts].T]

    open_ = pack_columns([local.astype(np.uint32), (key % max(1, len(slots))).astype(np.uint32), unseen, hits, is_hot[used].astype(np.uint8), *told(used)])
    counts_of_counts = [int((count == r).sum()) for r in range(1, CUTOFF + 2)]
    row = (None, False, blob, open_, pack_columns(told(np.flatnonzero(is_hot))), counts_of_counts)
    for field, value_ in zip(_SUMS.names, row, strict=True):
        out[field].append(value_)
    return pa.Table.from_pydict(out, schema=_SUMS)


def discounts(n: list[int]) -> np.ndarray:
    """Katz's factors for counts 1 to CUTOFF, from counts of counts 1 to CUTOFF + 1."""
    out = [(r - 0.5) / r for r in range(1, CUTOFF + 1)]
    if n[0] > 0:
        common = (CUTOFF + 1) * n[CUTOFF] / n[0]
        for r in range(1, CUTOFF + 1):
            if n[r - 1] > 0 and common < 1:
                d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
                if 0 < d < 1:
                    out[r - 1] = d
    return np.array(out)


def _weights(total, large, mass, small, d) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the backoff weight and of the denominator of contexts."""
    bottom = total + (small.sum(axis=1) == 0)
    kept = ((small * (d * np.arange(1, CUTOFF + 1))).sum(axis=1) + large) / np.maximum(bottom, 1)
    with np.errstate(divide="ignore"):
        alpha = np.log10(np.maximum(1 - kept, 1e-300)) - np.log10(np.maximum(1 - mass, 1e-15))
    return np.where(total > 0, alpha, 0.0), np.log10(np.maximum(bottom, 1))


def _close(shared):
    """Sums of buckets to values per slot, with the discounts and the hot contexts' sums known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, hot = shared.value
        for rows in batches:
            for i in range(rows.num_rows):
                if rows.column(1)[i].as_py():
                    yield pa.RecordBatch.from_pydict(
                        {"batch": [rows.column(0)[i].as_py()], "stats": [True], "blob": [rows.column(2)[i].as_py()]}, schema=_VALUES
                    )
                    continue
                owner, slot, value, *counts = unpack_columns(rows.column(2)[i].as_py())
                for r, c in enumerate(counts):
                    value = value + c * math.log10(d[r])
                local, at, unseen, hits, is_hot, name, total, large, mass, *small = unpack_columns(rows.column(3)[i].as_py())
                small = np.stack(small, axis=1) if len(name) else np.zeros((0, CUTOFF), np.int64)
                if len(name):
                    if is_hot.any():
                        place = np.searchsorted(hot[0], name[is_hot > 0])
                        total, large, mass, small = total.copy(), large.copy(), mass.copy(), small.copy()
                        total[is_hot > 0], large[is_hot > 0], mass[is_hot > 0], small[is_hot > 0] = hot[1][place], hot[2][place], hot[3][place], hot[4][place]
                    alpha, bottom = _weights(total, large, mass, small, d)
                    value = value + np.bincount(at, weights=unseen * alpha[local] - hits * bottom[local], minlength=len(value))
                order = np.argsort(owner, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(owner[order]) != 0])) if len(owner) else []
                parts = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "batch": [int(owner[p[0]]) for p in parts], "stats": [False] * len(parts),
                        "blob": [pack_columns([slot[p], value[p]]) for p in parts],
                    },
                    schema=_VALUES,
                )

    return run


def _gathered(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    stats, parts = [], []
    for is_stats, blob in zip(table.column("stats").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if is_stats:
            stats = unpack_columns(blob)
        else:
            parts.append(unpack_columns(blob))
    return stats, parts


def _per_token(table: pa.Table) -> pa.Table:
    (size,), parts = _gathered(table)
    values = np.zeros(int(size.sum()))
    for slot, value in parts:
        values[slot] += value
    return pa.table({"batch": table.column("batch").slice(0, 1), "lower": pa.array([pack_columns([values])], pa.binary())})


def _per_document(n: int):
    def run(table: pa.Table) -> pa.Table:
        (doc, null, held, size, known, base), parts = _gathered(table)
        score = np.zeros(len(doc))
        for slot, value in parts:
            score += np.bincount(slot, weights=value, minlength=len(doc))
        return pa.table(
            {
                "doc_id": pa.array(doc, mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(size),
                "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(doc), n, np.int64)),
                "base_score": pa.array(base), "score": pa.array(score),
            }
        )

    return run


def scores(docs: DataFrame, held: Column | None = None, order: int = ORDER, bucket_tokens: int = BUCKET_TOKENS, hot: int | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), learning from rows not held out."""
    spark = docs.sparkSession
    held = held_out() if held is None else held
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    texts = stage(rows.mapInArrow(_tokenise, _BATCHES_DDL).withColumn("batch", F.monotonically_increasing_id()), "katz-batches")
    words = texts.select("batch", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select(
        "batch", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"), F.monotonically_increasing_id().alias("at")
    )
    # The unigram table, partitioned by word: a word's count, and as its number the least place where a batch
    # lists it. Batches list frequent words first, so most numbers are small. A word has a row for each batch.
    same = Window.partitionBy("word")
    counted = words.select("batch", "place", F.sum("n").over(same).alias("count"), F.min("at").over(same).alias("id"), "at")
    names = stage(
        counted.select("batch", "place", "id", "count", (F.col("id") == F.col("at")).alias("own"))
        .groupBy("batch").applyInArrow(_numbered, "batch long, names binary, words long"),
        "katz-numbers",
    )
    n = texts.agg(F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    ends = texts.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    v = names.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    names = names.drop("words")
    buckets = pieces(n, bucket_tokens, 8)
    hot = bucket_tokens // 2 if hot is None else hot
    lower = None
    for level in range(2, max(2, order) + 1):
        last = level == max(2, order)
        joined = texts.select("batch", "texts").join(names, "batch")
        joined = joined.withColumn("lower", F.lit(None).cast("binary")) if lower is None else joined.join(lower, "batch")
        release(spark)
        grams = joined.mapInArrow(_deal(level, last, n, v, ends, buckets, hot), _GRAMS_DDL)
        sums = stage(grams.groupBy("bucket").applyInArrow(_sums, _SUMS_DDL), f"katz-sums-{level}")
        release(spark)
        told = sums.where("not stats")
        seen = told.agg(*[F.coalesce(F.sum(F.col("seen")[r]), F.lit(0)) for r in range(CUTOFF + 1)]).first()
        shared = spark.sparkContext.broadcast((discounts(list(seen)), _hot_sums(told)))
        values = sums.select("batch", "stats", "blob", "open").mapInArrow(_close(shared), _VALUES_DDL).groupBy("batch")
        if not last:
            lower = stage(values.applyInArrow(_per_token, "batch long, lower binary"), f"katz-lower-{level}")
    return values.applyInArrow(_per_document(n), _SCORES_DDL)


def _hot_sums(told: DataFrame) -> tuple[np.ndarray, ...]:
    """The hot contexts' sums over their buckets: at most two rows a bucket come to the driver."""
    parts = [unpack_columns(r["hot"]) for r in told.select("hot").toLocalIterator()]
    parts = [p for p in parts if len(p[0])]
    if not parts:
        return tuple(np.zeros(0) for _ in range(4)) + (np.zeros((0, CUTOFF)),)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    name, at = np.unique(columns[0], return_inverse=True)

    def added(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=x, minlength=len(name)).astype(x.dtype)

    return name, added(columns[1]), added(columns[2]), added(columns[3]), np.stack([added(c) for c in columns[4:]], axis=1)
