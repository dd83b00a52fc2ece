"""Suffix-array dedup of repeated byte strings by prefix-free parsing.

A byte goes if it is covered by a ``LENGTH``-byte string that also starts in a document with a smaller id. Strings are
judged on the input, and never cross documents.

*Parsing.* A polynomial rolling hash runs over all windows of ``TRIGGER`` bytes. The trigger of a
``LENGTH``-byte string is its window with the least hash, so equal strings have equal triggers at equal places, and no
string is without one. A phrase is a maximal run of string starts with one trigger, with all bytes their
strings cover; its edges depend on the content only, so repeated text parses into repeated phrases, while a
phrase is some 14 starts long.

*Dictionary.* Distinct phrases (by 128 bits of rolling hashes) with the least document of each. An occurrence in
any later document is covered as a whole, which settles nearly all of a repetitive text without
looking inside. Equal phrases are first combined within each task, so a passage that a third of all
documents share reaches the shuffle once per task; the other occurrences are settled on the spot.

*Suffix order.* A phrase in its first document can still hold strings that other phrases with the same trigger hold in
smaller documents. Only for such phrases the bytes are fetched, and their suffixes of ``LENGTH`` bytes and more are put in
order. The order is needed to a depth of ``LENGTH`` bytes only, and a phrase carries the bytes that follow it in the
parse to that depth, so dictionary and parse together give the corpus order; runs of equal prefixes take
the run's least document.

Work is dealt over buckets of the trigger hash, whose number follows the input. Triggers of more than about ``HOT`` phrases, as at
the edges of a passage that many documents share, are found in a sample of the documents. Their phrases are dealt by the
phrase hash, and those left open string by string, by 128 bits of rolling hashes and with the least document combined in
the task. The sample decides how phrases are dealt only; results don't depend on it. Long documents are parsed in segments.

Defined results: a null text is empty; null ids count as greater than all others; rows with the same id don't
remove each other's bytes; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, id_key, mix64, pack_columns, pieces, release, stage, text_tag, total_bytes, trim, unpack_columns

LENGTH = 50
TRIGGER = 16
BUCKET_BYTES = 8_000_000  # text per bucket, some 500,000 phrases
HOT = 20_000  # phrases of one trigger
SAMPLE_BYTES = 16_000_000  # of text, or a 256th of it if that is more
_CHUNK = 250_000
_FLUSH = 300_000
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_POSITION = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_OTHER_BYTES = np.random.default_rng(51).integers(0, 2**64, 256, dtype=np.uint64)
_NONE = np.zeros(0, np.uint64)

_RECORDS_DDL = "bucket int, kind int, doc long, tag long, blob binary"
_RECORDS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("blob", pa.binary())])
_JUDGED_DDL = "open boolean, doc long, tag long, start int, length int, trigger long, phrase long"
_JUDGED = pa.schema(
    [
        ("open", pa.bool_()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("length", pa.int32()),
        ("trigger", pa.int64()), ("phrase", pa.int64()),
    ]
)


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _CHUNK + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors, dtype=np.uint64))
        return cls.up, cls.down


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` (a power of two), by doubling."""
    h, power, done = values, _BASE, 1
    while done < width:
        h = h[:-done] * np.uint64(power) + h[done:]
        power, done = power * power % 2**64, 2 * done
    return h


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` successive keys."""
    m, done = keys, 1
    while 2 * done <= span:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    size = len(keys) - span + 1
    return np.minimum(m[:size], m[span - done : span - done + size]) if span > done else m


def phrases(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that follow each other in ``data``: trigger hash, phrase hash, text number, start, length."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    values = _BYTES[data]
    hashes = mix64(rolling(values, TRIGGER))
    keys = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    least = _least(keys, LENGTH - TRIGGER + 1)
    starts = ends - np.diff(np.concatenate([[0], ends]))
    room = np.repeat(ends, ends - starts)[: len(least)] - np.arange(len(least))
    at = np.flatnonzero(room >= LENGTH)
    if not len(at):
        return none
    trigger = (least[at] & _POSITION).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(trigger)) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    begin, end = at[first], at[last] + LENGTH
    up, down = _Powers.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(data)], dtype=np.uint64)])
    phrase = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    text = np.searchsorted(ends, begin, side="right")
    return hashes[trigger[first]], phrase, text, begin - starts[text], end - begin


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs that cover the same places; touching ones are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The merged spans of each document."""
    if not len(doc):
        return []
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    cuts = np.flatnonzero(_runs(doc, tag))
    return [(int(doc[a]), int(tag[a]), *_merged(start[a:b], end[a:b])) for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True)]


def _phrase_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of rows (doc, tag, data): trigger, phrase, doc, tag, start and length, chunk by chunk."""
    for batch in batches:
        docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = binary_column(batch.column(2))
        i = 0
        while i < len(docs):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, side="right")) - 1)
            for cut in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), _CHUNK) if j == i + 1 else [int(offsets[i])]:
                if j == i + 1:  # one document, in segments that overlap by LENGTH - 1
                    part = data[cut : min(cut + _CHUNK + LENGTH - 1, int(offsets[j]))]
                    ends = np.array([len(part)])
                else:
                    part, ends = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
                trigger, phrase, text, start, length = phrases(part, ends)
                yield trigger, phrase, docs[i + text], tags[i + text], start + (cut - int(offsets[i])), length
            i = j


def _parse(buckets: int, hot: np.ndarray = _NONE):
    """Rows (doc, tag, data) to packed phrase records per bucket, and spans settled within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for columns in _phrase_columns(batches):
            held.append(columns)
            count += len(columns[0])
            if count >= _FLUSH:
                yield _packed(held, buckets, hot)
                held, count = [], 0
                trim()
        if count:
            yield _packed(held, buckets, hot)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tag, data) to triggers and their numbers of phrases, chunk by chunk."""
    for trigger, *_ in _phrase_columns(batches):
        value, n = np.unique(trigger, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["trigger", "n"])


def _hot_triggers(rows: DataFrame, total: int, hot: int) -> np.ndarray:
    """Sorted triggers with at least some ``hot`` phrases, from a sample; at most two per ``hot`` phrases."""
    every = min(256, max(1, total // SAMPLE_BYTES))
    sample = rows.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(every)) == 0)
    counted = sample.mapInArrow(_count, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(2, hot / every / 2)).select("trigger").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in ``some``, which is sorted."""
    if not len(some):
        return np.zeros(len(values), dtype=bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """Even buckets; triggers are least hashes, so nearly all of them are small numbers before they are scrambled."""
    return (mix64(values) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _packed(held: list[tuple[np.ndarray, ...]], buckets: int, hot: np.ndarray = _NONE) -> pa.RecordBatch:
    trigger, phrase, doc, tag, start, length = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(trigger)
    again = np.zeros(len(order), dtype=bool)
    same = trigger[order[1:]] == trigger[order[:-1]]
    again[1:] |= same
    again[:-1] |= same
    keep = np.ones(len(trigger), dtype=bool)
    out: dict[str, list] = {name: [] for name in _RECORDS.names}
    some = order[again]
    if len(some):
        some = some[np.lexsort((doc[some], phrase[some], trigger[some]))]
        new = _runs(trigger[some], phrase[some])
        least = doc[some[new]][np.cumsum(new) - 1]
        later = some[doc[some] > least]
        keep[later] = False
        for d, t, a, b in _spans(doc[later], tag[later], start[later], start[later] + length[later]):
            row = (d % buckets, 1, d, t, pack_columns([a.astype(np.uint32), b.astype(np.uint32)]))
            for name, value in zip(_RECORDS.names, row, strict=True):
                out[name].append(value)
    order = order[keep[order]]
    dealt = np.where(_among(trigger[order], hot), phrase[order], trigger[order])
    bucket = _bucket(dealt, buckets)
    by_bucket = np.argsort(bucket, kind="stable")  # triggers stay in order within a bucket
    order, bucket = order[by_bucket], bucket[by_bucket]
    cuts = np.flatnonzero(_runs(bucket)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        part = order[a:b]
        pairs, number = np.unique(np.stack([doc[part], tag[part]]), axis=1, return_inverse=True)
        blob = pack_columns(
            [
                np.diff(trigger[part], prepend=np.uint64(0)), phrase[part], number.reshape(-1).astype(np.uint32),
                start[part].astype(np.uint32), length[part].astype(np.uint8),
                np.diff(pairs[0], prepend=0), pairs[1].astype(np.uint32),
            ]
        )
        for name, value in zip(_RECORDS.names, (int(bucket[a]), 0, None, None, blob), strict=True):
            out[name].append(value)
    return pa.RecordBatch.from_pydict(out, schema=_RECORDS)


def _rows(open_: bool, doc, tag, start, length, trigger=None, phrase=None) -> pa.Table:
    n = len(doc)
    zero = np.zeros(n, np.int64)
    return pa.table(
        [
            pa.array(np.full(n, open_)), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(tag, np.int64)),
            pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(length, np.int32)),
            pa.array(zero if trigger is None else trigger.view(np.int64)), pa.array(zero if phrase is None else phrase.view(np.int64)),
        ],
        schema=_JUDGED,
    )


def _span_rows(spans: list) -> pa.Table:
    if not spans:
        return _rows(False, [], [], [], [])
    sizes = [len(a) for _, _, a, _ in spans]
    start, end = np.concatenate([a for _, _, a, _ in spans]), np.concatenate([b for _, _, _, b in spans])
    return _rows(False, np.repeat([d for d, *_ in spans], sizes), np.repeat([t for _, t, *_ in spans], sizes), start, end - start)


def _judge(table: pa.Table, hot: np.ndarray = _NONE) -> pa.Table:
    """One bucket: spans of phrases that a smaller document holds, and the phrases left open, all first ones of a hot trigger among them."""
    spans, parts = [], []
    for kind, doc, tag, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "doc", "tag", "blob")), strict=True):
        if kind:
            spans.append((doc, tag, *(x.astype(np.int64) for x in unpack_columns(blob))))
            continue
        trigger, phrase, number, start, length, docs, tags = unpack_columns(blob)
        docs, tags = np.cumsum(docs), tags.astype(np.int64)
        parts.append((np.cumsum(trigger, dtype=np.uint64), phrase, docs[number], tags[number], start.astype(np.int64), length.astype(np.int64)))
    trim()
    if not parts:
        return _span_rows(spans)
    trigger, phrase, doc, tag, start, length = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(trigger)
    same = trigger[order[1:]] == trigger[order[:-1]]
    again = np.zeros(len(order), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    some = order[again | _among(trigger[order], hot)]
    some = some[np.lexsort((doc[some], phrase[some], trigger[some]))]
    trigger, phrase, doc, tag, start, length = (c[some] for c in (trigger, phrase, doc, tag, start, length))
    if not len(some):
        return _span_rows(spans)
    new_phrase, new_trigger = _runs(trigger, phrase), _runs(trigger)
    which, where = np.cumsum(new_phrase) - 1, np.cumsum(new_trigger) - 1
    later = doc > doc[new_phrase][which]
    heads = np.flatnonzero(new_trigger)
    spread = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
    several = np.add.reduceat(new_phrase.astype(np.int64), heads) > 1
    undecided = ~later & ((spread & several)[where] | _among(trigger, hot))
    spans += _spans(doc[later], tag[later], start[later], start[later] + length[later])
    left = _rows(True, doc[undecided], tag[undecided], start[undecided], length[undecided], trigger[undecided], phrase[undecided])
    return pa.concat_tables([_span_rows(spans), left])


_FETCHED_DDL = "bucket int, kind int, doc long, tag long, start int, trigger long, bytes binary"
_FETCHED = pa.schema(
    [
        ("bucket", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()),
        ("trigger", pa.int64()), ("bytes", pa.binary()),
    ]
)
_PHRASE, _SPANS, _STRINGS = 0, 1, 2
_STRING_SPLIT = 8  # a phrase has more strings than one; they have buckets of their own


def _fetch(buckets: int, hot: np.ndarray = _NONE):
    """Rows (doc, tag, data, starts, lengths, triggers) to the bytes of the open phrases; of hot triggers to packed strings per bucket."""
    hot_ones = frozenset(hot.view(np.int64).tolist())

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        records = _packed(held, buckets * _STRING_SPLIT)
        kind = [_SPANS if k else _STRINGS for k in records.column("kind").to_pylist()]
        none = [None] * len(kind)
        bucket = [buckets + b for b in records.column("bucket").to_pylist()]
        columns = [bucket, kind, records.column("doc"), records.column("tag"), none, none, records.column("blob")]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _FETCHED, strict=True)], schema=_FETCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, int, int, bytes]] = []
        held: list[tuple[np.ndarray, ...]] = []
        size = count = 0
        for batch in batches:
            docs, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: dict[str, list] = {name: [] for name in _FETCHED.names}
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py()
                open_ = batch.column(3)[i].as_py()
                numbers = _bucket(np.array([x["trigger"] for x in open_], np.int64).view(np.uint64), buckets).tolist()
                for x, bucket in zip(open_, numbers, strict=True):
                    piece = data[x["start"] : x["start"] + x["length"]]
                    if x["trigger"] in hot_ones:
                        parts.append((docs[i], tags[i], x["start"], piece))
                        size += len(piece)
                        if size >= _CHUNK:
                            held.append(_strings(parts))
                            count += len(held[-1][0])
                            parts, size = [], 0
                        if count >= _FLUSH:
                            yield packed(held)
                            held, count = [], 0
                        continue
                    row = (bucket, _PHRASE, docs[i], tags[i], x["start"], x["trigger"], piece)
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_FETCHED)
        if parts:
            held.append(_strings(parts))
        if held:
            yield packed(held)

    return run


def _strings(parts: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """The ``LENGTH``-byte strings of phrases (doc, tag, start, bytes), in the columns of phrases: two hashes, doc, tag, start, length."""
    data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    lengths = np.array([len(p[3]) for p in parts])
    doc, tag, start = (np.array([p[k] for p in parts], np.int64) for k in range(3))
    owner, inner, place = _places(lengths, np.cumsum(lengths) - lengths)
    one, two = (mix64(_string_hashes(data, place, values)) for values in (_BYTES, _OTHER_BYTES))
    return one, two, doc[owner], tag[owner], start[owner] + inner, np.full(len(owner), LENGTH)


def _places(lengths: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each string in phrases that follow each other: the phrase, the place in it, and the place in all bytes."""
    count = np.maximum(lengths - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, inner, offsets[owner] + inner


def _string_hashes(data: np.ndarray, place: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, down = _Powers.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)])
    return (sums[place + LENGTH] - sums[place]) * down[place]


def _order(table: pa.Table) -> pa.Table:
    """The suffixes of one bucket's open phrases in order, cut at LENGTH bytes; spans of those that a smaller document holds.

    A bucket of hot triggers' strings has packed records, which are judged like phrases.
    """
    trim()
    if table.num_rows and table.column("kind")[0].as_py() != _PHRASE:
        kind = pa.array([int(k == _SPANS) for k in table.column("kind").to_pylist()], pa.int32())
        judged = _judge(pa.table({"kind": kind, "doc": table.column("doc"), "tag": table.column("tag"), "blob": table.column("bytes")}))
        return judged.filter(pc.invert(judged.column("open")))
    doc, tag, start = (table.column(c).to_numpy() for c in ("doc", "tag", "start"))
    column = table.column("bytes").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    data, offsets = binary_column(column)
    owner, inner, place = _places(np.diff(offsets), offsets[:-1])
    # Suffixes whose hash is unique can't be equal to another; the others are sorted as bytes.
    hashes = _string_hashes(data, place, _BYTES)
    by_hash = np.argsort(hashes)
    same = hashes[by_hash[1:]] == hashes[by_hash[:-1]]
    again = np.zeros(len(by_hash), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    some = by_hash[again]
    if not len(some):
        return _rows(False, [], [], [], [])
    text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[place[some]]).view(f"S{LENGTH}").reshape(-1)
    order = np.argsort(text, kind="stable")
    some, text = some[order], text[order]
    heads = np.flatnonzero(_runs(text))
    least = np.minimum.reduceat(doc[owner[some]], heads)[np.cumsum(_runs(text)) - 1]
    hit = some[doc[owner[some]] > least]
    at = start[owner[hit]].astype(np.int64) + inner[hit]
    return _span_rows(_spans(doc[owner[hit]], tag[owner[hit]], at, at + LENGTH))


_OUT = pa.schema(
    [
        ("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
    ]
)
_OUT_DDL = "doc long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            out: dict[str, list] = {name: [] for name in _OUT.names}
            for i, doc in enumerate(part.column(0).to_pylist()):
                data, found = part.column(1)[i].as_py(), part.column(2)[i].values
                spans, kept = [], data
                if found is not None and len(found):
                    start = found.field("start").to_numpy().astype(np.int64)
                    a, b = _merged(start, start + found.field("length").to_numpy())
                    spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    edges = [0, *(v for s in spans for v in (s["start"], s["end"])), len(data)]
                    kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                row = (doc, len(data), len(data) - len(kept), spans, kept)
                for name, value in zip(_OUT.names, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_OUT)


def dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: doc (null ids as the greatest long), n_bytes, n_removed, spans removed, kept bytes."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select(id_key().alias("doc"), text_tag().bitwiseAND(2**32 - 1).alias("tag"), data.alias("data"))
    total = total_bytes(docs, "text")
    buckets = pieces(total, bucket_bytes, 8)
    triggers = _hot_triggers(rows, total, hot)

    def judge(table: pa.Table) -> pa.Table:
        return _judge(table, triggers)

    judged = stage(
        rows.mapInArrow(_parse(buckets, triggers), _RECORDS_DDL).groupBy("bucket").applyInArrow(judge, _JUDGED_DDL), "phrases"
    )
    release(docs.sparkSession)
    openings = judged.where("open").groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "length", "trigger")).alias("open"))
    fetched = rows.join(openings, ["doc", "tag"]).select("doc", "tag", "data", "open").mapInArrow(_fetch(buckets, triggers), _FETCHED_DDL)
    ordered = stage(fetched.groupBy("bucket").applyInArrow(_order, _JUDGED_DDL), "suffix-spans")
    release(docs.sparkSession)
    spans = (
        judged.where("not open").unionByName(ordered)
        .groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    )
    return rows.join(spans, ["doc", "tag"], "left").select("doc", "data", "spans").mapInArrow(_cut, _OUT_DDL)
