"""Packing token sequences harmonically.

Lengths fall into reciprocal-capacity classes: class ``k`` has the pieces of which ``k`` and no more fit
into one sequence, ``capacity / (k + 1) < length <= capacity / k``, and each of its bins takes exactly ``k``
pieces. A document is cut so that its pieces fill their classes' bins: as long as more is left
than the square root of the capacity, the longest reciprocal length ``capacity // k`` that is not
longer comes off its front; a shorter rest is a piece of its own. So a document of at most the capacity gives
about three pieces, and a full bin leaves less than ``min(k, length)`` places open.

Bins are filled by each task for itself, from the rows in the order it reads them: nothing is shuffled, and a
task that is repeated writes its sequences anew as a whole. Bins that are still open when a task's rows
end, at most ``k - 1`` pieces a class, are closed by cutting: their pieces follow each other in
sequences of the capacity, and what is left at last goes into sequences of a power of two of tokens,
which need no padding.

Tokens: white space parts words in this tokenizer, so a text is cut at ASCII white space, each distinct
word is encoded once for the task's ``CACHE`` latest words, and a text's ids are those of its words in order. This
equals encoding the whole text. Marks that follow an ASCII or Latin-1 letter or digit at a word's end are encoded
apart, as the tokenizer's pattern keeps them apart likewise.

Defined results: a null text is empty, and an empty text is the end id alone; a null doc_id stays null; repeated
rows are documents of their own; an empty table gives an empty result; other columns are ignored.
A very long text is encoded in slices of about ``SLICE`` characters, cut at white space, so what
a task holds of it is its ids.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice
from math import isqrt
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 1
SLICE = 1_000_000
CACHE = 1_000_000
_FLUSH = 4_000_000

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~"
#: Letters are one unit of the tokenizer's pattern, whatever stands beside them, and it doesn't see their case.
_UNIT = re.compile(rf"([{_LETTER}]+)([{_MARKS}]*)")
#: Other words with marks at their end; these are without the apostrophe and those of the tokenizer's special strings.
_TAIL = re.compile(rf"(.*[{_LETTER}0-9])([{_MARKS}]+)", re.S)
_RUN = 1000
_BLANK = re.compile(r"[ \t\n\r\x0b\x0c]")

_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)
_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the pieces of ``n`` tokens, in order: reciprocals of the capacity, then a short rest."""
    out, short = [], isqrt(capacity)
    while n > short:
        piece = capacity // -(-capacity // n)
        out.append(piece)
        n -= piece
    return [*out, n] if n else out


class _Numbers(dict):
    """Words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Token ids of texts, by way of their distinct words."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()  # words; each is two parts, the second one often empty
        self.first, self.second = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.parts = _Numbers({"": 0})  # and where their ids lie in ``flat``
        self.start, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _store(self, numbers: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        sizes = np.diff(ends, prepend=0)
        self.start[numbers], self.size[numbers] = self.used + ends - sizes, sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, and where each one's end."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([len(ids) for ids in found], dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, ends[-1]), ends

    def _learn(self, words: list[bytes]) -> None:
        """New words: their parts, and the ids of parts that are new."""
        n, known = len(self.known), len(self.parts)
        first, second = [], []
        for word in words:
            text = word.decode()
            unit = _UNIT.fullmatch(text)
            if unit:
                first.append(self.parts[unit[1].lower()])
                second.append(self.parts[unit[2]])
            else:
                cut = _TAIL.fullmatch(text)
                first.append(self.parts[cut[1] if cut else text])
                second.append(self.parts[cut[2] if cut else ""])
        while n > len(self.first):
            self.first, self.second = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.second))
        self.first[n - len(words) : n], self.second[n - len(words) : n] = first, second
        while len(self.parts) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        units, others = [], []
        for part in islice(self.parts, known, None):
            (units if _UNIT.fullmatch(part) else others).append(part)
        if units:  # in runs of many: a token that ends a word closes each
            ids, _ = self._encoded([" ".join(units[i : i + _RUN]) for i in range(0, len(units), _RUN)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(units) and ends[-1] == len(ids):
                self._store([self.parts[x] for x in units], ids, ends)
            else:
                others += units
        if others:
            self._store([self.parts[x] for x in others], *self._encoded(others))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.known) > CACHE:
            self._clear()
        split = [text.encode().split() for text in texts]
        counts = np.cumsum([len(words) for words in split])
        before = len(self.known)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int32, counts[-1])
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        parts = np.empty(2 * len(index), np.int32)
        parts[::2], parts[1::2] = self.first[index], self.second[index]
        sizes = self.size[parts]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(self.start[parts] - (ends - sizes), sizes)
        return np.split(self.flat[places], np.concatenate([[0], ends])[2 * counts[:-1]])


def slices(text: str, limit: int) -> Iterator[str]:
    """The text in parts of about ``limit`` characters that start at white space."""
    at = 0
    while len(text) - at > limit:
        blank = _BLANK.search(text, at + limit)
        if not blank:
            break
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:] if at else text


class _Bins:
    """One task's open bins and the rows of its closed ones."""

    def __init__(self, task: int, capacity: int) -> None:
        self.capacity, self.next, self.held = capacity, task << 36, 0
        self.open: dict[int, list] = defaultdict(list)
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, self.next, at))
            at += len(ids)
        self.held += 4 * at
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        for length in cut_lengths(n, self.capacity):
            k = self.capacity // length
            self.open[k].append((doc, at, ids[at : at + length], n))
            at += length
            if len(self.open[k]) == k:
                self._close(self.open.pop(k))

    def finish(self) -> None:
        """What is in open bins, one piece after the other, in sequences that need no padding."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(ids) for _, _, ids, _ in pieces)
        self.open.clear()
        pieces.reverse()
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left, taken = left - size, []
            while size:
                doc, start, ids, n = pieces.pop()
                if len(ids) > size:
                    pieces.append((doc, start + size, ids[size:], n))
                    ids = ids[:size]
                taken.append((doc, start, ids, n))
                size -= len(ids)
            self._close(taken)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(_SCHEMA)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _pack(shared, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, bins = Encoder(shared.value), _Bins(TaskContext.get().partitionId(), capacity)
        end = np.array([end_id], np.uint32)
        docs: list = []  # (doc_id, whether the document ends here) of ``parts``
        parts: list[str] = []
        before: list[np.ndarray] = []  # ids of the slices of a document that has not ended

        def encoded() -> None:
            for (doc, last), ids in zip(docs, encoder.encode(parts), strict=True):
                before.append(ids)
                if last:
                    bins.add(doc, np.concatenate([*before, end]))
                    before.clear()
            docs.clear()
            parts.clear()

        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                cut = list(slices(text, SLICE))
                for at, part in enumerate(cut, 1):
                    docs.append((doc, at == len(cut)))
                    parts.append(part)
                    held += len(part) + 1
                    if held >= SLICE:
                        encoded()
                        held = 0
                if bins.held >= _FLUSH:
                    yield bins.batch()
        encoded()
        bins.finish()
        yield bins.batch()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of each piece.

    ``docs`` has doc_id and text; ``tokenizer`` is a file for the ``tokenizers`` library whose words white space parts.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())  # a file of a fixed size
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_pack(definition, capacity, end_id), _DDL)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, and ids padded to the capacity unless their number is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(capacity) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.when(F.bit_count("n_tokens") == 1, ids).otherwise(F.concat(ids, pad)).alias("ids"))
