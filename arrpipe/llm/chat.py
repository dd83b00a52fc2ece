"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, ``<s>[INST]role[/INST]text</s>`` per turn. The four control
strings are special tokens of the tokenizer, so no token crosses a turn's edges. Control strings
inside roles and texts are escaped by one backslash after their first character, and
ones that already hold backslashes there get one more, which makes the escape reversible. The rendering is encoded once, with
offsets. The loss mask is the intersection of the sorted spans of the loss roles' texts with the
sorted token spans, found by binary search.

Rows are hash-partitioned by conversation, sorted by turn and streamed, so memory is bounded by
``part_chars`` and not by a conversation: one that renders longer comes in several parts, cut
between turns, where the encoding can't differ.

Defined results: a null text or role is empty; null turns stand first; rows of one turn are
ordered by role, then text; a null conversation id is a conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSS_ROLES = ("assistant",)
PART_CHARS = 1_000_000

OPEN, HEAD, CLOSE, START = "[INST]", "[/INST]", "</s>", "<s>"
_CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>)")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>)")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)

_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string()),
        ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())),
    ]
)
_DDL = "conv_id long, part int, last boolean, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], loss_roles=LOSS_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns and the spans under the loss, in order."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{OPEN}{escape(role)}{HEAD}", escape(text)
        if role in loss_roles and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(pieces), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet a span: both are sorted, so each span is a run of tokens."""
    mask = np.zeros(len(starts), dtype=bool)
    first = np.searchsorted(ends, [s for s, _ in spans], side="right")
    last = np.searchsorted(starts, [e for _, e in spans], side="left")
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        mask[a:b] = True
    return mask


def tokenizer_of(definition: str):
    """The tokenizer with the control strings as special tokens and untrimmed offsets."""
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.add_special_tokens([START, CLOSE, OPEN, HEAD])
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def _format(shared, loss_roles: tuple[str, ...], part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = tokenizer_of(shared.value)
        done: list = []

        def encoded() -> pa.RecordBatch:
            rendered = [render(turns, loss_roles) for _, _, _, turns in done]
            found = tokenizer.encode_batch([t for t, _ in rendered], add_special_tokens=False)
            counts = np.array([len(e) for e in found])
            edges = np.cumsum(np.concatenate([[0], counts]))
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32, edges[-1])
            pairs = chain.from_iterable(chain.from_iterable(e.offsets for e in found))
            offsets = np.fromiter(pairs, np.int32, 2 * edges[-1]).reshape(-1, 2)
            starts, ends = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1])
            mask = np.zeros(len(ids), dtype=bool)
            for a, b, (_, spans) in zip(edges[:-1].tolist(), edges[1:].tolist(), rendered, strict=True):
                mask[a:b] = loss_mask(starts[a:b], ends[a:b], spans)
            columns = [*list(zip(*done, strict=True))[:3], [t for t, _ in rendered]]
            done.clear()
            kinds = _SCHEMA.types
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                + [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v)) for v in (ids, starts, ends, mask)],
                schema=_SCHEMA,
            )

        none = object()
        current, part, turns, chars, held = none, 0, [], 0, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for conv, role, text in zip(*columns, strict=True):
                role, text = role or "", text or ""
                if conv != current or chars >= part_chars:
                    if current is not none:
                        done.append((current, part, conv != current, turns))
                    part = part + 1 if conv == current else 0
                    current, turns, chars = conv, [], 0
                    if held >= 200_000:
                        yield encoded()
                        held = 0
                turns.append((role, text))
                chars += len(role) + len(text) + 20
                held += len(role) + len(text) + 20
        if current is not none:
            done.append((current, part, True, turns))
        if done:
            yield encoded()

    return run


def formatted(conversations: DataFrame, tokenizer: str, loss_roles=LOSS_ROLES, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows of a conversation's rendering: text, token ids, their character spans, and the loss mask.

    Parts of one conversation follow each other in one partition.
    """
    spark = conversations.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer).read_text())  # a file of a fixed size
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(definition, tuple(loss_roles), part_chars), _DDL)


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """What stands under the mask, unescaped; tokens that share a character count it once.

    Tokens under the mask are sorted by start; one that starts beyond all ends before it opens a run.
    """
    a, b = starts[loss], ends[loss]
    if not len(a):
        return ""
    reach = np.maximum.accumulate(b)
    opens = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    closes = np.concatenate([opens[1:], [len(a)]]) - 1
    return "".join(unescape(text[i:j]) for i, j in zip(a[opens].tolist(), reach[closes].tolist(), strict=True))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and where its lists start and end."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turns_sha, loss_sha, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(3)]
        (starts, edges), (ends, _), (loss, _) = (_lists(batch.column(i)) for i in range(3, 6))
        for i, (conv, last, text) in enumerate(zip(*columns, strict=True)):
            for role, said in parse(text):
                turns_sha.update(f"{role}\n{said}\n".encode())
                n_turns += 1
            own = slice(edges[i], edges[i + 1])
            under = masked_text(text, starts[own], ends[own], loss[own])
            loss_sha.update(under.encode())
            loss_chars += len(under)
            chars += len(text)
            if last:
                out.append((conv, n_turns, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars))
                turns_sha, loss_sha, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _DIGEST.types, strict=True)], schema=_DIGEST
        )


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)


def digests(output: DataFrame) -> DataFrame:
    """Per conversation what ``formatted`` says, read back from its texts, offsets and masks."""
    return output.select("conv_id", "last", "text", "starts", "ends", "loss").mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
