"""Repair of conversation structure at least cost, by depth-first branch and bound.

The turns of a conversation become a sequence of role initials of the form ``(s?(ua)+)?`` by edits: Keep
costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant turn 2; a
truncated turn that isn't deleted adds 1; blank and duplicate turns must be deleted. Of the cheapest edits
those count whose initials in order, the audit, are least.

A node of the search is a row and the state of the pattern before it (nothing yet, s, u, a). The search
keeps an explicit stack, and its next child is the one of the least bound, then of the least initial. A
prefix's bound is its cost and the least cost of any way to end from its node; these suffix bounds are worked out once, from the
last row back. A prefix is dropped if its bound exceeds the incumbent's cost, or equals it
while its audit is greater; or if the dominance table of its node holds a prefix of lower
cost, or of equal cost and lesser audit. (Two prefixes of equal cost at one node are never each other's beginning, as they
could only differ by inserts, so the lesser one stays so however both go on.) The search ends with an empty stack: then the incumbent is proved
best. Audits are held as links to their beginnings, so memory is linear in the turns.

Rows are hash-partitioned by conversation once and streamed in order, each twice: first without
its text, for the search, then with it, to be written. So a task holds some hundred bytes per turn of
one conversation and never its texts; one task repairs a conversation, as its edits and digest are sequential.

Defined results: a null role or text is one space, a null conversation id is a conversation, and null turns stand first; rows
of one turn are ordered by role, then text; repeated rows are rows of their own, hence duplicates; an
empty role has no initial and can't be kept; texts of any length are handled whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OK, BLANK, DUPLICATE, TRUNCATED = range(4)
_NO_ROWS = -1
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1

# Fixed values of the pattern (s?(ua)+)?: states, and what follows on which initial.
_START, _S, _U, _A = range(4)
_NEXT = ({"s": _S, "u": _U}, {"u": _U}, {"a": _A}, {"u": _U})
_WANTED = ("u", "u", "a", "u")
_FILL = tuple(_NEXT[state][initial] for state, initial in enumerate(_WANTED))
_FINAL = (_START, _A)
_ROLE = {_U: "user", _A: "assistant"}
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60


class _Prefix(NamedTuple):
    """Edits so far, as a link."""

    before: _Prefix | None
    edit: str
    length: int


def _lesser(a: _Prefix, b: _Prefix) -> bool:
    """Whether audit ``a`` comes before audit ``b``; neither begins with the other."""
    while a.length > b.length:
        a = a.before
    while b.length > a.length:
        b = b.before
    x = y = ""
    while a is not b:
        x, y, a, b = a.edit, b.edit, a.before, b.before
    return x < y


def suffix_bounds(rows: list[tuple[str, int]]) -> list[list[int]]:
    """For each row and state the least cost of what follows; the entry after the last row comes last."""
    ahead = [0 if state in _FINAL else _FAR for state in range(4)]
    bounds = []
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            initial, fault = rows[i]
            here = [DELETE + x for x in ahead]
            if fault not in (BLANK, DUPLICATE):
                extra = CUT_SHORT if fault == TRUNCATED else 0
                for state in range(4):
                    best = REROLE + extra + ahead[_FILL[state]]
                    to = _NEXT[state].get(initial)
                    if to is not None:
                        best = min(best, KEEP + extra + ahead[to])
                    here[state] = min(here[state], best)
        else:
            here = ahead
        # One or two inserts before the row reach any state that more of them do.
        ahead = [min(here[s], INSERT + here[_FILL[s]], 2 * INSERT + here[_FILL[_FILL[s]]]) for s in range(4)]
        bounds.append(ahead)
    bounds.reverse()
    return bounds


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the best edits of (role initial, fault) rows."""
    bounds = suffix_bounds(rows)
    n = len(rows)
    root = _Prefix(None, "", 0)
    seen: dict[int, tuple[int, _Prefix]] = {}  # the dominance tables, by 4 * row + state
    best, path = _FAR, []  # the incumbent's cost, and its prefixes by length
    stack = [(0, _START, 0, root)]
    while stack:
        i, state, cost, prefix = stack.pop()
        bound = cost + bounds[i][state]
        if bound > best or (bound == best and prefix is not path[prefix.length] and not _lesser(prefix, path[prefix.length])):
            continue
        known = seen.get(4 * i + state)
        if known is not None and (known[0] < cost or (known[0] == cost and not _lesser(prefix, known[1]))):
            continue
        seen[4 * i + state] = (cost, prefix)
        if i == n and state in _FINAL and cost == bound:
            best, path, at = cost, [], prefix
            while at is not None:
                path.append(at)
                at = at.before
            path.reverse()
            continue
        fill = _FILL[state]
        children = [(cost + INSERT + bounds[i][fill], "I", i, fill, cost + INSERT)]
        if i < n:
            initial, fault = rows[i]
            children.append((cost + DELETE + bounds[i + 1][state], "D", i + 1, state, cost + DELETE))
            if fault not in (BLANK, DUPLICATE):
                step = cost + (CUT_SHORT if fault == TRUNCATED else 0)
                to = _NEXT[state].get(initial)
                if to is not None:
                    children.append((step + KEEP + bounds[i + 1][to], "K", i + 1, to, step + KEEP))
                children.append((step + REROLE + bounds[i + 1][fill], "R", i + 1, fill, step + REROLE))
        children.sort(reverse=True)
        for total, edit, row, to, spent in children:
            if total <= best and total < _FAR:
                stack.append((row, to, spent, _Prefix(prefix, edit, prefix.length + 1)))
    return best, "".join(p.edit for p in path)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of ``conv_id:turn``, and ``dropped``."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.encode(F.concat(plain("conv_id"), F.lit(":"), plain("turn")), "UTF-8")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    copies = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(code == 4, "user").otherwise(plain("role")).alias("role"),
        text.alias("text"), (code == 0).alias("dropped"), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault and pos, the place in the conversation, of rows not ``dropped``.

    A conversation has a row of fault -1 for each that was dropped. All windows share one shuffle by conversation.
    """
    full = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    copy = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("pos"))
    pos = F.row_number().over(Window.partitionBy("conv_id", "dropped").orderBy(*order))
    fault = (
        F.when(F.col("dropped"), _NO_ROWS).when(~full, BLANK).when(F.col("_copy") > 1, DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    )
    return (
        rows.repartition("conv_id").withColumn("pos", pos).withColumn("_copy", copy)
        .select("conv_id", "turn", "role", "text", fault.alias("fault"), "pos")
    )


_DDL = "conv_id long, turn long, fault int, old_role string, edit string, role string, text string"
_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("fault", pa.int32()), ("old_role", pa.string()),
        ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
    ]
)


class _Editor:
    """Plays a conversation's audit against its rows as they come."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.rows, self.audit, self.at, self.state = conv, [], None, 0, _START

    def _insert(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, _FILL[self.state]
            yield (self.conv, None, None, None, "I", _ROLE[self.state], "")

    def write(self, turn: int | None, fault: int, role: str, text: str) -> Iterator[tuple]:
        if self.audit is None:
            self.audit = cheapest(self.rows)[1]
            self.rows = []
        yield from self._insert()
        edit = self.audit[self.at]
        self.at += 1
        new = role
        if edit == "R":
            self.state = _FILL[self.state]
            new = _ROLE[self.state]
        elif edit == "K":
            self.state = _NEXT[self.state][role[:1]]
        gone = edit == "D"
        yield (self.conv, turn, fault, role, edit, None if gone else new, None if gone else text)

    def end(self) -> Iterator[tuple]:
        if self.audit is None:  # no rows were left
            yield (self.conv, None, _NO_ROWS, None, None, None, None)
        else:
            yield from self._insert()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, again, turn, fault, role, text): a conversation's rows come without texts, then again with them."""
    editor, out, held = None, [], 0
    for batch in batches:
        for conv, again, turn, fault, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if editor is None or conv != editor.conv:
                if editor is not None:
                    out += editor.end()
                editor = _Editor(conv)
            if fault == _NO_ROWS:
                continue
            if not again:
                editor.rows.append((role[:1], fault))
                continue
            new = list(editor.write(turn, fault, role, text))
            out += new
            held += len(text) + 50 * len(new)
            if held > 2_000_000:
                yield _batch(out)
                out, held = [], 0
    if editor is not None:
        out += editor.end()
    yield _batch(out)


def repaired(rows: DataFrame) -> DataFrame:
    """One row per edit, in order: conv_id, turn, fault, old_role, edit (K, R, D, I), role and text (null if deleted).

    ``rows``: conv_id, turn, role, text, fault, pos of ``with_faults``. A conversation follows itself in one partition; one without
    rows gives one row without an edit.
    """
    none = F.lit(None).cast("string")
    fields = ["turn", "fault", "role"]
    twice = F.array(
        F.struct(F.lit(False).alias("again"), "pos", *fields, none.alias("text")),
        F.struct(F.lit(True).alias("again"), "pos", *fields, F.col("text")),
    )
    ordered = (
        rows.select("conv_id", F.explode(twice).alias("r")).select("conv_id", "r.*")
        .sortWithinPartitions("conv_id", "again", "pos")
    )
    return ordered.select("conv_id", "again", *fields, "text").mapInArrow(_edits, _DDL)


_DIGEST = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


class _Digest:
    def __init__(self, conv: int | None) -> None:
        self.conv, self.faults, self.illegal, self.cost = conv, [0, 0, 0, 0], 0, 0
        self.audit: list[str] = []
        self.sha, self.lines, self.initial = hashlib.sha256(), 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, fault: int | None, old: str | None, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            self.faults[fault] += 1
            self.cost += CUT_SHORT if fault == TRUNCATED and edit != "D" else 0
            if self.initial is not None and self.initial + old[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = old[:1]
            if turn is not None:  # turns come in order
                self.turns += turn != self.high
                self.low = turn if self.low is None else self.low
                self.high = turn
        if edit != "D":
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current = None
    for batch in batches:
        out = []
        for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or conv != current.conv:
                if current is not None:
                    out.append(current.row())
                current = _Digest(conv)
            if rest[3] is not None:
                current.add(*rest)
        yield _digest_batch(out)
    yield _digest_batch([current.row()] if current is not None else [])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_DIGEST)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DIGEST.types, strict=True)], schema=_DIGEST)


def digests(output: DataFrame) -> DataFrame:
    """Per conversation the counts of faults, the cost, the audit and the digest of what ``repaired`` wrote."""
    return output.mapInArrow(
        _digests,
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    )
