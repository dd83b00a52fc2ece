"""Repair of conversations against trying all edits."""

import hashlib
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arrpipe.llm import repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SPACE = " \t\n\x0b\x0c\r"


def all_best(rows):
    """By breadth-first closure over (row, state) with whole (cost, audit, lines) values: no bounds, no stack."""
    layer = {"": (0, "", ())}

    def put(target, state, value):
        if state not in target or value < target[state]:
            target[state] = value

    def inserts(at):
        for _ in range(4):
            for state, (c, a, lines) in list(at.items()):
                for new, role in (("u", "user"), ("a", "assistant")):
                    if NEXT.get((state, new)):
                        put(at, new, (c + 2, a + "I", (*lines, f"{role}:")))
        return at

    for role, text, fault in rows:
        after = {}
        for state, (c, a, lines) in inserts(layer).items():
            put(after, state, (c + 3, a + "D", lines))
            if fault in (1, 2):
                continue
            more = 1 if fault == 3 else 0
            if NEXT.get((state, role[:1])):
                put(after, role[:1], (c + more, a + "K", (*lines, f"{role}:{text}")))
            for new, name in (("u", "user"), ("a", "assistant")):
                if NEXT.get((state, new)):
                    put(after, new, (c + more + 2, a + "R", (*lines, f"{name}:{text}")))
        layer = after
    end = inserts(layer)
    return min(end[s] for s in ("", "a") if s in end)


def exhaustive(rows, limit=3):
    """Every sequence of edits, up to ``limit`` inserts in a row."""
    best = None
    stack = [(0, "", 0, "", 0)]
    while stack:
        i, state, c, a, run = stack.pop()
        if i == len(rows) and state in ("", "a") and (best is None or (c, a) < best):
            best = (c, a)
        for new in "ua":
            if run < limit and NEXT.get((state, new)):
                stack.append((i, new, c + 2, a + "I", run + 1))
        if i < len(rows):
            initial, fault = rows[i]
            stack.append((i + 1, state, c + 3, a + "D", 0))
            if fault not in (1, 2):
                more = 1 if fault == 3 else 0
                if NEXT.get((state, initial)):
                    stack.append((i + 1, initial, c + more, a + "K", 0))
                for new in "ua":
                    if NEXT.get((state, new)):
                        stack.append((i + 1, new, c + more + 2, a + "R", 0))
    return best


ROW = st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([0, 0, 0, 1, 2, 3]))


@given(st.lists(ROW, max_size=4))
@settings(max_examples=300, deadline=None)
def test_search_equals_all_edits(rows):
    assert repair.cheapest(rows) == exhaustive(rows)


@given(st.lists(ROW, max_size=40))
@settings(max_examples=300, deadline=None)
def test_search_equals_tables(rows):
    named = [({"s": "system", "u": "user", "a": "assistant"}.get(r, r), "", f) for r, f in rows]
    assert repair.cheapest(rows) == all_best(named)[:2]


def test_long_conversations_are_linear():
    rows = [("u", 0), ("u", 3), ("a", 0), ("s", 0), ("a", 2)] * 20_000
    cost, audit = repair.cheapest(rows)
    assert cost == repair.suffix_bounds(rows)[0][0] and len(audit) >= len(rows)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def brute(rows):
    groups = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damaged(rows):
        groups[conv].append((turn, role, text))
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in own:
            core = text.rstrip(SPACE)
            fault = 1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, *_ in own if t is not None]
        n = Counter(f for *_, f in faulty)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = all_best(faulty)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield (conv, gaps, n[1], n[2], n[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, partitions=4):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as fault", "1 as pos", "true as dropped").repartition(partitions)
    return repair.digests(repair.repaired(repair.with_faults(repair.damaged(df)))).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Fine.", "And so\n", "why? \t", "", " \x0b", None, "é!", "same.", "same.", "nbsp.\xa0", "x" * 3000 + "."]
    rows = [
        (conv, r.choice([None, *range(12)]) if conv % 3 == 0 else turn, r.choice(roles), r.choice(texts))
        for conv in range(150) for turn in range(r.choice([1, 2, 5, 9, 30]))
    ]
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "a"), (-7, None, None, None), (-8, -5, "user", "q?"), (-8, 9, "assistant", "a.")]
    assert sorted(map(repr, map(tuple, run(spark, rows)))) == sorted(map(repr, brute(rows)))


def test_rows_all_dropped_and_empty(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in run(spark, [(conv, 0, "user", "x.")])] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(spark, []) == []


def test_edits_are_written_in_order(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "q?"), ("user", "q?"), ("tool", "found."), ("user", "more")])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "false as dropped")
    found = [tuple(r)[4:] for r in repair.repaired(repair.with_faults(df)).collect()]
    assert found == [("K", "user", "q?"), ("D", None, None), ("R", "assistant", "found."), ("D", None, None)]
