"""Chat formatting: exact round trips, masks, parts."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arrpipe.llm import chat
from arrpipe.llm.queries import QUERIES, tokenizer_file

TOKENIZER = tokenizer_file("byte_bpe_50k.json")

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[", "<", "/s>", "a", " ", "é", "\U0001f600", "\n", "INST]", "<\\s>", "[\\\\/INST]"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>"]), TEXT), max_size=6))
@settings(max_examples=100, deadline=None)
def test_render_parse(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def digest(turns):
    a = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), a, len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 10])
def test_digests(spark, part_chars):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 1, "assistant", "  lead and trail  "), (1, 0, "user", None),
            (2, 0, None, "x"), (2, 0, "assistant", "\U0001f600é\\[INST]"), (2, 0, "assistant", ""), (None, 0, "assistant", "null id"), (3, None, "user", "first"), (3, 5, "assistant", "a" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as ids").repartition(4)
    groups = {}
    for c, t, r, x in sorted(rows, key=lambda z: (str(z[0]), -1 if z[1] is None else z[1], z[2] or "", z[3] or "")):
        groups.setdefault(c, []).append((r or "", x or ""))
    output = chat.formatted(df, TOKENIZER, part_chars=part_chars)
    found = {r.conv_id: r for r in chat.digests(output).collect()}
    assert set(found) == set(groups)
    for c, turns in groups.items():
        r = found[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(turns)
    whole = "".join(r.text for r in output.collect() if r.conv_id == 3)
    assert len(whole) == found[3].formatted_chars


def test_query_on_the_whole_table(spark):
    """The registered query against digests of the input by plain Python."""
    sf_dir = "/root/testdata/sf0.01"
    said, groups = "</s>[INST] ok [/INST]", {}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for c, _, r, x in sorted([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)], key=lambda z: (z[0], -1 if z[1] is None else z[1], z[2] or "", z[3] or "")):
        groups.setdefault(c, []).append((r or "", x or ""))
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op7_chat_format"](spark, sf_dir).collect()}
    assert found == {c: digest(turns) for c, turns in groups.items()}


def test_masked_runs():
    """Tokens that share a character, and runs that do or don't touch."""
    starts, ends = np.array([0, 1, 1, 1, 2, 4, 6]), np.array([1, 2, 2, 2, 4, 6, 7])
    for bits in range(2**7):
        loss = np.array([bits >> i & 1 for i in range(7)], dtype=bool)
        under = {i for a, b, keep in zip(starts, ends, loss, strict=True) if keep for i in range(a, b)}
        assert chat.masked_text("abcdefg", starts, ends, loss) == "".join("abcdefg"[i] for i in sorted(under))


def test_tokens_cover_the_text_and_masks_follow_spans(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi  you"), (1, 1, "assistant", "well, été \U0001f600!")], "conv_id long, turn long, role string, text string")
    r = chat.formatted(df, TOKENIZER).first()
    assert r.starts[0] == 0 and r.ends[-1] == len(r.text)
    assert all(b <= e for b, e in zip(r.starts, r.ends, strict=True))
    a, b = chat.render([("user", "hi  you"), ("assistant", "well, été \U0001f600!")])[1][0]
    for s, e, m in zip(r.starts, r.ends, r.loss, strict=True):
        assert m == (s < b and e > a) and (not m or (s >= a and e <= b))


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(df, TOKENIZER)).collect() == []
