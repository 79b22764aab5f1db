"""Chat formatting: what is parsed back is what was said."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from momentloom.llm import chat
from momentloom.llm.q_chat import CLASH

PARTS = st.lists(st.sampled_from(["### ", "</turn>", "\\", ": ", "\n", "a", "é", " ", "###", "<", "/turn>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PARTS, PARTS, PARTS)
def test_round_trip(role, text, more):
    one, a, b = chat.write_turn(role, text)
    two, *_ = chat.write_turn("user", more)
    assert [t[:2] for t in chat.parse(one + two)] == [(role, text), ("user", more)]
    assert chat.read_until(one[a:b] + chat.CLOSE, 0, chat.CLOSE)[0] == text


def test_plain_text_is_not_escaped():
    assert chat.write_turn("user", "a\\b: c")[0] == "### user: a\\b: c</turn>\n"
    assert chat.write_turn("user", CLASH)[0].count("\\") > 2


def test_broken_text_is_refused():
    for bad in ("hello", "### user: x", "### user: x</turn>", "### user: ### x</turn>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse(bad)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", CLASH), (1, 2, "user", None), (2, 0, None, ""), (2, None, "assistant", "first"), (None, 0, "assistant", "x"),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "user", "long " * 50_000)]
    rows += [(5, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.write_turn(x[2], x[3])[0]) for x in turns)
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []
