"""Chat formatting: layouts, escapes, masks and reading back."""

from __future__ import annotations

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from stallwise.llm import chat

MARKS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", " ", "\n", "é"])
TEXT = st.lists(MARKS, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    formatted, spans = chat.render(turns, learn="a")
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "a"]


def test_layouts_give_the_same_turns():
    registry = chat.Registry()
    want = [("user", "q"), ("assistant", "a")]
    for record in ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
                   {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3, "meta": {"x": 1}},
                   {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"}, {"prompt": "q", "response": "a"},
                   {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}, {"data": {"messages": [{"content": "q", "role": "user"}, {"content": "a", "role": "assistant"}]}}):
        mark, name, turns = registry.turns(record)
        assert turns == want and name, record
    assert registry.turns({"foo": 1})[1:] == (None, []) and registry.turns([1])[1:] == (None, [])
    assert registry.print_of({"b": 1, "prompt": 2, "response": 3}) == registry.print_of({"response": 0, "prompt": None, "zz": []})


def test_table(spark):
    rows = [(1, 1, "assistant", "a\n"), (1, 0, "user", None), (1, 0, "user", "</s>x"), (2, None, None, "t"), (3, 0, "system", "long " * 50_000), (None, 0, "user", "n"), (2, None, None, "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("conv_id", "conv_id")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.from_turns(df))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nuser\n</s>x\nassistant\na\n\n") and got[1]["n_turns"] == 3
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, sha("a\n"))
    assert got[2]["turns_sha256"] == sha("\nt\n\nt\n") and got[3]["n_turns"] == 1 and got[None]["n_turns"] == 1
    empty = chat.format_chats(chat.from_turns(df.limit(0)))
    assert empty.count() == 0


def test_broken_records(spark):
    df = spark.createDataFrame([("{",), (None,), ("3",), (json.dumps({"messages": []}),)], "record string")
    assert [(r["layout"], r["formatted"]) for r in chat.format_chats(df).collect()] == [(None, "")] * 4
