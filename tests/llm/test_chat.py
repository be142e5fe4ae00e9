import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import chat
from pyspark.sql import functions as F


def test_every_fingerprint_is_its_own():
    prints = [chat.fingerprint(x.paths) for x in chat.LAYOUTS]
    assert len(set(prints)) == len(prints)


RECORDS = {
    "a": {"messages": [{"role": "System", "content": "be"}, {"role": "user", "content": "x"}, {"role": "assistant", "content": None}]},
    "b": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "source": "s"},
    "c": {"instruction": "do", "input": "", "output": "done"},
    "d": {"instruction": "do", "input": "this", "output": "done", "id": 3},
    "e": {"instruction": "do", "output": None},
    "f": {"prompt": "p", "response": "r", "system": "s"},
    "g": {"prompt": "p", "completion": "c"},
    "h": {"question": "p", "answer": "c"},
    "i": {"messages": []},
    "j": {"prompt": "p", "completion": "c", "answer": "extra"},
    "k": {"nothing": 1},
    "l": None,
    "m": {"turn": 4, "role": "user", "text": "own"},
}
WANT = {
    "a": (["messages"], [("system", "be"), ("user", "x"), ("assistant", "")]),
    "b": (["from and value"], [("user", "q"), ("assistant", "r")]),
    "c": (["instruction and input"], [("user", "do"), ("assistant", "done")]),
    "d": (["instruction and input"], [("user", "do\n\nthis"), ("assistant", "done")]),
    "e": (["instruction"], [("user", "do"), ("assistant", "")]),
    "f": (["system prompt"], [("system", "s"), ("user", "p"), ("assistant", "r")]),
    "g": (["prompt and completion"], [("user", "p"), ("assistant", "c")]),
    "h": (["question and answer"], [("user", "p"), ("assistant", "c")]),
    "i": (["no messages"], []),
    "j": (["prompt and completion"], [("user", "p"), ("assistant", "c")]),
    "k": (["unknown"], []),
    "l": (["unknown"], []),
    "m": (["turn rows"], [("user", "own")]),
}


def test_layouts_of_json(spark):
    rows = [(k, "{broken" if v is None else json.dumps(v), "x") for k, v in RECORDS.items()]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id string, j string, text string"), json_column="j")).collect()
    assert {r.conv_id: (r.layouts, [tuple(t) for t in r.turns]) for r in out} == WANT


def test_layouts_of_columns(spark):
    rows = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")])], "conv_id long, messages array<struct<role: string, content: string>>")
    out = chat.read_back(chat.format_chats(rows)).first()
    assert [tuple(t) for t in out.turns] == [("user", "a"), ("assistant", "b")] and out.loss_text == "b"
    rows = spark.createDataFrame([(1, "x")], "conv_id long, other string")
    assert chat.format_chats(rows).first().layouts == ["unknown"]


def test_rows_of_turns(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "first"), (2, 0, "assistant", "x" * 200_000), (3, 5, "a:\n#\\</turn>", "### user:\n"),
        (3, 5, "a", "tie"), (3, 5, "a", "tie"), (None, 0, "assistant", "n"), (None, 1, "assistant", "\\</turn>\n🙂</turn>"),
    ]
    out = chat.read_back(chat.format_chats(spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, layouts string"))).collect()
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in out}
    assert got == {
        1: ([("", "first"), ("user", ""), ("assistant", "b")], "b"),
        2: ([("assistant", "x" * 200_000)], "x" * 200_000),
        3: ([("a", "tie"), ("a", "tie"), ("a:\n#\\</turn>", "### user:\n")], ""),
        None: ([("assistant", "n"), ("assistant", "\\</turn>\n🙂</turn>")], "n\\</turn>\n🙂</turn>"),
    }
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_roles(spark):
    roles = ["r" * 1_000_000, ":" * 200_000, "\\#:\n</turn>" * 50_000, "a:\n" * 100_000]
    rows = [(i, 0, role, "text " * 100_000) for i, role in enumerate(roles)]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(out) == len(roles) and all([tuple(t) for t in r.turns] == [(roles[r.conv_id], "text " * 100_000)] for r in out)


@pytest.mark.parametrize("seed", range(1))
def test_any_text_comes_back(spark, seed):
    pieces = st.sampled_from(["\\", "#", "###", "<", "/", "</turn>", "turn>", "\n", "### assistant:\n", ":", "$1", "é", "🙂", " ", "a"])
    texts = []

    @settings(max_examples=150, database=None)
    @given(st.lists(pieces, max_size=9).map("".join))
    def gather(t):
        texts.append(t)

    gather()
    rows = [(i, k, role, t) for i, t in enumerate(texts) for k, role in enumerate(["user", "assistant", t])]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in out:
        t = texts[r.conv_id]
        assert [tuple(x) for x in r.turns] == [("user", t), ("assistant", t), (t, t)]
        assert r.loss_text == t * (2 if t == "assistant" else 1)


def test_no_python_in_the_plan(spark):
    plan = chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
