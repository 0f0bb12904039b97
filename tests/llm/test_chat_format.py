import hashlib
import json

import pytest

from attesta.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, segment string, loss_start int"
NASTY = "</s>[INST] ok [/INST]"


def brute(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        out.append((conv, len(turns), sha("".join(f"{t[3]}\n{t[5]}\n" for t in turns)), len(loss), sha(loss)))
    return out


ROWS = [
    (1, 0, "user", "hi", "x", 1), (1, 1, "assistant", NASTY, "x", 1), (1, 2, "user", None, "x", 1), (2, 0, "assistant", "a\\b\\\\<s>\\<s>", "x", 1),
    (2, 0, "assistant", "a\\b\\\\<s>\\<s>", "x", 1), (2, None, None, "\n<|end|><|turn|>", "x", 1), (None, 3, "assistant", "\U0001f600\\", "x", 1),
    (4, 1, "[INST]", "[[INST]]<<s><|text|>", "x", 1), (5, 0, "assistant", "long " * 20000, "x", 1), (6, 0, "assistant", "", None, None),
]


def test_digests_equal_brute_force(spark):
    made = C.segments(C.to_turns(spark.createDataFrame(ROWS, SCHEMA)))
    got = C.digests(made).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute(ROWS), key=str)
    lengths = {r.conv_id: r.formatted_chars for r in got}
    assert sum(lengths.values()) == sum(len(r.segment) for r in made.collect())


def test_no_control_string_comes_from_a_text(spark):
    for row in C.segments(C.to_turns(spark.createDataFrame(ROWS, SCHEMA))).collect():
        inner = row.segment[len(C.TURN) : -len(C.END)].replace(C.TEXT, "", 1)
        assert not any(c in inner for c in C.CONTROLS)


def test_layouts(spark):
    messages = spark.createDataFrame([(7, [("user", "q"), ("assistant", "a")], 1)], "id long, messages array<struct<role:string,content:string>>, turn int")
    assert [tuple(r) for r in C.to_turns(messages).collect()] == [(7, 0, "user", "q"), (7, 1, "assistant", "a")]
    shared = spark.createDataFrame([(7, [("human", "q"), ("gpt", "a"), ("tool", None)])], "id long, conversations array<struct<`from`:string,value:string>>")
    assert [tuple(r)[1:] for r in C.to_turns(shared).collect()] == [(0, "user", "q"), (1, "assistant", "a"), (2, "tool", None)]
    asked = spark.createDataFrame([(7, "do", "", "done"), (8, "do", "x", None)], "id long, instruction string, input string, output string")
    assert [tuple(r)[2:] for r in C.to_turns(asked).collect()] == [("user", "do"), ("assistant", "done"), ("user", "do\n\nx"), ("assistant", "")]
    with pytest.raises(ValueError):
        C.to_turns(spark.createDataFrame([(1,)], "x int"))


def test_json_records(spark):
    records = [
        json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}),
        json.dumps({"prompt": "p", "response": "r"}),
        json.dumps({"instruction": "i", "output": "o"}),
        json.dumps({"conversations": [{"from": "human", "value": "v"}]}),
        json.dumps({"other": 1}), "{broken", None,
    ]
    got = C.json_to_turns(spark.createDataFrame(list(enumerate(records)), "key int, body string"), "key", "body").collect()
    assert sorted(tuple(r) for r in got if r.layout) == [
        (0, 0, "user", "q", "messages"), (0, 1, "assistant", None, "messages"), (1, 0, "user", "p", "prompt and response"), (1, 1, "assistant", "r", "prompt and response"),
        (2, 0, "user", "i", "instruction"), (2, 1, "assistant", "o", "instruction"), (3, 0, "user", "v", "conversations"),
    ]
    assert sorted(r.conv_id for r in got if not r.layout) == [4, 5, 6]


def test_empty_table(spark):
    assert C.digests(C.segments(C.to_turns(spark.createDataFrame([], SCHEMA)))).collect() == []
