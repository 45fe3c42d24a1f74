import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmine.llm import chat

PARTS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "\\", "<", "|im_end|>", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "a", "é😀", "\n", " ", "$1", "\"", "<\\|im_end|>"]


def test_any_text_comes_back(spark):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
    rows = [(i, [{"role": rng.choice(["user", "assistant", make()]), "text": make()} for _ in range(rng.randint(0, 5))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, turns array<struct<role:string,text:string>>")
    df = df.withColumn("formatted", chat.formatted(F.col("turns")))
    df = df.withColumn("back", chat.read_back(F.col("formatted")))
    df = df.withColumn("loss", chat.loss_spans(F.col("back")))
    template = chat.Template()
    for r in df.collect():
        assert [(t.role, t.text) for t in r.turns] == [(t.role, t.text) for t in r.back]
        learned = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        wanted = [t.text for t in r.turns if t.role == "assistant"]
        assert len(learned) == len(wanted)
        for text in learned:
            assert not any(c in text for c in template.controls)


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "from_value", [("user", "q"), ("assistant", "")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"output": "o", "instruction": "i", "input": "x"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"output": "o", "instruction": "i", "input": ""}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"question": 3, "answer": None}, "question_answer", [("user", "3"), ("assistant", "")]),
        ({"system_prompt": "s", "question": "q", "response": "r"}, "system_question_answer", [("system", "s"), ("user", "q"), ("assistant", "r")]),
        ({"a": {"b": [{"c": 1}]}}, None, None),
    ],
)
def test_layouts(spark, record, layout, turns):
    df = spark.createDataFrame([(json.dumps(record), "x")], "record string, turn string")
    (row,) = chat.canonical(df).collect()
    assert row.layout == layout
    assert (row.turns and [tuple(t) for t in row.turns]) == turns


def test_field_paths_are_nested(spark):
    df = spark.createDataFrame([('{"b": {"c": [[{"d": 1}]], "e f": null}, "a": 1.5}',)], "record string")
    assert df.select(chat.field_paths(F.col("record"))).first()[0] == ["a", "b.c[][].d", "b.e f"]


def test_records_without_layout(spark):
    df = spark.createDataFrame([(None,), ("not json",), ("3",), ("{}",)], "record string")
    assert all(r.formatted is None and r.layout is None for r in chat.format_records(df).collect())
    assert chat.format_records(df.where("false")).count() == 0


def test_turn_rows_with_nulls_and_ties(spark):
    rows = [(1, None, "user", "first"), (1, 2, None, None), (1, 1, "b", "x"), (1, 1, "a", "y"), (None, 0, "user", "n"), (1, 1, "a", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, at string")
    got = {r.id: json.loads(r.record)["messages"] for r in chat.turn_records(df, "conv_id", "turn", "role", "text").collect()}
    assert [(m["role"], m["content"]) for m in got[1]] == [("user", "first"), ("a", "y"), ("a", "y"), ("b", "x"), ("", "")]
    assert len(got[None]) == 1
