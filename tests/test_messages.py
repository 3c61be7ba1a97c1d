import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import messages as M
from tessera.functions import replies

PAIR = "array<struct<role:string,content:string>>"


def rows(spark, values, kind=PAIR, column="messages"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {column} {kind}")


def reasons(df):
    return [r.drop_reason for r in df.orderBy("id").collect()]


def test_default_spelling_and_extra_fields(spark):
    df = rows(spark, [[("user", "Hi", 3), ("assistant", "", 4)]], "array<struct<role:string,content:string,x:int>>")
    got = M.normalize(df).first()
    assert got.drop_reason is None and [tuple(t) for t in got.turns] == [("user", "Hi"), ("assistant", "")]


def test_other_spelling_needs_its_schema(spark):
    df = rows(spark, [[("human", "q"), ("gpt", "a"), ("tool", "t")]], "array<struct<`from`:string,value:string>>", "conversations")
    schema = M.MessageSchema("from", "value", {"human": "user", "gpt": "assistant"})
    assert [t.role for t in M.normalize(df, "conversations", schema).first().turns] == ["user", "assistant", "tool"]
    assert reasons(M.normalize(df, "conversations")) == ["bad_message"]


def test_json_is_strict(spark):
    good = [{"role": "user", "content": "é😀"}, {"role": "assistant", "content": "a"}]
    texts = [json.dumps(good), "[]", '{"role":"user","content":"x"}', "7", "null", "[{", '[{"role":"user","content":1}]', '[{"role":"user"}]', '["x"]', "[null]", None]
    got = M.normalize(rows(spark, texts, "string"))
    assert reasons(got) == [None, "empty", *["not_a_sequence"] * 4, *["bad_message"] * 4, "not_a_sequence"]
    assert got.orderBy("id").first().turns[0].content == "é😀"


def test_rejections_of_arrays(spark):
    got = M.normalize(rows(spark, [None, [], [("user", None)], [None], [("user", "x")]]))
    assert reasons(got) == ["not_a_sequence", "empty", "bad_message", "bad_message", None]
    assert reasons(M.final_assistant(got))[-1] == "last_not_assistant"


def test_missing_column(spark):
    df = rows(spark, [[("user", "x")]])
    assert reasons(M.normalize(df, "nope")) == ["missing_column"]
    with pytest.raises(ValueError):
        M.normalize(df, "nope", strict=True)


@pytest.mark.parametrize("prompt, want", [(None, ["user", "assistant"]), ("", ["user", "assistant"]), ("Be brief.", ["system", "user", "assistant"])])
def test_system_prompt(spark, prompt, want):
    df = M.inject_system(M.normalize(rows(spark, [[("user", "q"), ("assistant", "a")], [("system", "s"), ("assistant", "a")]])), prompt)
    got = [[t.role for t in r.turns] for r in df.orderBy("id").collect()]
    assert got == [want, ["system", "assistant"]]


def test_tags_are_looked_for_in_the_last_turn_in_any_order(spark):
    values = [[("assistant", c)] for c in ("<think>x</think>y", "</think><think>", "<think>", "plain")]
    assert reasons(M.require_tags(M.normalize(rows(spark, values)))) == [None, None, "missing_reasoning_tags", "missing_reasoning_tags"]


@pytest.mark.parametrize("block", [{"x": 1}, {"role_key": ""}, {"content_key": 3}, {"role_map": {"a": 1}}, {"role_map": ["a"]}, "role"])
def test_malformed_schema_blocks(block):
    with pytest.raises(ValueError):
        M.schema_from_config(block)


def test_schema_block():
    assert M.schema_from_config(None) is M.DEFAULT_SCHEMA
    assert M.schema_from_config({"role_key": "from", "role_map": None}) == M.MessageSchema("from")


def test_replies(spark):
    texts = ["  a<|im_end|>", "a<|im_end|><|endoftext|>", "\x1c a \n", "<think>\n \n</think>\n\nhi", "<think>x</think>hi", "a<think></think>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", replies.clean_reply(F.col("t")).alias("c"), replies.visible_reply(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.c for r in got[:3]] == ["a", "a<|im_end|>", "a"]
    assert [r.v for r in got[3:]] == ["hi", "<think>x</think>hi", "a<think></think>"]
