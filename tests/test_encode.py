import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions import template as T
from tessera.operators import encode as E

CHAT = "array<struct<role:string,content:string>>"
ONE = [("user", "Name a prime"), ("assistant", "<think>any will do</think>Seven")]
TWO = [("user", "Good day"), ("assistant", "<think>be kind</think>Welcome"), ("user", "Name a river"), ("assistant", "<think>a long one</think>The Nile")]


class Tagged:
    """The native template as a tokeniser: a batch of one, an id for each code point."""

    pad_token_id = 0

    def apply_chat_template(self, messages, *, tokenize=True, add_generation_prompt=False):
        parts = ["<{role}>{content}</{role}>".format(**m) for m in messages]
        if add_generation_prompt:
            parts.append("<assistant>")
        return {"input_ids": [list(map(ord, "".join(parts)))]}


class Padded(Tagged):
    """Asks for a reply with an id more than the reply then follows."""

    def apply_chat_template(self, messages, *, tokenize=True, add_generation_prompt=False):
        ids = super().apply_chat_template(messages, add_generation_prompt=add_generation_prompt)["input_ids"][0]
        return [*ids, 7] if add_generation_prompt else ids


class Faulty(Tagged):
    """Renders fail in several ways, by the first content."""

    def apply_chat_template(self, messages, *, tokenize=True, add_generation_prompt=False):
        first = messages[0]["content"] if messages else ""
        if first == "raise":
            raise ValueError("no")
        if first == "bare":
            return {"attention_mask": [[1]]}
        if first == "one":
            return [5]
        return super().apply_chat_template(messages, add_generation_prompt=add_generation_prompt)


class Endless(Tagged):
    """Assistant turns have no common end."""

    def apply_chat_template(self, messages, *, tokenize=True, add_generation_prompt=False):
        text = "".join(f"<{m['role']}>{m['content']}" for m in messages) + "<assistant>" * add_generation_prompt
        return [ord(c) for c in text]


class Shifting(Tagged):
    """Earlier assistant turns lose their end once others follow."""

    def apply_chat_template(self, messages, *, tokenize=True, add_generation_prompt=False):
        inner = "".join(f"<{m['role']}>{m['content']}" + "</user>" * (m["role"] == "user") for m in messages[:-1])
        last = "".join("<{role}>{content}</{role}>".format(**m) for m in messages[-1:])
        return [ord(c) for c in inner + last + "<assistant>" * add_generation_prompt]


class Named(Tagged):
    """Reads its own template: the text in front of every conversation."""

    chat_template = ""

    def apply_chat_template(self, messages, *, tokenize=True, add_generation_prompt=False):
        ids = super().apply_chat_template(messages, add_generation_prompt=add_generation_prompt)["input_ids"][0]
        return [ord(c) for c in self.chat_template] + ids


def chats(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, messages {CHAT}")


def encoded(spark, values, **more):
    cfg = E.EncodeConfig(**{"max_length": 4096} | more)
    return E.encode(chats(spark, *values), cfg).orderBy("id").collect()


def test_golden_spans(spark):
    row = encoded(spark, [TWO])[0]
    text = "".join(f"<{r}>{c}</{r}>" for r, c in TWO)
    start = len("<user>Good day</user><assistant>")
    end = start + len("<think>be kind</think>Welcome</assistant>")
    assert [tuple(s) for s in row.spans][0] == (start, end)
    assert row.spans[1].end == len(text) == row.unpadded_length and row.prompt_length == row.spans[1].start
    assert row.input_ids == [ord(c) for c in text]


@pytest.mark.parametrize("template", [T.CODE_POINTS, T.Adapter(Tagged)])
def test_both_paths_agree(spark, template):
    values = [ONE, TWO, [("assistant", "<think></think>x")], [("user", "x")], [("user", "é😀"), ("assistant", "<think></think>𝄞")]]
    for more in ({}, {"assistant_only_loss": False}, {"max_length": 60}, {"max_length": 60, "overlength_policy": "truncate"}, {"system_prompt": "S"}):
        want = encoded(spark, values, **more)
        got = encoded(spark, values, template=template, **more)
        keys = ("drop_reason", "spans", "prompt_length", "unpadded_length", "input_ids")
        assert [[r[k] for k in keys] for r in got] == [[r[k] for k in keys] for r in want]


def test_reasons(spark):
    values = [[("assistant", "<think></think>x")], [("user", "q"), ("assistant", "plain")], ONE, None]
    assert [r.drop_reason for r in encoded(spark, values, max_length=20)] == ["overlength", "missing_reasoning_tags", "overlength", "not_a_sequence"]
    assert encoded(spark, values[:1])[0].drop_reason == "assistant_first"
    assert encoded(spark, values[:1], system_prompt="S")[0].drop_reason is None
    assert encoded(spark, values[:1], assistant_only_loss=False)[0].drop_reason is None


def test_truncation(spark):
    prompt = len("<user>Name a prime</user><assistant>")
    for only in (True, False):
        more = {"overlength_policy": "truncate", "assistant_only_loss": only}
        assert encoded(spark, [ONE], max_length=prompt, **more)[0].drop_reason == "prompt_fills_window"
        kept = encoded(spark, [ONE], max_length=prompt + 1, **more)[0]
        assert kept.drop_reason is None and kept.unpadded_length == prompt + 1 and kept.prompt_length == prompt
    first = len("<user>Good day</user><assistant>")
    cut = encoded(spark, [TWO], max_length=first + 4, overlength_policy="truncate")[0]
    assert cut.prompt_length == first + 4 and [tuple(s) for s in cut.spans] == [(first, first + 4)]


def test_equality_with_the_limit_is_kept(spark):
    n = encoded(spark, [ONE])[0].unpadded_length
    assert encoded(spark, [ONE], max_length=n)[0].drop_reason is None
    assert encoded(spark, [ONE], max_length=n - 1)[0].drop_reason == "overlength"


def test_closing_inside_content_ends_the_span(spark):
    value = [("user", "q"), ("assistant", "a</assistant>b"), ("user", "r"), ("assistant", "<think></think>")]
    start = len("<user>q</user><assistant>")
    for template in (T.CODE_POINTS, T.Adapter(Tagged)):
        assert tuple(encoded(spark, [value], template=template)[0].spans[0]) == (start, start + len("a</assistant>"))


def test_unstable_template(spark):
    got = encoded(spark, [ONE], template=T.Adapter(Padded))[0]
    assert got.drop_reason == "prefix_unstable"


def test_renders_that_fail(spark):
    more = [("assistant", "<think></think>x")]
    values = [[("user", w), *more] for w in ("raise", "bare", "one", "fine")]
    got = [r.drop_reason for r in encoded(spark, values, template=T.Adapter(Faulty))]
    assert got == ["render_error", "render_error", "too_short", None]


def test_closings(spark):
    assert encoded(spark, [ONE], template=T.Adapter(Endless))[0].drop_reason == "no_closing"
    assert encoded(spark, [TWO], template=T.Adapter(Shifting))[0].drop_reason in ("no_closing", "prefix_unstable")
    ids = [1, 2, 9, 3, 4, 5]
    turns = [{"role": r} for r in ("user", "assistant", "user", "assistant")]
    assert T.spans_of(turns, ids, {1: 1, 3: 4}, [9]) == ([(1, 3), (4, 6)], None)
    assert T.spans_of(turns, ids, {1: 1, 3: 4}, [8]) == ([], "no_closing")
    assert T.spans_of(turns, ids, {1: 1, 3: 2}, [9]) == ([], "prefix_unstable")
    assert T.spans_of(turns, ids, {1: None, 3: 4}, [9]) == ([], "prefix_unstable")


def test_full_loss_needs_no_spans(spark):
    for template in (Endless, Shifting):
        got = encoded(spark, [ONE], template=T.Adapter(template), assistant_only_loss=False)[0]
        assert got.drop_reason is None and [tuple(s) for s in got.spans] == [(0, got.unpadded_length)]
    assert encoded(spark, [ONE], template=T.Adapter(Padded), assistant_only_loss=False)[0].drop_reason == "prefix_unstable"


def test_template_of_the_recipe(spark):
    from tessera import pipeline

    recipe = {"tokenizer": {"chat_template": "!!"}, "dataset": {}}
    template = pipeline.with_recipe(T.Adapter(Named), recipe)
    plain, named = encoded(spark, [ONE], template=T.Adapter(Named))[0], encoded(spark, [ONE], template=template)[0]
    assert named.input_ids == [33, 33, *plain.input_ids] and named.prompt_length == plain.prompt_length + 2
    with pytest.raises(ValueError):
        pipeline.with_recipe(T.CODE_POINTS, recipe)


def test_unknown_policy():
    with pytest.raises(ValueError):
        E.EncodeConfig(10, overlength_policy="clip")


def test_dense(spark):
    cfg = E.EncodeConfig(100)
    row = E.dense(E.encode(chats(spark, ONE), cfg), cfg).first()
    assert len(row.input_tokens) == len(row.input_mask) == 100
    assert [i for i, m in enumerate(row.input_mask) if m] == list(range(row.prompt_length, row.unpadded_length))
    assert set(row.input_tokens[row.unpadded_length :]) == {0}


def test_ids():
    assert T.as_ids({"input_ids": [[1, 2]]}) == [1, 2]
    for bad in ([[1], [2]], "x", [1.5], 3, {"attention_mask": [1]}):
        with pytest.raises(TypeError):
            T.as_ids(bad)
    assert T.special_id(Tagged()) == 0
    with pytest.raises(ValueError):
        T.special_id(object())
    assert T.closing_ids(Tagged()) == [ord(c) for c in "</assistant>"]
    assert T.find([1, 2, 1, 2], [1, 2], 1) == 2 and T.find([1], [2]) is None


turn = st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text("ab<>/é😀", max_size=6))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.lists(turn, max_size=5), min_size=1, max_size=12), limit=st.integers(2, 120))
def test_both_paths_agree_on_any_chat(spark, values, limit):
    more = {"max_length": limit, "overlength_policy": "truncate", "require_reasoning_tags": False}
    keys = ("drop_reason", "spans", "prompt_length", "unpadded_length", "input_ids")
    want = encoded(spark, values, template=T.Adapter(Tagged), **more)
    assert [[r[k] for k in keys] for r in encoded(spark, values, **more)] == [[r[k] for k in keys] for r in want]


def test_find_is_a_search_of_whole_ids():
    rnd = random.Random(5)
    for _ in range(300):
        ids = [rnd.choice([0, 1, 256, 65536, 1 << 24, 257]) for _ in range(rnd.randint(0, 30))]
        part = [rnd.choice([0, 1, 256, 65536, 1 << 24, 257]) for _ in range(rnd.randint(1, 3))]
        start = rnd.randint(0, 32)
        plain = next((i for i in range(start, len(ids) - len(part) + 1) if ids[i : i + len(part)] == part), None)
        assert T.find(ids, part, start) == plain
