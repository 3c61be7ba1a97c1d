"""Byte pairs by joins against a library that reads the same rank file."""

import base64
import random

import pytest
import tiktoken
import yaml
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera import config as C
from tessera import pipeline
from tessera.functions import messages as M
from tessera.functions.template import Adapter
from tessera.operators import bpe
from tessera.operators import encode as E

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MARKS = {"<|endoftext|>": 50256, "<|im_start|>": 50257, "<|im_end|>": 50258}
SF = "/root/testdata/sf0.001"


def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


class LibraryChat:
    """The same chat layout, rendered by the library."""

    def __init__(self):
        self.encoding = library()

    def pad_id(self):
        return MARKS["<|endoftext|>"]

    def apply_chat_template(self, messages, *, tokenize=True, add_generation_prompt=False):
        plain, out = self.encoding.encode_ordinary, []
        for m in messages:
            out += [MARKS["<|im_start|>"], *plain(f"{m['role']}\n{m['content']}"), MARKS["<|im_end|>"], *plain("\n")]
        return out + ([MARKS["<|im_start|>"], *plain("assistant\n")] if add_generation_prompt else [])


def odd_texts():
    rnd = random.Random(8)
    some = ["", " ", "\n\n\n", "it's 12 don't", "  two  blanks ", "日本語のテキスト", "naïve café x y", "a" * 300, "ab" * 90, "🎉🎉 ok", "x\ty\r\n z", "<|im_end|>", "\u0085q", "ﬁ１２ ²"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    some += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 150))) for _ in range(30)]
    return some + [" ".join("".join(rnd.choice(letters + "éß0 '-") for _ in range(rnd.randint(1, 12))) for _ in range(20)) for _ in range(20)]


def test_ids_are_the_librarys(spark):
    encoding = library()
    said = [r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    texts = list(enumerate([*odd_texts(), *said]))
    df = spark.createDataFrame([*texts, (len(texts), None)], "k long, text string").repartition(3)
    got = {r.k: r.ids for r in bpe.tokenize(df, "text", ["k"], bpe.Vocabulary(RANKS)).collect()}
    assert got == {**{k: encoding.encode_ordinary(t) for k, t in texts}, len(texts): []}


def test_one_piece():
    encoding, rnd = library(), random.Random(2)
    ranks = encoding._mergeable_ranks
    for text in [*odd_texts(), *("".join(rnd.choice("aab") for _ in range(40)) for _ in range(40))]:
        if text:
            assert bpe.merged(text.encode(), ranks) == encoding._encode_single_piece(text.encode())
    assert bpe.merged(b"", ranks) == []


def test_a_vocabulary_without_all_bytes(spark, tmp_path):
    (tmp_path / "v").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="no token for the byte 0"):
        bpe.encode_pieces(spark.createDataFrame([("a",)], "piece string"), bpe.Vocabulary(str(tmp_path / "v")))


@pytest.mark.parametrize("options", [{}, {"assistant_only_loss": False}, {"overlength_policy": "truncate"}])
def test_chat_is_the_librarys(spark, options):
    """The same rows, reasons and spans as an adapter around the library, contents that begin with line ends included."""
    chats = M.nested(spark.read.parquet(f"{SF}/conversations.parquet"))
    odd = [[("user", t), ("assistant", u)] for t, u in zip(odd_texts(), reversed(odd_texts()), strict=True)]
    odd += [[("assistant", "first"), ("user", "x"), ("assistant", "y")], [("user", "x"), ("assistant", "\n\nlate")], [("user", "x"), ("assistant", "\nmiddle"), ("user", "z"), ("assistant", "ok")]]
    more = spark.createDataFrame([(10_000 + i, m) for i, m in enumerate(odd)], "conv_id long, messages array<struct<role:string,content:string>>")
    df = chats.select("conv_id", "messages").unionByName(more)
    shared = {"max_length": 400, "require_reasoning_tags": False, **options}
    chat = bpe.Chat(bpe.Vocabulary(RANKS), MARKS)
    rows = []
    for template in (chat, Adapter(LibraryChat)):
        got = E.encode(df, E.EncodeConfig(**shared, template=template)).select("conv_id", "drop_reason", "prompt_length", "unpadded_length", "full_length", "input_ids", "spans")
        rows.append(sorted(got.collect()))
    assert rows[0] == rows[1]
    assert {r.drop_reason for r in rows[0]} >= ({"prefix_unstable", None} | ({"assistant_first"} if not options.get("assistant_only_loss") is False else set()))


def test_recipe_and_command_line(spark, tmp_path, capsys):
    rows = [(i, [("user", f"question {i}"), ("assistant", f"answer {i} " * (i % 5 + 1))]) for i in range(20)]
    spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>").write.parquet(str(tmp_path / "d"))
    recipe = {
        "model": {"mesh": {"shape": [1], "axis_names": ["a"]}}, "tokenizer": {"ranks": RANKS, "special_tokens": MARKS}, "optimizer": {}, "training": {},
        "dataset": {"name": "parquet", "data_files": f"{tmp_path}/d/*.parquet", "batch_size": 2, "max_length": 64, "require_reasoning_tags": False},
    }
    (tmp_path / "r.yaml").write_text(yaml.safe_dump(recipe))
    assert cli.main(["build", str(tmp_path / "r.yaml"), "--out", str(tmp_path / "out")]) == 0
    out = spark.read.parquet(str(tmp_path / "out/train")).collect()
    tokenizer = LibraryChat()
    assert len(out) == 20
    for r in out:
        ids = tokenizer.apply_chat_template([{"role": a, "content": b} for a, b in rows[r.id][1]])
        assert r.input_tokens == ids + [50256] * (64 - len(ids))
    packed = pipeline.load(spark, C.read(yaml.safe_dump(recipe), ["dataset.packing=true"]), key="id").train
    assert packed.agg(F.max(F.element_at("input_tokens", -1))).first()[0] == 50256
    with pytest.raises(ValueError, match="im_end"):
        pipeline.load(spark, C.read(yaml.safe_dump(recipe), ["tokenizer.special_tokens={<|im_start|>: 1}"]), key="id")
    with pytest.raises(ValueError, match="padding"):
        pipeline.load(spark, C.read(yaml.safe_dump(recipe), ["tokenizer.pad=none"]), key="id")
