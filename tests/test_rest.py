import math
import random
import uuid

import pytest
import yaml
from pyspark.sql import functions as F

from tessera import config as C
from tessera import pipeline
from tessera.functions.points import PointTokenizer
from tessera.functions.template import Adapter
from tessera.operators import events, history, ordering, packing, stats, transcripts
from tessera.sources import corpora
from tessera.streaming import streams

RECIPE = {
    "model": {"mesh": {"shape": [1, 1], "axis_names": ["a", "b"]}, "use_flash_attention": True},
    "tokenizer": {},
    "dataset": {"name": "parquet", "batch_size": 4, "max_length": 512, "max_examples": 60, "eval_fraction": 0.1, "packing": True, "require_reasoning_tags": False},
    "optimizer": {},
    "training": {"metrics_log_dir": "/tmp/x/logs"},
}


def recipe(tmp_path, *overrides):
    path = tmp_path / "r.yaml"
    path.write_text(yaml.safe_dump(RECIPE))
    return C.load(path, list(overrides))


def test_overrides(tmp_path):
    got = recipe(tmp_path, "dataset.max_length=128", "training.wandb.tags=[a, b]", "training.new.deep=x=y")
    assert got["dataset"]["max_length"] == 128 and got["training"]["wandb"]["tags"] == ["a", "b"] and got["training"]["new"]["deep"] == "x=y"


@pytest.mark.parametrize(
    "text",
    ["dataset.batch_size=0", "dataset.max_length=1", "model.mesh.shape=[]", "model.mesh.axis_names=[a]", "training.wandb.mode=x", "training.wandb.tags=a",
     "training.wandb=3", "dataset.overlength_policy=clip", "dataset.eval_fraction=1", "dataset.eval_max_examples=0", "training.transcripts.every_n_steps=0",
     "training.transcripts.prompts=[]", "dataset.message_schema={x: 1}", "training.gradient_accumulation_steps=0", "optimizer=3", "dataset..x=1", "noequals", "dataset.batch_size.x=1"],
)
def test_faults(tmp_path, text):
    with pytest.raises(ValueError):
        recipe(tmp_path, text)


def test_settings_and_steps(tmp_path):
    got = C.transcript_settings(recipe(tmp_path, "training.transcripts={cache_size: null, prompts: null}"))
    assert got["max_prompt_length"] == 1024 and got["cache_size"] == 1280 and len(got["prompts"]) == 3 and got["output_path"] == "/tmp/x/transcripts.jsonl"
    with pytest.raises(TypeError):
        C.transcript_settings(recipe(tmp_path, "training.transcripts={temperature: null}"))
    cfg = recipe(tmp_path, "dataset.num_train_epochs=3", "training.gradient_accumulation_steps=4")
    assert C.max_steps(cfg, 100) == 25 * 3 // 4 and C.max_steps(cfg, 1) == 1
    with pytest.raises(ValueError):
        C.max_steps(cfg, None)
    assert C.checkpoint_location("gs://b/c") == "gs://b/c" and C.checkpoint_location("x").startswith("/")


def test_load_from_recipe(spark, tmp_path):
    rows = [(i, [("user", "q" * (i % 7 + 1)), ("assistant", "a" * (i % 50 + 1))]) for i in range(80)]
    spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>").write.parquet(str(tmp_path / "d"))
    cfg = recipe(tmp_path, f"dataset.data_files={tmp_path}/d/*.parquet")
    built = pipeline.load(spark, cfg, key="id")
    sizes = {r["count"] for r in built.train.groupBy("batch_id").count().collect()}
    assert sizes == {4} and sum(r.n_segments for r in built.train.collect()) <= 54
    cfg["dataset"] |= {"packing": False, "num_train_epochs": 2}
    built = pipeline.load(spark, cfg, key="id")
    assert built.train.count() == 108 and built.eval.count() == 4


class Counting(PointTokenizer):
    """Pads with 99,999 and leaves a mark for each whole render."""

    def __init__(self, marks):
        super().__init__()
        self.marks = marks

    def pad_id(self):
        return 99_999

    def apply_chat_template(self, messages, *, tokenize=True, add_generation_prompt=False):
        if not add_generation_prompt and messages[0]["content"] != "probe":
            (self.marks / uuid.uuid4().hex).touch()
        return super().apply_chat_template(messages, add_generation_prompt=add_generation_prompt)


class Unpadded(PointTokenizer):
    def __init__(self):
        super().__init__()
        self.pad_token_id = self.eos_token_id = None


@pytest.mark.parametrize("pack", [False, True])
@pytest.mark.parametrize("epochs", [1, 3])
def test_rows_are_rendered_once_and_padded_by_the_tokenizer(spark, tmp_path, pack, epochs):
    (tmp_path / "marks").mkdir()
    rows = [(i, [("user", "q" * (i + 1)), ("assistant", "a" * (i + 1))]) for i in range(6)]
    spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>").write.parquet(str(tmp_path / "d"))
    cfg = recipe(tmp_path, f"dataset.data_files={tmp_path}/d/*.parquet", f"dataset.num_train_epochs={epochs}", f"dataset.packing={pack}", "dataset.eval_fraction=0", "dataset.batch_size=1", "dataset.max_length=64")
    marks = tmp_path / "marks"
    got = pipeline.load(spark, cfg, key="id", template=Adapter(lambda: Counting(marks))).train.collect()
    assert len(list(marks.iterdir())) == 6
    texts = [r.input_tokens for r in got]
    assert all(len(t) == 64 and t[-1] == 99_999 for t in texts) and not any(0 in t for t in texts)
    assert sum(t.count(ord("a")) - 0 for t in texts) > 0 and sum(t.count(ord("q")) for t in texts) == 21 * epochs
    if not pack:
        assert sorted(r.epoch for r in got) == sorted(list(range(epochs)) * 6)
    with pytest.raises(ValueError, match="padding"):
        pipeline.load(spark, cfg, key="id", template=Adapter(Unpadded))


def test_epochs_below_two_are_one(tmp_path):
    for value in (0, 1, -3, "null"):
        assert C.epochs(recipe(tmp_path, f"dataset.num_train_epochs={value}")) == 1
    assert C.max_steps(recipe(tmp_path, "dataset.num_train_epochs=0"), 100) == 1


@pytest.mark.parametrize("n", [1, 15, 20, 99, 100, 500])
def test_first_rows_with_tied_keys(spark, n):
    df = spark.range(100).select((F.col("id") % 10).alias("key"), "id", F.create_map(F.lit("k"), "id").alias("m")).repartition(5)
    got = ordering.first_n(df, n, "key").collect()
    assert len(got) == min(n, 100) and sorted(r.key for r in got) == sorted(i % 10 for i in range(100))[:n]
    assert sorted(r.id for r in ordering.first_n(df.repartition(3), n, "key").collect()) == sorted(r.id for r in got)


def test_probe_in_the_corpus_spelling(spark, tmp_path):
    cfg = recipe(tmp_path, "dataset.message_schema={role_key: from, content_key: value, role_map: {human: user, gpt: assistant}}", "dataset.messages_column=chat")
    row = pipeline.probe(spark, cfg).first()
    assert row.drop_reason is None and row.prompt_length < row.unpadded_length <= 256


def test_sources(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "c/train"))
    found = corpora.Catalog({"c": corpora.Corpus(str(tmp_path / "c"))}).scan(spark, "c")
    assert found.count() == 10 and corpora.shards(found) == 2 and corpora.ordered(found).select("order_key").distinct().count() == 10
    with pytest.raises(ValueError):
        corpora.Catalog({}).scan(spark, "c")
    assert corpora.matching(spark, [f"{tmp_path}/c/train/*.parquet", f"{tmp_path}/c/*.csv"]) == 2
    for name in ("1500", "1000", "not-a-step"):
        (tmp_path / "k" / name).mkdir(parents=True)
    assert corpora.checkpoint_steps(spark, str(tmp_path / "k")) == [1000, 1500] and corpora.checkpoint_steps(spark, str(tmp_path / "none")) == []
    assert corpora.resolve_step([1], None) is None and corpora.resolve_step([], 5) == 5
    with pytest.raises(ValueError):
        corpora.resolve_step([1, 2], 3)
    (tmp_path / "link").symlink_to(tmp_path / "c")
    above = [str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/k/..", f"{tmp_path}/link", f"file://{tmp_path}/k/../c", "/", "file:///", "~", f"{tmp_path}/../../../../../../root/.."]
    for name in above:
        with pytest.raises(ValueError):
            corpora.write_guarded(found, name, protected=[str(tmp_path / "c")], overwrite=True)
    corpora.write_guarded(found, str(tmp_path / "out"), protected=[str(tmp_path / "c")])
    with pytest.raises(Exception, match="(?i)exists"):
        corpora.write_guarded(found, str(tmp_path / "out"), protected=[])


def test_transcripts(spark, tmp_path):
    rows = [(500, "p", "<think>x</think>y", 32), (500, "p", "<think>x", 256), (1000, "p", "</think><think>", None), (1000, "p", "", 3)]
    df = transcripts.records(spark.createDataFrame(rows, "step int, prompt string, completion string, generated_tokens int"), max_new_tokens=256)
    got = df.collect()
    assert [r.reasoning_balanced for r in got] == [True, False, False, False] and [r.hit_token_cap for r in got] == [False, True, False, False]
    path = str(tmp_path / "t")
    transcripts.append_jsonl(df, path)
    transcripts.append_jsonl(df, path)
    back = transcripts.read_jsonl(spark, path)
    assert [tuple(r) for r in transcripts.by_step(back).collect()] == [(500, 2, 2, 4), (1000, 0, 0, 4)]
    assert transcripts.unclosed(back).count() == 4
    cases = [(500, 500, True), (0, 500, False), (750, 500, False), (5, 0, False), (1000, 500, True)]
    steps = spark.createDataFrame(cases, "s int, n int, want boolean").select("want", F.coalesce(transcripts.should_sample(F.col("s"), F.col("n")), F.lit(False)).alias("got"))
    assert all(r.want == r.got for r in steps.collect())
    text = spark.range(1).select(transcripts.render_prompt(F.lit("hi"), "S").alias("r")).first().r
    assert text == "<system>S</system><user>hi</user><assistant>"


def plain_fit(messages, budget):
    size = lambda ms: sum(2 * len(r) + 5 + len(c) for r, c in ms) + 11
    removed = 0
    while size(messages) > budget and len(messages) > 1:
        messages, removed = messages[2:], removed + len(messages[:2])
    return (messages if size(messages) <= budget else None), size(messages), removed


def test_history(spark):
    chats = [[("user", "a" * (i % 9)), ("assistant", "b" * i)] * (i % 4) + [("user", "c" * (i % 13))] * (i % 2) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(chats)), "id int, messages array<struct<role:string,content:string>>")
    for budget in (10, 40, 90, 200):
        for r in history.fit_history(df, budget).collect():
            fitted = None if r.fitted is None else [tuple(m) for m in r.fitted]
            assert (fitted, r.token_count, r.removed_turns) == plain_fit(chats[r.id], budget), (r.id, budget)


def test_events(spark):
    logs = spark.createDataFrame([(20, "/x/orbax/y.py"), (20, "/x/orbax_utils.py"), (30, "/x/orbax/y.py")], "level int, pathname string")
    assert [r.level_name for r in events.demoted(logs).collect()] == ["DEBUG", "INFO", "WARNING"]
    paths = ["embedder.input_embedding", "final_norm.w", "lm_head.w", "layers.3.attn.q_proj.w", "layers.12.attn.o_proj.w", "layers.0.mlp.down_proj.kernel", "layers.1.attn.k_norm.w", "layers.2.input_layernorm.w"]
    df = spark.createDataFrame([(p, 3) for p in paths], "path string, d int")
    assert [r.k for r in df.select(events.parameter_key(F.col("path"), F.col("d")).alias("k")).collect()] == [
        "model.embed_tokens.weight", "model.norm.weight", "lm_head.weight", "model.layers.3.self_attn.q_proj.weight", "model.layers.12.self_attn.o_proj.weight",
        "model.layers.0.mlp.down_proj.weight", "model.layers.1.self_attn.k_norm.weight", "model.layers.2.input_layernorm.weight",
    ]
    for bad in ("layers.0.unknown", "layers.3.attn.q_proj.w"):
        with pytest.raises(Exception, match="parameter|dimensions"):
            spark.createDataFrame([(bad, 2)], "path string, d int").select(events.parameter_key(F.col("path"), F.col("d"))).collect()
    rates = [r.rate for r in events.lr_schedule(spark, 100, 1.0, warmup_ratio=0.1).orderBy("step").collect()]
    assert rates[0] == 0 and rates[10] == 1 and rates[-1] > 0.1 and math.isclose(rates[55], 0.55)
    twos = spark.createDataFrame([(1, 1), (2, 2), (3, 4), (1024, 1024), (1025, 2048), (1 << 29, 1 << 29)], "b long, want long")
    assert all(r.want == r.got for r in twos.select("want", events.power_of_two(F.col("b")).alias("got")).collect())


def test_stats(spark):
    df = spark.range(1, 101).toDF("n")
    assert stats.percentiles(df, "n").first().p50 == 50.5
    assert [(r.kept, r.share) for r in stats.retention(df, "n", (10, 50)).orderBy("max_length").collect()] == [(10, 0.1), (50, 0.5)]


STREAMED = "shard int, example_id long, order_key long, length int"


def packed_stream(spark, tmp_path, batches, **options):
    """What a stream packs of rows that come in several files, one a batch."""
    for rows in batches:
        spark.createDataFrame(rows, STREAMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(STREAMED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    packed = streams.pack_stream(source, 8, **options)
    packed.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    got = spark.read.schema(packed.schema).parquet(str(tmp_path / "out")).orderBy("shard", "window_id", "segment").collect()
    return [(r.shard, r.example_id, r.window_id, r.segment, r.offset) for r in got]


def test_packing_stream(spark, tmp_path):
    rows = [(0, i, i, n) for i, n in enumerate([6, 5, 2, 8, 8])]
    assert packed_stream(spark, tmp_path, [rows], open_windows=2, idle_ms=None) == [(0, 0, 0, 1, 0), (0, 2, 0, 2, 6), (0, 3, 1, 1, 0)]


def test_packing_stream_over_batches_and_runs(spark, tmp_path):
    """Pools live on between batches and runs; a row without a length ends a shard, and its windows are those of a table."""
    rnd = random.Random(3)
    sizes = {s: [rnd.randint(1, 8) for _ in range(30)] for s in (0, 1)}
    rows = sorted((i, s, n) for s, ns in sizes.items() for i, n in enumerate(ns))
    rows = [(s, 1000 * s + i, i, n) for i, s, n in rows]
    parts = [rows[:13], rows[13:40], [*rows[40:], (0, None, None, None)]]
    first = packed_stream(spark, tmp_path, parts[:2], idle_ms=None)
    both = packed_stream(spark, tmp_path, parts[2:], idle_ms=None)
    assert set(first) <= set(both)
    want = {s: [(s, 1000 * s + i, w, g, o) for i, w, g, o in packing.fold(enumerate(ns), 8)] for s, ns in sizes.items()}
    assert [r for r in both if r[0] == 0] == sorted(want[0], key=lambda r: (r[2], r[3]))
    still_open = [r for r in want[1] if r not in both]
    assert set(r for r in both if r[0] == 1) <= set(want[1]) and 0 < len({r[2] for r in still_open}) <= 8


def test_replayed_batches_add_no_row(spark, tmp_path):
    """A batch whose commit was lost runs again under its number."""
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = streams.BatchFolders(str(tmp_path / "out"))

    def run():
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(90)
        return sorted(r.id for r in sink.read(spark, "id long").collect())

    assert run() == list(range(30))
    for name in ("2", ".2.crc"):
        (tmp_path / "ck/commits" / name).unlink()
    before = {p.name for p in (tmp_path / "out/batch-000000000002").iterdir()}
    assert run() == list(range(30))
    assert {p.name for p in (tmp_path / "out/batch-000000000002").iterdir()} != before
    said = spark.createDataFrame([(1, "p", "c", 1)], "step int, prompt string, completion string, generated_tokens int")
    for batch in (7, 7, None, None):
        transcripts.append_jsonl(transcripts.records(said, max_new_tokens=2), str(tmp_path / "t"), batch)
    assert transcripts.read_jsonl(spark, str(tmp_path / "t")).count() == 3
    streams.fan_out(spark.range(2), [streams.BatchFolders(str(tmp_path / "fan"))], 4)
    assert (tmp_path / "fan/batch-000000000004").is_dir()


def test_first_rows_of_files(spark, tmp_path):
    spark.range(0, 100, 1, 5).write.parquet(str(tmp_path / "f"))
    scan = corpora.scan_glob(spark, str(tmp_path / "f/*.parquet"))
    order = [r.id for r in corpora.ordered(scan).orderBy("order_key").collect()]
    for n in (0, 1, 20, 33, 100, 500):
        got = corpora.first_rows(scan, n)
        assert sorted(r.id for r in got.collect()) == sorted(order[:n])
        assert len(got.inputFiles()) == min(5, -(-n // 20))


def test_replacement_is_whole_or_none(spark, tmp_path):
    path = str(tmp_path / "t")
    corpora.write_guarded(spark.range(3), path, protected=[], overwrite=True)
    corpora.write_guarded(spark.range(5), path, protected=[], overwrite=True)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="(?i)broken"):
        corpora.write_guarded(spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")), path, protected=[], overwrite=True)
    with pytest.raises(ValueError, match="read by"):
        corpora.write_guarded(spark.read.parquet(path).limit(1), path, protected=[], overwrite=True)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_kept_sketches(spark):
    """Sketches of shards, merged, beside exact ranks."""
    n = 20_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("x"), (F.col("id") % 7).alias("shard"))
    kept = stats.sketches(df, "x", "shard")
    assert sum(r.n for r in kept.collect()) == n
    got = stats.sketched_percentiles(kept).first()
    for name, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99)):
        assert abs(got[name] / n - p) <= 2 * stats.SKETCH_ERROR


def test_interval_sampler(spark):
    seen = []
    sampler = streams.IntervalSampler(10, lambda df, i: seen.append(df.count()))
    sampler(spark.range(31).toDF("step"), 0)
    assert seen == [3]
    broken = streams.IntervalSampler(10, lambda df, i: 1 / 0)
    broken(spark.range(31).toDF("step"), 0)
    assert not broken.enabled
    broken(spark.range(31).toDF("step"), 1)


def test_fan_out(spark):
    got = []
    streams.fan_out(spark.range(3), [lambda d: got.append(d.count()), lambda d: got.append(d.count())])
    assert got == [3, 3]


def test_sinks_of_a_recipe(spark, tmp_path):
    off = recipe(tmp_path)
    assert C.wandb_arguments(off) == {"mode": "disabled"} and [k for k, _ in C.metric_sinks(off)] == ["tensorboard"]
    on = recipe(tmp_path, "training.wandb={enabled: true, tags: [a], notes: null, other: 3}", "training.project_name=p")
    (_, files), (_, run) = C.metric_sinks(on)
    assert files == {"log_dir": "/tmp/x/logs", "flush_every_n_steps": 20}
    assert run == {"project": "p", "name": "sft", "mode": "online", "save_code": True, "tags": ["a"], "dir": "/tmp/x/logs", "config": on}
    got = {"tensorboard": [], "wandb": []}
    keeping = lambda kind: lambda options: lambda batch: got[kind].extend(r.event for r in batch.collect())
    df = spark.createDataFrame([("train/loss", 1), ("jax/x", 1), ("eval/loss", None)], "event string, step long")
    streams.fan_out(df, streams.sinks(on, {k: keeping(k) for k in got}))
    assert sorted(got["tensorboard"]) == ["eval/loss", "jax/x", "train/loss"] and got["wandb"] == ["train/loss"]


def test_sampling_batch(spark):
    said = F.udf(lambda text: (text[-14:] + "<think>a</think>b", 4), "text string, n_tokens int")
    df = spark.createDataFrame([(3, "hi", "<user>hi</user><assistant>")], "step int, prompt string, rendered string")
    row = transcripts.sample(df, said, max_new_tokens=4).first()
    assert (row.step, row.prompt, row.completion_chars, row.reasoning_balanced, row.hit_token_cap) == (3, "hi", 31, True, True)


def test_prompts(spark):
    df = spark.createDataFrame([("", 0), ("abc", 3), ("abcd", 4), (None, 0)], "p string, n int")
    assert [r.why for r in df.select(history.prompt_rejection(F.col("p"), F.col("n"), 3).alias("why")).collect()] == ["empty_prompt", None, "prompt_too_long", "empty_prompt"]


def test_stop_ids():
    from tessera.functions.template import stop_ids

    class Vocabulary:
        eos_token_id, unk_token_id = 7, 0

        def convert_tokens_to_ids(self, mark):
            return {"<|im_end|>": 5}.get(mark, 0)

    assert stop_ids(Vocabulary()) == [5, 7]
    with pytest.raises(ValueError):
        stop_ids(object())


def test_zip_strict(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"])], "x array<int>, y array<string>")
    assert [tuple(r.zipped) for r in transcripts.zip_strict(df, "x", "y").collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="differ in size"):
        transcripts.zip_strict(df.withColumn("y", F.array(F.lit("a"))), "x", "y").collect()


def test_doctor(spark, tmp_path):
    from tessera.__main__ import doctor

    good = recipe(tmp_path)
    assert doctor(spark, good) == []
    assert "rejected" in doctor(spark, recipe(tmp_path, "dataset.system_prompt=" + "x" * 300))[0]
    more = ["dataset.system_prompt=" + "x" * 300, f"dataset.data_files={tmp_path}/none/*.parquet", "training={wandb: {enabled: true}}"]
    assert len(doctor(spark, recipe(tmp_path, *more))) == 3


def test_command_line(spark, tmp_path):
    from tessera.__main__ import main

    for bad in (["doctor", str(tmp_path / "none.yaml")], ["build", str(tmp_path / "r.yaml"), "--shards", "0", "--out", "x"]):
        with pytest.raises(SystemExit):
            main(bad)
