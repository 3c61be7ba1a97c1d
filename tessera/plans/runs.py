"""Registered queries that run whole recipes, tokenisers, sources and sinks, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config, pipeline
from tessera.functions import template as T
from tessera.functions.points import PointTokenizer
from tessera.operators import encode as E
from tessera.operators import bpe, ordering, packing, transcripts
from tessera.plans import catalog as C
from tessera.sources import corpora, workspace
from tessera.streaming import streams

_queries: dict[str, C.Query] = {}
_oracle: dict[str, str] = {}


def query(sql: str) -> Callable[[C.Query], C.Query]:
    def add(f: C.Query) -> C.Query:
        _queries[f.__name__], _oracle[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, C.Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


class FailingTokenizer(PointTokenizer):
    """Whole renders fail by the length of the last content: an error, no ids, one id, or none of these."""

    def apply_chat_template(self, messages: list[dict[str, str]], *, tokenize: bool = True, add_generation_prompt: bool = False) -> Any:
        kind = 1 if add_generation_prompt else len(messages[-1]["content"]) % 4
        if kind == 0:
            raise ValueError("not renderable")
        if kind == 2:
            return {"attention_mask": [[1]]}
        return [7] if kind == 3 else super().apply_chat_template(messages, add_generation_prompt=add_generation_prompt)


class PaddingTokenizer(PointTokenizer):
    """What asks for a reply is not how the conversation goes on."""

    def text(self, messages: list[dict[str, str]], generate: bool) -> str:
        return super().text(messages, generate) + ("~" if generate else "")


class EndlessTokenizer(PointTokenizer):
    """Assistant turns have no common end."""

    def text(self, messages: list[dict[str, str]], generate: bool) -> str:
        return "".join(m["content"] for m in messages) + ("?" if generate else "")


def _adapted(limit: int, make: Callable[[], Any] = PointTokenizer, **more: Any) -> E.EncodeConfig:
    return E.EncodeConfig(limit, require_reasoning_tags=False, template=T.Adapter(make), **more)


@query(C.oracle_sql()["span_list"])
def adapter_spans(spark: SparkSession, sf: str) -> DataFrame:
    df = E.kept(E.encode(C._nested(spark, sf), _adapted(1 << 30)))
    return df.select("conv_id", F.posexplode("spans").alias("span", "s")).select("conv_id", F.col("span").cast("long").alias("span"), F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


@query(C.oracle_sql()["encode_drop"])
def adapter_drop(spark: SparkSession, sf: str) -> DataFrame:
    return C._encoded(C._nested(spark, sf), _adapted(2048))


@query(C.oracle_sql()["encode_truncate"])
def adapter_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return C._encoded(C._nested(spark, sf), _adapted(1024, overlength_policy="truncate"))


@query(C.oracle_sql()["encode_full_loss"])
def adapter_full_loss(spark: SparkSession, sf: str) -> DataFrame:
    return C._encoded(C._nested(spark, sf), _adapted(1500, overlength_policy="truncate", assistant_only_loss=False))


@query(f"""WITH {C.TURNS} SELECT conv_id, CASE WHEN last_role <> 'assistant' THEN 'last_not_assistant' WHEN length(last_text) % 4 IN (0, 2) THEN 'render_error'
  WHEN length(last_text) % 4 = 3 THEN 'too_short' WHEN first_role = 'assistant' THEN 'assistant_first' ELSE 'kept' END AS reason FROM e""")
def adapter_faults(spark: SparkSession, sf: str) -> DataFrame:
    return E.encode(C._nested(spark, sf), _adapted(1 << 30, FailingTokenizer)).select("conv_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason"))


@query(f"""WITH {C.TURNS} SELECT conv_id, 'padding' AS template, CASE WHEN last_role <> 'assistant' THEN 'last_not_assistant' WHEN first_role = 'assistant' THEN 'assistant_first' ELSE 'prefix_unstable' END AS reason FROM e
  UNION ALL SELECT conv_id, 'endless' AS template, CASE WHEN last_role <> 'assistant' THEN 'last_not_assistant' ELSE 'no_closing' END AS reason FROM e
  UNION ALL SELECT conv_id, 'full loss' AS template, CASE WHEN last_role <> 'assistant' THEN 'last_not_assistant' ELSE 'prefix_unstable' END AS reason FROM e""")
def adapter_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Templates whose renders do not go on from one another, with and without spans."""
    df = C._nested(spark, sf)
    cases = {"padding": _adapted(1 << 30, PaddingTokenizer), "endless": _adapted(1 << 30, EndlessTokenizer), "full loss": _adapted(1 << 30, PaddingTokenizer, assistant_only_loss=False)}
    out = [E.encode(df, cfg).select("conv_id", F.lit(name).alias("template"), F.coalesce("drop_reason", F.lit("kept")).alias("reason")) for name, cfg in cases.items()]
    return out[0].union(out[1]).union(out[2])


class SentenceTokenizer(PointTokenizer):
    """Marks that end a turn are the ends of sentences and lines."""

    def __init__(self) -> None:
        super().__init__()
        self.eos_token_id = ord("\n")

    def convert_tokens_to_ids(self, mark: str) -> int:
        return ord(".?"[T.STOP_MARKS.index(mark)])


@query(r"""SELECT conv_id, turn, CAST(CASE WHEN regexp_matches(text, '[.?\n]') THEN length(regexp_extract(text, '^[^.?\n]*')) ELSE length(text) END AS BIGINT) AS kept,
  coalesce(unicode(regexp_extract(text, '[.?\n]')), 0) AS stop FROM conversations WHERE text IS NOT NULL AND text <> ''""")
def special_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Where a reply ends by the ids that a tokeniser's marks and end give, and which of them ends it."""
    turns = C._table(spark, sf, "conversations").where("text != ''").withColumn("ids", T.code_points(F.col("text")))
    cut = T.until_stop(F.col("ids"), T.stop_ids(SentenceTokenizer()))
    return turns.select("conv_id", "turn", F.size(cut).cast("long").alias("kept"), F.coalesce(F.get("ids", F.size(cut)), F.lit(0)).alias("stop"))


RECIPE = """
model: {mesh: {shape: [1], axis_names: [data]}, use_flash_attention: true}
tokenizer: {}
dataset: {name: parquet, batch_size: 8, max_length: 2048, eval_fraction: 0.1, require_reasoning_tags: false}
optimizer: {}
training: {metrics_log_dir: /runs/logs, gradient_accumulation_steps: 4}
"""


def _built(spark: SparkSession, sf: str, *overrides: str, template: T.Template = T.CODE_POINTS) -> pipeline.Built:
    path = workspace.folder(spark, "corpus")
    C._nested(spark, sf).write.parquet(path)
    recipe = config.read(RECIPE, [f"dataset.data_files={path}/*.parquet", "dataset.batch_size=4", f"dataset.seed={C.SEED}", *overrides])
    return pipeline.load(spark, recipe, key="conv_id", template=template)


_KEPT = f"k AS ({C._encoded_sql(2048, 'drop', False)})"


@query(f"""WITH {C._DRAWN}, {_KEPT}, o AS (
  SELECT k.conv_id, e.epoch, CAST(('0x' || substr(md5('{C.SEED}:' || e.epoch || ':' || k.conv_id), 1, 8)) AS BIGINT) AS shuffle
  FROM k JOIN r ON r.conv_id = k.conv_id AND r.place >= ceil(r.total * 0.1) CROSS JOIN (SELECT 0 AS epoch UNION ALL SELECT 1) e
), p AS (SELECT conv_id, epoch, row_number() OVER (ORDER BY epoch, shuffle, conv_id) - 1 AS place, count(*) OVER () AS total FROM o)
SELECT conv_id, CAST(epoch AS BIGINT) AS epoch, CAST(floor(place / 4) AS BIGINT) AS batch_id FROM p WHERE place < floor(total / 4) * 4""")
def recipe_train(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe's training half: scan, split, shuffle of each epoch, encoding, batches."""
    return _built(spark, sf, "dataset.num_train_epochs=2").train.select("conv_id", *C._long("epoch", "batch_id"))


@query(f"""WITH {C._DRAWN}, {_KEPT}, p AS (
  SELECT k.conv_id, row_number() OVER (ORDER BY k.conv_id) - 1 AS place, count(*) OVER () AS total FROM k JOIN r ON r.conv_id = k.conv_id AND r.place < ceil(r.total * 0.1)
) SELECT conv_id, CAST(floor(place / 4) AS BIGINT) AS batch_id FROM p WHERE place < floor(total / 4) * 4""")
def recipe_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Its evaluation half: one epoch in the order of the corpus."""
    return _built(spark, sf, "dataset.num_train_epochs=2").eval.select("conv_id", *C._long("batch_id"))


_SHUFFLED = f"CAST(('0x' || substr(md5('{C.SEED}:0:' || conv_id), 1, 8)) AS BIGINT), conv_id"


@query(f"""{C._placed_sql(8, limit=2048, window=2048, order=_SHUFFLED)}, b AS (SELECT window_id, count(*) AS n, sum(length) AS tokens FROM placed GROUP BY window_id)
SELECT window_id, CAST(floor(window_id / 4) AS BIGINT) AS batch_id, n AS segments, CAST(tokens AS BIGINT) AS tokens, CAST((2048 - tokens) * 7 AS BIGINT) AS padding FROM b WHERE window_id < (SELECT floor(count(*) / 4) * 4 FROM b)""")
def recipe_packed(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe with ``packing``, padded with its tokeniser's own id: 7, which no text has."""
    template = T.Adapter(lambda: PointTokenizer(T.Additive(pad_id=7)))
    windows = _built(spark, sf, "dataset.packing=true", "dataset.eval_fraction=0", template=template).train
    used = F.size(F.filter("segment_ids", lambda s: s > 0))
    padding = F.aggregate(F.filter("input_tokens", lambda t: t == 7), F.lit(0).cast("long"), lambda n, t: n + t)
    return windows.select("window_id", "batch_id", F.col("n_segments").cast("long").alias("segments"), used.cast("long").alias("tokens"), padding.alias("padding"))


@query(f"""{C._placed_sql(8)}, b AS (SELECT window_id, count(*) AS n FROM placed GROUP BY window_id)
SELECT CAST(floor(window_id / 4) AS BIGINT) AS batch_id, CAST(floor(window_id / 4) % 3 AS BIGINT) AS "rank", count(*) AS windows, CAST(sum(n) AS BIGINT) AS examples FROM b WHERE window_id < (SELECT floor(count(*) / 4) * 4 FROM b) GROUP BY ALL""")
def batch_reader(spark: SparkSession, sf: str) -> DataFrame:
    """Batches as three trainers read them side by side; a second pass, and one from the second batch on, give the same arrays."""
    path = workspace.folder(spark, "ranks")
    packing.write_ranks(packing.batches(C._windows(spark, sf), 4), path, 3, file_batches=4)

    def read(ranks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rank in (int(r) for frame in ranks for r in frame["id"]):
            again, later = iter(packing.RankReader(path, rank)), iter(packing.RankReader(path, rank, 1))
            for k, batch in enumerate(packing.RankReader(path, rank)):
                others = [next(again), *([next(later)] if k else [])]
                if all((batch[f] == other[f]).all() for f in batch for other in others):
                    segments = batch["segment_ids"].max(axis=1)
                    yield pd.DataFrame({"batch_id": [3 * k + rank], "rank": [rank], "windows": [len(segments)], "examples": [int(segments.sum())]})

    return spark.range(0, 3, 1, 3).mapInPandas(read, "batch_id long, rank long, windows long, examples long")


# Settings that parts ask for, by their keys and sizes.
_ASKED_SQL = """SELECT p_partkey, p_size, CASE p_partkey % 6
  WHEN 0 THEN 'dataset.batch_size=' || (p_size - 5) WHEN 1 THEN 'dataset.max_length=' || (p_size - 5) WHEN 2 THEN 'dataset.num_train_epochs=' || (p_size - 5)
  WHEN 3 THEN 'dataset.eval_fraction=' || (p_size / 40.0) WHEN 4 THEN 'dataset.message_schema={z' || p_size || ': 1, a' || p_size || ': 2}' ELSE 'training.max_steps=' || p_size END AS setting FROM part"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    less, k = (F.col("p_size") - 5).cast("string"), F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    setting = (
        F.when(k == 0, F.concat(F.lit("dataset.batch_size="), less)).when(k == 1, F.concat(F.lit("dataset.max_length="), less)).when(k == 2, F.concat(F.lit("dataset.num_train_epochs="), less))
        .when(k == 3, F.concat(F.lit("dataset.eval_fraction="), (F.col("p_size") / 40.0).cast("string"))).when(k == 4, F.concat(F.lit("dataset.message_schema={z"), size, F.lit(": 1, a"), size, F.lit(": 2}")))
        .otherwise(F.concat(F.lit("training.max_steps="), size))
    )
    return C._table(spark, sf, "part").select("p_partkey", "p_size", setting.alias("setting"))


@query(f"""WITH a AS ({_ASKED_SQL}) SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size < 6 WHEN 1 THEN p_size < 7 WHEN 3 THEN p_size >= 40 WHEN 4 THEN true ELSE false END AS refused,
  CASE WHEN p_partkey % 6 = 4 THEN 'message_schema has unknown keys: a' || p_size || ', z' || p_size END AS says FROM a""")
def recipe_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Settings that a recipe's validation refuses, and the sorted names in a message; each setting is tried once."""
    asked = _asked(spark, sf)

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for setting in batch["setting"]:
                try:
                    config.read(RECIPE, [setting])
                    found.append((setting, False, None))
                except ValueError as e:
                    found.append((setting, True, str(e) if "schema" in setting else None))
            yield pd.DataFrame(found, columns=["setting", "refused", "says"])

    known = asked.select("setting").distinct().mapInPandas(tried, "setting string, refused boolean, says string")
    return asked.join(known, "setting").select("p_partkey", "refused", "says")


@query("""WITH s AS (SELECT p_partkey, CAST(p_size * 100 AS BIGINT) AS block, CAST(p_size + 5 AS BIGINT) AS n FROM part), p AS (SELECT *, CAST(pow(2, ceil(log2(block))) AS BIGINT) AS prompt FROM s)
SELECT p_partkey, prompt AS max_prompt_length, prompt + n AS cache_size, CAST(3 AS BIGINT) AS prompts FROM p""")
def recipe_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Sampling settings with their defaults, of recipes whose block and reply sizes follow the parts' sizes."""
    parts = C._table(spark, sf, "part").select("p_partkey", "p_size")

    def settings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for size in batch["p_size"]:
                overrides = [f"model.flash_attention_block_size={size * 100}", f"training.transcripts={{max_new_tokens: {size + 5}, prompts: null}}"]
                got = config.transcript_settings(config.read(RECIPE, overrides))
                rows.append((size, got["max_prompt_length"], got["cache_size"], len(got["prompts"])))
            yield pd.DataFrame(rows, columns=["p_size", "max_prompt_length", "cache_size", "prompts"])

    known = parts.select("p_size").distinct().mapInPandas(settings, "p_size int, max_prompt_length long, cache_size long, prompts long")
    return parts.join(known, "p_size").select("p_partkey", "max_prompt_length", "cache_size", "prompts")


@query("""WITH s AS (SELECT DISTINCT text FROM conversations WHERE role = 'system'), p AS (
  SELECT md5(text) AS system, length('<system>' || text || '</system><user>What is 2 + 2?</user><assistant>') AS prompt, length('<think>2 and 2 are 4.</think>4</assistant>') AS reply FROM s)
SELECT system, CASE WHEN prompt + reply > 256 THEN 'overlength' END AS reason, CASE WHEN prompt + reply <= 256 THEN CAST(prompt AS BIGINT) END AS prompt_length, CASE WHEN prompt + reply <= 256 THEN CAST(reply AS BIGINT) END AS supervised FROM p""")
def recipe_probe(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe's preflight example in its corpus's own spelling, under each system prompt that the corpus has."""
    recipe = config.read(RECIPE, ["dataset.message_schema={role_key: from, content_key: value, role_map: {human: user, gpt: assistant}}", "dataset.messages_column=chat"])
    systems = C._table(spark, sf, "conversations").where("role = 'system'").select(F.col("text").alias("system")).distinct()
    rows = pipeline.probe(spark, recipe, T.Adapter(PointTokenizer), systems).withColumn("supervised", E.supervised("spans"))
    return rows.select(F.md5("system").alias("system"), F.col("drop_reason").alias("reason"), *C._long("prompt_length", "supervised"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'gs://runs/../' || s_name WHEN 1 THEN '/runs/b/' || s_name ELSE '/runs/c/' || s_name END AS location FROM supplier""")
def checkpoint_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Where checkpoints go that are asked for by remote and by winding local paths."""
    k = F.col("s_suppkey") % 3
    asked = F.concat(F.when(k == 0, "gs://runs/../").when(k == 1, "/runs/a/../b/").otherwise("/runs//./c/d/../"), "s_name")

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(location=batch["location"].map(config.checkpoint_location))

    return C._table(spark, sf, "supplier").select("s_suppkey", asked.alias("location")).mapInPandas(located, "s_suppkey long, location string")


@query("SELECT role AS split, conv_id, turn FROM conversations")
def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Splits of a named corpus, here the turns of each role."""
    root = workspace.folder(spark, "catalog")
    turns = C._table(spark, sf, "conversations")
    roles = [r["role"] for r in turns.select("role").distinct().orderBy("role").collect()]
    for role in roles:
        turns.where(F.col("role") == role).write.parquet(f"{root}/turns/{role}")
    chats = corpora.Catalog({"chats": corpora.Corpus(root)})
    found = [chats.scan(spark, "chats", config="turns", split=role).select(F.lit(role).alias("split"), "conv_id", "turn") for role in roles]
    return reduce(DataFrame.union, found)


#: The public vocabulary of the queries below: a rank file in base 64.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _ids_sql(texts: str) -> str:
    """Byte pairs as a recursion: in each round the leftmost pair of least rank of each piece. ``texts`` gives conv_id, turn, text, without runs of blanks."""
    return rf"""WITH RECURSIVE tok AS (SELECT hex(from_base64(column0)) AS h, column1 AS id FROM read_csv('{RANKS}', delim=' ', header=false, quote='', escape='', columns={{'column0': 'VARCHAR', 'column1': 'INTEGER'}})),
cuts AS (SELECT h, id, unnest(generate_series(1, length(h) // 2 - 1)) AS k FROM tok),
pairs AS (SELECT x.id AS l, y.id AS r, c.id AS m FROM cuts c JOIN tok x ON x.h = left(c.h, 2 * k) JOIN tok y ON y.h = substr(c.h, 2 * k + 1)),
texts AS ({texts}),
cut AS (SELECT conv_id, turn, unnest(p) AS piece, generate_subscripts(p, 1) AS nth FROM (SELECT conv_id, turn, regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+') AS p FROM texts)),
words AS (SELECT DISTINCT piece, hex(encode(piece)) AS h FROM cut),
bytes AS (SELECT piece, h, unnest(generate_series(1, length(h) // 2)) AS place FROM words),
state AS (
  SELECT 0 AS step, b.piece, b.place, t.id FROM bytes b JOIN tok t ON t.h = substr(b.h, 2 * b.place - 1, 2)
  UNION ALL
  SELECT step, piece, place, id FROM (
    SELECT step + 1 AS step, piece, place, CASE WHEN place = bp THEN bm ELSE id END AS id, lag(place) OVER (PARTITION BY piece ORDER BY place) IS NOT DISTINCT FROM bp AS gone
    FROM (
      SELECT *, min(m) OVER w AS bm, arg_min(place, m::BIGINT * 1000000 + place) OVER w AS bp FROM (
        SELECT s.*, p.m FROM (SELECT *, lead(id) OVER (PARTITION BY piece ORDER BY place) AS nx FROM state) s LEFT JOIN pairs p ON p.l = s.id AND p.r = s.nx
      ) q WINDOW w AS (PARTITION BY piece)
    ) z WHERE bp IS NOT NULL
  ) y WHERE NOT gone
), last AS (SELECT piece, max(step) AS step FROM state GROUP BY piece),
ids AS (SELECT s.piece, list(s.id ORDER BY s.place) AS ids FROM state s JOIN last l ON l.piece = s.piece AND l.step = s.step GROUP BY s.piece),
coded AS (SELECT c.conv_id, c.turn, CAST(sum(len(ids)) AS BIGINT) AS n, md5(string_agg(array_to_string(ids, ','), ',' ORDER BY nth)) AS ids FROM cut c JOIN ids i ON i.piece = c.piece GROUP BY ALL)
"""


@query(f"{_ids_sql('SELECT conv_id, turn, text FROM conversations')} SELECT conv_id, turn, n, ids FROM coded")
def vocabulary_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every turn by a public vocabulary."""
    turns = C._table(spark, sf, "conversations").where("text != ''")
    coded = bpe.tokenize(turns, "text", ["conv_id", "turn"], bpe.Vocabulary(RANKS))
    return coded.select("conv_id", "turn", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids"))


# Turns as the chat layout has them, and the text that asks for a reply as turn -1 of conversation -1.
_LAID_OUT = "SELECT conv_id, turn, role || chr(10) || text AS text FROM conversations UNION ALL SELECT -1, -1, ''assistant'' || chr(10)".replace("''", "'")


@query(f"""{_ids_sql(_LAID_OUT)}, t AS (SELECT c.conv_id, c.turn, v.role, c.n + 3 AS len, v.text FROM coded c JOIN conversations v ON v.conv_id = c.conv_id AND v.turn = c.turn),
asks AS (SELECT n + 1 AS n FROM coded WHERE conv_id = -1),
e AS (SELECT conv_id, sum(len) AS total, arg_max(role, turn) AS last_role, arg_min(role, turn) AS first_role, arg_max(len, turn) AS last_len, sum(CASE WHEN role = 'assistant' THEN len - (SELECT n FROM asks) END) AS supervised FROM t GROUP BY conv_id)
SELECT conv_id, CAST(total - last_len + (SELECT n FROM asks) AS BIGINT) AS prompt_length, CAST(total AS BIGINT) AS unpadded_length, CAST(supervised AS BIGINT) AS supervised FROM e
WHERE last_role = 'assistant' AND first_role <> 'assistant' AND total <= 2048""")
def recipe_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe whose tokenizer section names a public vocabulary: lengths of all rows that it keeps."""
    marks = "{<|endoftext|>: 50256, <|im_start|>: 50257, <|im_end|>: 50258}"
    overrides = [f"tokenizer.ranks={RANKS}", f"tokenizer.special_tokens={marks}", "dataset.eval_fraction=0", "dataset.batch_size=1"]
    rows = _built(spark, sf, *overrides).train.withColumn("supervised", F.size(F.filter("input_mask", lambda x: x)))
    return rows.select("conv_id", *C._long("prompt_length", "unpadded_length", "supervised"))


class TemplateTokenizer(PointTokenizer):
    """Renders by the parts of its chat template: open, middle and close marks, one a line."""

    chat_template = "<\n>\n</"

    def text(self, messages: list[dict[str, str]], generate: bool) -> str:
        opened, middle, close = self.chat_template.split("\n")
        return "".join(f"{opened}{m['role']}{middle}{m['content']}{close}" for m in messages) + (f"{opened}assistant{middle}" if generate else "")


@query("""WITH c AS (SELECT conv_id, sum(length(role) + length(text) + 5) AS total, arg_max(role, turn) AS last_role, arg_min(role, turn) AS first_role, arg_max(length(text) + 2, turn) AS reply FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(total - reply AS BIGINT) AS prompt_length, CAST(total AS BIGINT) AS unpadded_length FROM c WHERE last_role = 'assistant' AND first_role <> 'assistant' AND total <= 2048""")
def recipe_chat_template(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe's own chat template in the place of its tokeniser's."""
    template = T.Adapter(TemplateTokenizer)
    rows = _built(spark, sf, 'tokenizer.chat_template="[[\\n:\\n]]"', "dataset.eval_fraction=0", "dataset.batch_size=1", template=template).train
    return rows.select("conv_id", *C._long("prompt_length", "unpadded_length"))


@query(C._placed_sql(8) + f" SELECT {C._PLACED_COLUMNS} FROM placed")
def stream_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of one shard as a stream packs it, whose lengths come in three batches; a row without a length ends it."""
    source, out, state = (workspace.folder(spark, n) for n in ("lengths-in", "lengths-out", "lengths-state"))
    rows = C._examples(spark, sf).select(F.lit(0).alias("shard"), F.col("conv_id").alias("example_id"), F.col("conv_id").alias("order_key"), F.col("unpadded_length").alias("length"))
    rows = workspace.saved(ordering.numbered(rows, ["order_key"]), "numbered")
    third = -(-rows.count() // 3) or 1
    end = spark.range(1).select(F.lit(0).alias("shard"), *[F.lit(None).cast(t).alias(c) for c, t in (("example_id", "long"), ("order_key", "long"), ("length", "int"))])
    for k in range(3):
        part = rows.where(F.floor(F.col("position") / third) == k).drop("position")
        (part.unionByName(end) if k == 2 else part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(source)
    packed = streams.pack_stream(stream, 8192, idle_ms=None)
    packed.writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(packed.schema).parquet(out).select(F.col("example_id").alias("conv_id"), *C._long("window_id", "segment", "offset", "length"))


@query("SELECT event_id, user_id FROM events")
def replayed_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A stream's rows in a sink by batch, after its last batch was written, its commit lost, and the batch run again."""
    source, out, state = (workspace.folder(spark, n) for n in ("replay-in", "replay-out", "replay-state"))
    rows = C._table(spark, sf, "events").select("event_id", "user_id")
    rows.repartition(3).write.parquet(source)
    sink = streams.BatchFolders(out)
    for again in (False, True):
        if again:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/commits")
            store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            last = max((f.getPath() for f in store.listStatus(at) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
            store.delete(last, False)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark, rows.schema)


@query("SELECT c_custkey, c_name FROM customer")
def replaced_table(spark: SparkSession, sf: str) -> DataFrame:
    """A guarded table after a replacement, another that failed half way, and one by what reads it, which is refused."""
    path = f"{workspace.folder(spark, 'guarded')}/table"
    customers = C._table(spark, sf, "customer").select("c_custkey", "c_name")
    corpora.write_guarded(customers.limit(1), path, protected=[], overwrite=True)
    corpora.write_guarded(customers, path, protected=[], overwrite=True)
    broken = customers.withColumn("c_custkey", F.when(F.col("c_custkey") > 1, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("c_custkey")))
    for bad in (broken, spark.read.parquet(path).where("c_custkey = 1")):
        try:
            corpora.write_guarded(bad, path, protected=[], overwrite=True)
        except Exception:
            continue
        raise AssertionError("a bad replacement went through")
    return spark.read.schema(customers.schema).parquet(path)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) // 2 FROM orders))")
def first_in_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of a corpus in order of its files, of which the rest is not read."""
    path = workspace.folder(spark, "ordered")
    orders = C._table(spark, sf, "orders").select("o_orderkey")
    orders.repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return corpora.first_rows(corpora.scan_glob(spark, f"{path}/*.parquet"), orders.count() // 2)


@query("SELECT count(*) AS n, CAST(5 AS BIGINT) AS files, CAST(5 AS BIGINT) AS matched, count(*) AS places FROM orders")
def shard_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, files and places in files of a glob over five shards."""
    path = workspace.folder(spark, "shards")
    C._table(spark, sf, "orders").repartition(5).write.parquet(path)
    scan = corpora.scan_glob(spark, f"{path}/*.parquet")
    counts = corpora.ordered(scan).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("order_key").alias("places")).first()
    row = (counts["n"], corpora.shards(scan), corpora.matching(spark, f"{path}/*.parquet"), counts["places"])
    return spark.createDataFrame([row], "n long, files long, matched long, places long")


@query("SELECT n_nationkey * 500 AS asked, n_nationkey % 3 = 0 AS written FROM nation")
def resolved_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Whether steps that are asked for were written; there are as many as nations."""
    steps = [r["step"] for r in C.checkpoint_steps(spark, sf).collect()]
    rows = []
    for n in range(C._table(spark, sf, "nation").count()):
        try:
            rows.append((n * 500, corpora.resolve_step(steps, n * 500) == n * 500))
        except ValueError:
            rows.append((n * 500, False))
    return spark.createDataFrame(rows, "asked long, written boolean")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "train/").otherwise("jax/"), "event_type")
    return C._table(spark, sf, "events").select("event_id", name.alias("event"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("step"))


@query("SELECT 'tensorboard' AS sink, event_id FROM events UNION ALL SELECT 'wandb' AS sink, event_id FROM events WHERE event_id % 2 = 0 AND event_id % 7 <> 0")
def metric_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """What each sink of a recipe gets of one batch of metrics."""
    root = workspace.folder(spark, "sinks")
    writer = lambda kind: lambda options: lambda batch: batch.write.parquet(f"{root}/{kind}")
    recipe = config.read(RECIPE, ["training.wandb={enabled: true}"])
    streams.fan_out(_metrics(spark, sf), streams.sinks(recipe, {kind: writer(kind) for kind in ("tensorboard", "wandb")}))
    found = [spark.read.parquet(f"{root}/{kind}").select(F.lit(kind).alias("sink"), "event_id") for kind in ("tensorboard", "wandb")]
    return found[0].union(found[1])


@query("SELECT event_id AS step FROM events WHERE event_id > 0 AND event_id % 50 = 0")
def interval_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of a stream that a sampling hook acts on."""
    source, out, state = (workspace.folder(spark, n) for n in ("steps-in", "steps-out", "steps-state"))
    steps = C._table(spark, sf, "events").select(F.col("event_id").alias("step"))
    steps.write.parquet(source)
    hook = streams.IntervalSampler(50, lambda due, batch: due.write.mode("append").parquet(out))
    streams.sample_stream(spark.readStream.schema(steps.schema).parquet(source), hook, state).awaitTermination()
    return spark.read.schema(steps.schema).parquet(out)


@query("""WITH p AS (SELECT unnest(['Name a prime.', 'Why is the sky blue?']) AS prompt), r AS (
  SELECT event_id AS step, prompt, '<system>Be brief.</system><user>' || prompt || '</user><assistant>' AS rendered FROM events CROSS JOIN p WHERE event_id > 0 AND event_id % 100 = 0)
SELECT kind, step, prompt, rendered || '<think>' AS completion, CAST(length(rendered) AS BIGINT) AS generated_tokens, false AS reasoning_balanced, length(rendered) >= 72 AS hit_token_cap
FROM r CROSS JOIN (SELECT unnest(['file', 'log']) AS kind) k""")
def transcript_hook(spark: SparkSession, sf: str) -> DataFrame:
    """What a recipe's sampling hook appends to its file and hands to its log, over a stream of steps."""
    source, out, log, state = (workspace.folder(spark, n) for n in ("hook-in", "hook-out", "hook-log", "hook-state"))
    steps = C._table(spark, sf, "events").select(F.col("event_id").alias("step"))
    steps.write.parquet(source)
    overrides = [f"training.transcripts={{every_n_steps: 100, max_new_tokens: 72, prompts: ['Name a prime.', 'Why is the sky blue?'], output_path: '{out}'}}", "dataset.system_prompt=Be brief."]
    settings = config.transcript_settings(config.read(RECIPE, overrides))

    def build() -> Any:
        return F.pandas_udf(lambda rendered: pd.DataFrame({"text": rendered + "<think>", "n_tokens": rendered.str.len().astype("int32")}), "text string, n_tokens int")

    act = streams.transcript_action(settings, build, lambda table: table.write.mode("append").parquet(log))
    hook = streams.IntervalSampler(settings["every_n_steps"], act)
    streams.sample_stream(spark.readStream.schema(steps.schema).parquet(source), hook, state).awaitTermination()
    found = [transcripts.read_jsonl(spark, out).select(F.lit("file").alias("kind"), *transcripts.LOGGED), spark.read.parquet(log).select(F.lit("log").alias("kind"), *transcripts.LOGGED)]
    return found[0].union(found[1]).withColumns({c: F.col(c).cast("long") for c in ("step", "generated_tokens")})


@query("""WITH s AS (SELECT conv_id, turn, '<user>' || text || '</user><assistant>' AS rendered FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id * 1000 + turn AS step, CASE WHEN turn % 2 = 0 THEN '<think>' || rendered || '</think>' ELSE rendered END AS said, length(rendered) AS n FROM s)
SELECT CAST(step AS BIGINT) AS step, md5(said) AS completion, CAST(length(said) AS BIGINT) AS completion_chars, CAST(n AS BIGINT) AS generated_tokens,
  strpos(said, '<think>') > 0 AND strpos(said, '</think>') > strpos(said, '<think>') AS reasoning_balanced, n >= 100 AS hit_token_cap FROM c""")
def sampled_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one sampler call for each batch of rendered prompts; this sampler says what it was asked."""

    @F.pandas_udf("text string, n_tokens int")
    def sampler(rendered: pd.Series) -> pd.DataFrame:
        even = rendered.str.endswith("0")
        asked = rendered.str[:-1]
        return pd.DataFrame({"text": asked.where(~even, "<think>" + asked + "</think>"), "n_tokens": asked.str.len().astype("int32")})

    turns = C._table(spark, sf, "conversations").where("role = 'user'")
    mark = F.when(F.col("turn") % 2 == 0, "0").otherwise("1")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("step"), F.col("text").alias("prompt"), F.concat(transcripts.render_prompt(F.col("text")), mark).alias("rendered"))
    said = transcripts.sample(asked, sampler, max_new_tokens=100).withColumn("completion", F.md5("completion"))
    return said.select(F.col("step").cast("long").alias("step"), "completion", *C._long("completion_chars", "generated_tokens"), "reasoning_balanced", "hit_token_cap")


@query("SELECT conv_id, role, md5(text) AS text FROM conversations")
def strict_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel arrays of roles and contents, place by place."""
    df = C._nested(spark, sf).select("conv_id", F.transform("messages", lambda m: m["role"]).alias("roles"), F.transform("messages", lambda m: m["content"]).alias("contents"))
    return transcripts.zip_strict(df, "roles", "contents").select("conv_id", F.col("zipped.roles").alias("role"), F.md5("zipped.contents").alias("text"))
