"""A recipe's data half: scan, limit, split, shuffle, repeat, encode, pack or pad, batch."""

from __future__ import annotations

import copy
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import epochs
from tessera.functions.messages import schema_from_config
from tessera.functions.template import CODE_POINTS, Adapter, Template, padding_id
from tessera.operators import encode as E
from tessera.operators import bpe, ordering, packing
from tessera.sources import corpora, workspace


@dataclass(frozen=True)
class Built:
    """Windows or padded rows with batch_id, in batches of full size."""

    train: DataFrame
    eval: DataFrame | None


def encode_config(dataset: dict[str, Any], template: Template = CODE_POINTS) -> E.EncodeConfig:
    return E.EncodeConfig(
        max_length=dataset["max_length"],
        messages_column=dataset.get("messages_column", "messages"),
        system_prompt=dataset.get("system_prompt"),
        assistant_only_loss=dataset.get("assistant_only_loss", True),
        require_reasoning_tags=dataset.get("require_reasoning_tags", True),
        reasoning_start=dataset.get("reasoning_start", "<think>"),
        reasoning_end=dataset.get("reasoning_end", "</think>"),
        schema=schema_from_config(dataset.get("message_schema")),
        overlength_policy=dataset.get("overlength_policy", "drop"),
        template=template,
    )


def with_recipe(template: Template, config: dict[str, Any]) -> Template:
    """The template that the recipe's ``tokenizer`` section asks for: a vocabulary (``ranks``), or a chat template for a given tokeniser."""
    chat = bpe.from_recipe(config["tokenizer"])
    if chat is not None:
        return chat
    text = config["tokenizer"].get("chat_template")
    if not text:
        return template
    if not isinstance(template, Adapter):
        raise ValueError("tokenizer.chat_template needs a tokeniser: pass an Adapter")
    return replace(template, chat_template=text)


def build(
    df: DataFrame, cfg: E.EncodeConfig, *, key: str, batch_size: int, pad_id: int, epochs: int = 1, shuffle: bool = True, seed: int = 42, pack: bool = False, shards: int | None = None
) -> DataFrame:
    """Encode, shuffle, repeat, then pack or pad, then batch; the last short batch is dropped.

    Rows are encoded once, whatever the number of epochs: encoded rows are
    saved under a number of their own, and epochs are orders of these numbers,
    each with its own shuffle, that meet the tokens at the end.
    """
    encoded = workspace.saved(E.kept(E.encode(df, cfg)).withColumn("_row", F.monotonically_increasing_id()), "encoded")
    rows = ordering.repeated(encoded.select("_row", F.col(key).alias("_key"), "unpadded_length"), epochs)
    rows = ordering.shuffled(rows, "_key", seed) if shuffle else rows.withColumn("order_key", F.col("_key"))
    order = ["epoch", "order_key", "_key", "_row"]
    if not pack:
        places = ordering.in_batches(ordering.numbered(rows.select(*order), order), batch_size)
        return E.dense(places.drop("_key").join(encoded, "_row").drop("_row"), cfg, pad_id)
    example = F.struct("epoch", "_row").alias("example")
    planned = packing.plan(rows.select(*order, "unpadded_length", example), cfg.max_length, id_col="example", order=order, shards=shards)
    windows = packing.assemble(planned.withColumn("_row", F.col("example._row")), encoded, cfg.max_length, id_col="_row", pad_id=pad_id)
    return packing.batches(windows, batch_size)


def load(spark: SparkSession, config: dict[str, Any], *, key: str, catalog: corpora.Catalog | None = None, template: Template = CODE_POINTS) -> Built:
    """Both halves of a recipe's dataset; eval has one epoch, no shuffle, and the same batches and packing.

    ``dataset.pack_shards`` says how many parts of the rows are packed apart:
    null or 1 for one exact sequence.
    """
    d = config["dataset"]
    if d.get("name") == "parquet":
        df = corpora.scan_glob(spark, d["data_files"])
    elif catalog is not None:
        df = catalog.scan(spark, d["name"], config=d.get("config"), split=d.get("train_split", "train"))
    else:
        raise ValueError(f"no catalog for the corpus {d.get('name')!r}")
    df = ordering.first_n(df, d.get("max_examples"), key)
    seed = d.get("seed", 42)
    train, held = ordering.split(df, d.get("eval_fraction", 0.0), key, seed, d.get("eval_max_examples"))
    template = with_recipe(template, config)
    cfg = encode_config(d, template)
    shared = {"key": key, "batch_size": d["batch_size"], "pad_id": padding_id(template), "seed": seed, "pack": d.get("packing", False), "shards": d.get("pack_shards")}
    return Built(
        build(train, cfg, epochs=epochs(config), **shared),
        None if held is None else build(held, cfg, shuffle=False, **shared),
    )


def probe(spark: SparkSession, config: dict[str, Any], template: Template = CODE_POINTS, systems: DataFrame | None = None) -> DataFrame:
    """A preflight check: one small conversation in the corpus's own spelling, encoded at 256 places.

    With ``systems``, a table with a column ``system``, one under each of these prompts.
    """
    d = config["dataset"]
    schema = schema_from_config(d.get("message_schema"))
    spelling = {v: k for k, v in schema.role_map.items()}
    start, end = d.get("reasoning_start", "<think>"), d.get("reasoning_end", "</think>")
    said = lambda role, content: F.struct(F.lit(spelling.get(role, role)).alias(schema.role_key), content.alias(schema.content_key))
    turns = [said("user", F.lit("What is 2 + 2?")), said("assistant", F.lit(f"{start}2 and 2 are 4.{end}4"))]
    column = d.get("messages_column", "messages")
    rows = spark.range(1).select(F.array(*turns).alias(column)) if systems is None else systems.withColumn(column, F.array(said("system", F.col("system")), *turns))
    block = copy.deepcopy({k: d[k] for k in ("messages_column", "system_prompt", "message_schema", "reasoning_start", "reasoning_end") if k in d})
    return E.encode(rows, encode_config(block | {"max_length": 256}, with_recipe(template, config)))
