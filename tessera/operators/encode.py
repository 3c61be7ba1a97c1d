"""From turns to supervised examples: spans, loss masks, overlength policy and padding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import messages as M
from tessera.functions.template import CODE_POINTS, Additive, Template, code_points

POLICIES = ("drop", "truncate")


@dataclass(frozen=True)
class EncodeConfig:
    max_length: int
    messages_column: str = "messages"
    system_prompt: str | None = None
    assistant_only_loss: bool = True
    require_reasoning_tags: bool = True
    reasoning_start: str = "<think>"
    reasoning_end: str = "</think>"
    schema: M.MessageSchema = field(default_factory=lambda: M.DEFAULT_SCHEMA)
    overlength_policy: str = "drop"
    template: Template = CODE_POINTS

    def __post_init__(self) -> None:
        if self.overlength_policy not in POLICIES:
            raise ValueError(f"overlength_policy must be one of {', '.join(POLICIES)}")


def prepare(df: DataFrame, cfg: EncodeConfig) -> DataFrame:
    """turns and drop_reason after all rules that need no rendering."""
    out = M.final_assistant(M.normalize(df, cfg.messages_column, cfg.schema))
    out = M.inject_system(out, cfg.system_prompt)
    return M.require_tags(out, cfg.reasoning_start, cfg.reasoning_end) if cfg.require_reasoning_tags else out


def encode(df: DataFrame, cfg: EncodeConfig) -> DataFrame:
    """Adds drop_reason, spans, prompt_length, unpadded_length, full_length and, for kept rows, ids.

    ``full_length`` is the render's length before truncation.
    """
    out = prepare(df, cfg)
    if not isinstance(cfg.template, Additive):
        out = cfg.template.rendered(
            out.drop("ids", "spans", "prompt", "error"), spans=cfg.assistant_only_loss, longest=cfg.max_length if cfg.overlength_policy == "drop" else None
        )
        out = M.rejected(out, "render_error", F.coalesce(F.col("error") == "render_error", F.lit(False)))
        out = out.withColumn("full_length", F.when(F.col("turns").isNotNull(), F.size("ids")))
        first = F.coalesce(F.col("error") == "assistant_first", F.lit(False))
    else:
        t = cfg.template
        ok = F.col("drop_reason").isNull()
        out = out.withColumn("rendered", F.when(ok, t.render(F.col("turns")))).withColumn("full_length", F.length("rendered"))
        closing = F.lit(t.closing)

        def step(state: Column, m: Column) -> Column:
            start = state["at"] + len(t.generation)
            after = state["at"] + F.length(t.turn(m))
            found = F.call_function("locate", closing, F.col("rendered"), start + 1) - 1 + len(t.closing)
            end = F.when(after == F.col("full_length"), after).otherwise(found)
            span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
            more = F.when(m["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
            return F.struct(after.cast("int").alias("at"), more.alias("spans"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        out = out.withColumn("spans", F.when(ok, F.aggregate("turns", zero, step, lambda s: s["spans"])))
        last = F.element_at("turns", -1)
        out = out.withColumn("prompt", F.when(ok, F.col("full_length") - F.length(t.turn(last)) + len(t.generation)).cast("int"))
        out = out.withColumn("error", F.lit(None).cast("string"))
        first = F.coalesce(F.get("turns", F.lit(0))["role"] == "assistant", F.lit(False))
    length = F.least(F.col("full_length"), F.lit(cfg.max_length))
    out = M.rejected(out, "too_short", F.col("full_length") < 2)
    if cfg.overlength_policy == "drop":
        out = M.rejected(out, "overlength", F.col("full_length") > cfg.max_length)
    if cfg.assistant_only_loss:
        out = M.rejected(out, "assistant_first", first)
        for code in ("prefix_unstable", "no_closing"):
            out = M.rejected(out, code, F.coalesce(F.col("error") == code, F.lit(False)))
        out = M.rejected(out, "prompt_fills_window", ~F.exists("spans", lambda s: s["start"] < length))
        prompt = F.least(F.element_at("spans", -1)["start"], length)
    else:
        out = M.rejected(out, "prefix_unstable", F.col("prompt").isNull())
        out = M.rejected(out, "prompt_fills_window", F.col("prompt") >= length)
        prompt = F.col("prompt")
        whole = F.array(F.struct(F.lit(0).alias("start"), length.cast("int").alias("end")))
        out = out.withColumn("spans", whole)
    kept = F.col("drop_reason").isNull()
    clipped = F.transform(F.filter("spans", lambda s: s["start"] < length), lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], length).alias("end")))
    ids = F.col("ids") if not isinstance(cfg.template, Additive) else code_points(F.substr("rendered", F.lit(1), length))
    return (
        out.withColumn("prompt_length", F.when(kept, prompt).cast("int"))
        .withColumn("unpadded_length", F.when(kept, length).cast("int"))
        .withColumn("spans", F.when(kept, clipped))
        .withColumn("input_ids", F.when(kept, F.slice(ids, F.lit(1), length)))
        .drop("ids", "prompt", "error", "rendered")
    )


def kept(encoded: DataFrame) -> DataFrame:
    return encoded.where("drop_reason is null")


def supervised(spans: Column | str) -> Column:
    """Number of supervised tokens."""
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])


def loss_mask(spans: Column | str, length: Column | int) -> Column:
    """The dense mask of ``length`` places, for sinks only."""
    places = F.sequence(F.lit(0), F.lit(length) - 1 if isinstance(length, int) else length - 1)
    return F.transform(places, lambda p: F.exists(spans, lambda s: (p >= s["start"]) & (p < s["end"])))


def padded(ids: Column | str, length: int, pad_id: int) -> Column:
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(F.concat(col, F.array_repeat(F.lit(pad_id), length)), 1, length)


def dense(encoded: DataFrame, cfg: EncodeConfig, pad_id: int = 0) -> DataFrame:
    """Fixed-length input_tokens and input_mask of kept rows."""
    return kept(encoded).withColumns({"input_tokens": padded("input_ids", cfg.max_length, pad_id), "input_mask": loss_mask("spans", cfg.max_length)})


def funnel(encoded: DataFrame) -> DataFrame:
    """Rows by drop reason (``kept`` for those without)."""
    return encoded.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
