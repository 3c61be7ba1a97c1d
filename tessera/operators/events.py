"""Metric events, log records, parameter keys and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Levels by name, and packages whose routine records are demoted.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
NOISY_PACKAGES = ("orbax",)


def stepped_metrics(df: DataFrame) -> DataFrame:
    """Events with a step whose name, without leading slashes, is under train/ or eval/."""
    return df.where(F.col("step").isNotNull() & F.regexp_replace("event", "^/+", "").rlike("^(train|eval)/"))


def demoted(df: DataFrame, packages: tuple[str, ...] = NOISY_PACKAGES) -> DataFrame:
    """INFO records from a path with a package as a whole component become DEBUG; none is dropped."""
    noisy = F.lit(False)
    for name in packages:
        noisy = noisy | F.contains("pathname", F.lit(f"/{name}/"))
    level = F.when((F.col("level") == LEVELS["INFO"]) & noisy, LEVELS["DEBUG"]).otherwise(F.col("level"))
    names = F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (v, k)])
    return df.withColumn("level", level).withColumn("level_name", F.coalesce(F.try_element_at(names, F.col("level")), F.concat(F.lit("Level "), F.col("level").cast("string"))))


# Parameter names and the published keys they have: (pattern, key, dimensions or None).
PARAMETER_KEYS = (
    (r"^embedder\.input_embedding$", "model.embed_tokens.weight", None),
    (r"^final_norm\.w$", "model.norm.weight", None),
    (r"^lm_head\.w$", "lm_head.weight", None),
    (r"^layers\.(\d+)\.attn\.([qkv]_proj)\.w$", "model.layers.$1.self_attn.$2.weight", 3),
    (r"^layers\.(\d+)\.attn\.o_proj\.w$", "model.layers.$1.self_attn.o_proj.weight", 3),
    (r"^layers\.(\d+)\.mlp\.(gate_proj|up_proj|down_proj)\.kernel$", "model.layers.$1.mlp.$2.weight", None),
    (r"^layers\.(\d+)\.attn\.(q_norm|k_norm)\.w$", "model.layers.$1.self_attn.$2.weight", None),
    (r"^layers\.(\d+)\.(input_layernorm|post_attention_layernorm)\.w$", "model.layers.$1.$2.weight", None),
)


def parameter_key(path: Column, dimensions: Column) -> Column:
    """The key of a parameter; unknown names and attention weights of other than three dimensions are errors."""
    out = F.raise_error(F.concat(F.lit("no key for parameter "), path)).cast("string")
    for pattern, key, need in reversed(PARAMETER_KEYS):
        named = F.regexp_replace(path, pattern, key)
        if need is not None:
            named = F.when(dimensions == need, named).otherwise(F.raise_error(F.concat(path, F.lit(f": not of {need} dimensions"))).cast("string"))
        out = F.when(path.rlike(pattern), named).otherwise(out)
    return out


def key_difference(base: DataFrame, exported: DataFrame, key: str = "key") -> DataFrame:
    """(side, key): keys that only one of both tables has."""
    b, e = base.select(key).distinct(), exported.select(key).distinct()
    missing = b.join(e, key, "left_anti").select(F.lit("missing").alias("side"), key)
    return missing.union(e.join(b, key, "left_anti").select(F.lit("extra").alias("side"), key))


def duplicate_keys(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def learning_rate(step: Column, max_steps: int, rate: float, *, warmup_ratio: float = 0.0, min_ratio: float = 0.1) -> Column:
    """The rate at a step: linear warm-up from zero, then a cosine to rate * min_ratio, which stays."""
    warm = int(max_steps * warmup_ratio)
    decay = max(max_steps, warm + 1)
    progress = F.least((step - warm) / F.lit(decay - warm), F.lit(1.0))
    cosine = rate * (min_ratio + (1 - min_ratio) * (1 + F.cos(F.lit(3.141592653589793) * progress)) / 2)
    return F.when(step < warm, F.lit(rate) * step / max(warm, 1)).otherwise(cosine)


def lr_schedule(spark: SparkSession, max_steps: int, rate: float, **shape: float) -> DataFrame:
    """(step, rate) of every step."""
    return spark.range(max_steps).select(F.col("id").alias("step"), learning_rate(F.col("id"), max_steps, rate, **shape).alias("rate"))


def power_of_two(block: Column) -> Column:
    """The least power of two that is not under ``block``."""
    bits = F.when(block <= 1, F.lit(0)).otherwise(F.length(F.bin(block.cast("long") - 1)))
    return F.pow(F.lit(2.0), bits).cast("long")
