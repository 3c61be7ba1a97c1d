"""Records of generated replies, their JSON lines, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.template import CODE_POINTS, Additive

SCHEMA = (
    "step int, prompt string, completion string, completion_chars int, generated_tokens int, "
    "has_reasoning_start boolean, has_reasoning_end boolean, reasoning_balanced boolean, hit_token_cap boolean"
)
LOGGED = ("step", "prompt", "completion", "generated_tokens", "reasoning_balanced", "hit_token_cap")
# The prompts sampled when a configuration names none.
DEFAULT_PROMPTS = (
    "What is the remainder when 2^100 is divided by 7?",
    "A train travels 60 km in 45 minutes. What is its average speed in km/h?",
    "Is 91 a prime number? Show your reasoning.",
)


def records(df: DataFrame, *, max_new_tokens: int, start: str = "<think>", end: str = "</think>") -> DataFrame:
    """The nine fields from step, prompt, completion and generated_tokens (may be null)."""
    first, last = F.locate(start, F.col("completion")), F.locate(end, F.col("completion"))
    return df.select(
        F.col("step").cast("int").alias("step"), "prompt", "completion", F.length("completion").alias("completion_chars"),
        F.col("generated_tokens").cast("int").alias("generated_tokens"), (first > 0).alias("has_reasoning_start"), (last > 0).alias("has_reasoning_end"),
        ((first > 0) & (last > first)).alias("reasoning_balanced"), F.coalesce(F.col("generated_tokens") >= max_new_tokens, F.lit(False)).alias("hit_token_cap"),
    )


def append_jsonl(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Adds records. Those of a numbered batch of a stream stand in a folder of their own, which a replay writes anew."""
    if batch_id is None:
        df.write.mode("append").json(path)
    else:
        df.write.mode("overwrite").json(f"{path}/batch-{batch_id:012d}")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(path)


def by_step(df: DataFrame) -> DataFrame:
    """Closed, capped and all records of each step."""
    return df.groupBy("step").agg(F.count_if("reasoning_balanced").alias("closed"), F.count_if("hit_token_cap").alias("capped"), F.count(F.lit(1)).alias("total")).orderBy("step")


def unclosed(df: DataFrame) -> DataFrame:
    """Records that stopped by themselves with their reasoning open."""
    return df.where(~F.col("reasoning_balanced") & ~F.col("hit_token_cap"))


def should_sample(step: Column, every: Column) -> Column:
    return (every > 0) & (step > 0) & (F.when(every > 0, step % every) == 0)


def render_prompt(prompt: Column, system: str | None = None, template: Additive = CODE_POINTS) -> Column:
    """The text that asks for a reply: an optional system turn, the user's, and the generation prompt."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = [turn("system", F.lit(system))] if system else []
    return template.render(F.array(*turns, turn("user", prompt)), generate=True)


def sample(df: DataFrame, sampler, *, max_new_tokens: int, start: str = "<think>", end: str = "</think>") -> DataFrame:
    """Records from a sampler: a scalar Arrow or pandas function, prompt to struct(text, n_tokens)."""
    said = df.withColumn("_said", sampler(F.col("rendered")))
    said = said.withColumns({"completion": F.col("_said.text"), "generated_tokens": F.col("_said.n_tokens")})
    return records(said, max_new_tokens=max_new_tokens, start=start, end=end)


def asked(steps: DataFrame, prompts: list[str], system: str | None = None, template: Additive = CODE_POINTS) -> DataFrame:
    """step, prompt and rendered of every prompt at every step; prompts are a recipe's short list."""
    each = steps.select("step").distinct().withColumn("prompt", F.explode(F.array(*[F.lit(p) for p in prompts])))
    return each.withColumn("rendered", render_prompt(F.col("prompt"), system, template))


def zip_strict(df: DataFrame, *columns: str, name: str = "zipped") -> DataFrame:
    """One row for each place of parallel arrays; arrays of different sizes are an error."""
    sizes = [F.size(c) for c in columns]
    equal = F.lit(True)
    for s in sizes[1:]:
        equal = equal & (s == sizes[0])
    checked = F.when(equal, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("parallel arrays differ in size")))
    return df.withColumn(name, F.explode(checked))
