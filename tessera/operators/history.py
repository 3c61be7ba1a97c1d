"""Fitting a chat history into a prompt budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.template import CODE_POINTS, Additive


def fit_history(df: DataFrame, budget: int, *, system: str | None = None, template: Additive = CODE_POINTS, history: str = "messages") -> DataFrame:
    """Adds fitted (null if nothing fits), token_count and removed_turns.

    The two oldest messages go as long as the render is over budget and more than
    one is left; an even history can be emptied.
    """
    prefix = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system else []
    fixed = F.length(template.render(F.array(*prefix), generate=True)) if prefix else F.lit(len(template.generation))
    sizes = F.transform(history, lambda m: F.length(template.turn(m)))
    # Tokens left after dropping k pairs: suffix sums, from one pass.
    tails = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(history) / 2).cast("int")),
        lambda k: F.struct(k.alias("k"), (F.col("_fixed") + F.aggregate(F.slice(F.col("_sizes"), 2 * k + 1, F.greatest(F.size("_sizes") - 2 * k, F.lit(0))), F.lit(0), lambda a, x: a + x)).alias("n"), (F.size("_sizes") - 2 * k).alias("left")),
    )
    out = df.withColumns({"_sizes": sizes, "_fixed": fixed}).withColumn("_tails", tails)
    # The loop stops at the first k that fits or that leaves at most one message.
    stop = F.get(F.filter("_tails", lambda t: (t["n"] <= budget) | (t["left"] <= 1)), F.lit(0))
    out = out.withColumn("_stop", stop)
    left = F.slice(F.col(history), 2 * F.col("_stop.k") + 1, F.greatest(F.col("_stop.left"), F.lit(0)))
    return (
        out.withColumn("token_count", F.col("_stop.n"))
        .withColumn("fitted", F.when(F.col("_stop.n") <= budget, left))
        .withColumn("removed_turns", F.least(2 * F.col("_stop.k"), F.size(history)))
        .drop("_sizes", "_fixed", "_tails", "_stop")
    )


def prompt_tokens(messages: Column, *, system: str | None = None, template: Additive = CODE_POINTS) -> Column:
    """Length of the render that asks for a reply to the messages, behind an optional system turn."""
    prefix = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system else []
    return F.length(template.render(F.concat(F.array(*prefix), messages) if prefix else messages, generate=True))


def prompt_rejection(prompt: Column, tokens: Column, budget: int) -> Column:
    """Why a raw prompt cannot be completed: ``empty_prompt``, ``prompt_too_long``, or null."""
    return F.when(prompt.isNull() | (F.length(prompt) == 0), "empty_prompt").when(tokens > budget, "prompt_too_long")


def check_prompt(tokens: int, budget: int) -> None:
    """The same rule for one prompt on the driver."""
    if tokens == 0:
        raise ValueError("the prompt is empty")
    if tokens > budget:
        raise ValueError(f"the prompt has {tokens} tokens; {budget} fit")
