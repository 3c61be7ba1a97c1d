"""Causal targets, attention pairs, pad masks and masked means of fixed-length rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8


def next_tokens(tokens: Column | str) -> Column:
    """What each place but the last predicts."""
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.slice(col, F.lit(2), F.size(col) - 1)


def last_target(mask: Column | str) -> Column:
    """The last supervised place, -1 if there is none. Padding cannot be told from token ids."""
    col = F.col(mask) if isinstance(mask, str) else mask
    return F.coalesce(F.array_max(F.transform(col, lambda m, i: F.when(m, i).otherwise(F.lit(-1)))), F.lit(-1))


def supervised_targets(mask: Column | str) -> Column:
    """Supervised tokens that some place predicts: all but one at place 0."""
    col = F.col(mask) if isinstance(mask, str) else mask
    return F.size(F.filter(F.slice(col, F.lit(2), F.size(col) - 1), lambda m: m))


def attends(segments: Column | str, query: Column, key: Column) -> Column:
    """Whether place ``query`` sees place ``key``: the same segment, and not after it. Padding is segment 0."""
    col = F.col(segments) if isinstance(segments, str) else segments
    return (F.get(col, query) == F.get(col, key)) & (key <= query)


def model_inputs(rows: DataFrame, tokens: str = "input_tokens", mask: str = "input_mask") -> DataFrame:
    """Adds positions and last_target of rows that hold one example each.

    Places up to the last supervised one count as the text; later places keep
    its position. A place sees the text's places that are not after it
    (``attends_unpacked``); all rows of that mask follow from ``last_target``.
    """
    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    out = rows.withColumn("last_target", last_target(mask))
    return out.withColumn("positions", F.transform(places, lambda p: F.greatest(F.least(p, F.col("last_target")), F.lit(0)).cast("int")))


def attends_unpacked(last: Column, query: Column, key: Column) -> Column:
    """Whether place ``query`` sees place ``key`` of a row whose last supervised place is ``last``."""
    return (key <= query) & (key <= last)


def attention_counts(windows: DataFrame, segments: str = "segment_ids") -> DataFrame:
    """Visible (query, key) pairs of each segment: the triangle of its length, never materialised."""
    sizes = windows.select("window_id", F.explode(segments).alias("segment")).groupBy("window_id", "segment").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("window_id", "segment", "n", (F.col("n") * (F.col("n") + 1) / 2).cast("long").alias("pairs"))


def masked_mean(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """sum(value * weight) / (sum(weight) + EPSILON), from two mergeable sums."""
    return df.groupBy(*(by or [])).agg((F.sum(F.col(value) * F.col(weight)) / (F.sum(weight) + EPSILON)).alias("mean"), F.sum(weight).alias("weight"))
