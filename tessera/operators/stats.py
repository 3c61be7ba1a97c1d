"""Length, retention, mix and fill statistics of an encoded corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETENTION = (2048, 4096, 8192, 16384)


def percentiles(df: DataFrame, column: str, points: tuple[float, ...] = (0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """One row of exact percentiles p50, p75, ..."""
    return df.agg(*[F.percentile(column, p).alias(f"p{round(p * 100)}") for p in points])


#: Rank error of a sketch with this k, for 99 % of queries, by the published bound.
SKETCH_K, SKETCH_ERROR = 400, 0.0105


def sketches(df: DataFrame, column: str, by: str, k: int = SKETCH_K) -> DataFrame:
    """(by, sketch, n): a mergeable quantile summary of each shard, which can be kept and merged with those of later shards."""
    return df.groupBy(by).agg(F.kll_sketch_agg_bigint(F.col(column).cast("long"), k).alias("sketch"), F.count(column).alias("n"))


def sketched_percentiles(kept: DataFrame, points: tuple[float, ...] = (0.5, 0.75, 0.9, 0.99), k: int = SKETCH_K) -> DataFrame:
    """One row of percentiles p50, p75, ... of all rows that kept sketches are of, within SKETCH_ERROR in rank."""
    merged = kept.agg(F.kll_merge_agg_bigint("sketch", k).alias("all"))
    return merged.select(*[F.kll_sketch_get_quantile_bigint("all", F.lit(p)).alias(f"p{round(p * 100)}") for p in points])


def retention(df: DataFrame, column: str, limits: tuple[int, ...] = RETENTION) -> DataFrame:
    """Rows and share within each limit, in one pass over the rows."""
    sums = df.agg(F.count(column).alias("n"), *[F.count_if(F.col(column) <= x).alias(f"k{x}") for x in limits])
    rows = F.array(*[F.struct(F.lit(x).cast("long").alias("max_length"), F.col(f"k{x}").alias("kept")) for x in limits])
    return sums.select("n", F.explode(rows).alias("r")).select("r.max_length", "r.kept", F.when(F.col("n") > 0, F.col("r.kept") / F.col("n")).alias("share"))


def mix(df: DataFrame, domain: str, kept: str) -> DataFrame:
    """Rows of each domain before and after a filter."""
    return df.groupBy(domain).agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"))


def fill(plan: DataFrame, max_length: int) -> DataFrame:
    """Windows, examples, and shares of places that hold tokens."""
    windows = plan.groupBy("window_id").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("examples"))
    return windows.agg(F.count(F.lit(1)).alias("windows"), F.sum("examples").alias("examples"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count(F.lit(1)) * max_length)).alias("fill"))
