"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's greater neighbours (large) or others (small) to its least neighbour.

    The least neighbours are saved, so that a hub's edges meet them in a plain
    exchange, which adaptive execution splits.
    """
    both = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
    low = F.least(F.min("v"), F.first("u")) if large else F.min("v")
    least = scratch.saved(both.groupBy(F.col("u").alias("_u")).agg(low.alias("m")), "least")
    joined = both.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("_u", "m"))
    out = scratch.saved(out.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("_one")).select("u", "v"), "stars")
    scratch.free(least)
    scratch.free(edges)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its component's least, from edges (u, v) of integers.

    Each round replaces the edges by fewer, shallower ones until all are stars;
    rounds grow with the logarithm of a component's size. Every table is saved,
    so that plans stay short, and freed once the next one stands.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    edges = scratch.saved(edges.groupBy("u", "v").agg(F.lit(1).alias("_one")).select("u", "v"), "edges")
    sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    before = None
    while True:
        now = edges.agg(*sums).first()
        if now["n"] == 0 or now == before:
            return edges.toDF("node", "root")
        before = now
        edges = _stars(_stars(edges, True), False)
