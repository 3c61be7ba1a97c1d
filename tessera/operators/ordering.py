"""First-N, splits, shuffles, epochs and batches over an explicit order.

DataFrames have no row order, so every operator takes the key that gives one.
Draws are md5 hashes of seed and id: they do not depend on partitioning.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.sources import workspace


def draw(seed: int, *parts: Column) -> Column:
    """32 pseudo-random bits of seed and parts, equal in any engine with md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("long")


def _nth(df: DataFrame, order: list[str], places: list[int]) -> dict[int, Row]:
    """The rows at some places of an order, of which only the ordering columns are moved."""
    found = numbered(df.select(*order), order).where(F.col("position").isin(places)).collect()
    return {r["position"]: r for r in found}


def _at_most(order: list[str], row: Row) -> Column:
    """Whether a row is not after another in an order with nulls first; the last column tells rows apart."""
    out = F.lit(True)
    for name in reversed(order):
        col, value = F.col(name), row[name]
        before = F.lit(False) if value is None else col.isNull() | (col < F.lit(value))
        out = before | (col.eqNullSafe(F.lit(value)) & out)
    return F.coalesce(out, F.lit(False))


def first_n(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """The first n rows by key, exactly n where there are as many; None keeps all.

    Rows are filtered by the n-th key, not merged in one task. Rows that share
    that key go by a hash of all their columns, and are numbered if not all fit.
    """
    if n is None or n <= 0:
        return df if n is None else df.limit(0)
    last = _nth(df, [key], [n - 1])
    if not last:
        return df
    upto = df.where(_at_most([key], last[n - 1]))
    tied = F.col(key).eqNullSafe(F.lit(last[n - 1][key]))
    counts = upto.agg(F.count(F.lit(1)).alias("upto"), F.count_if(tied).alias("tied")).first()
    if counts["upto"] == n:
        return upto
    same = upto.where(tied).withColumn("_tie", F.xxhash64(F.to_json(F.struct("*"))))
    fit = numbered(same, ["_tie"], "_nth").where(F.col("_nth") < n - counts["upto"] + counts["tied"])
    return upto.where(~tied).unionByName(fit.drop("_tie", "_nth"))


def split(df: DataFrame, fraction: float, key: str, seed: int = 42, eval_cap: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(train, eval): eval has exactly ceil(n * fraction) rows, then at most ``eval_cap``; a zero fraction has none.

    Eval has the least draws. Both halves are filters by the last draw of eval,
    of which only draws and keys were sorted; ``key`` tells rows apart.
    """
    if not fraction:
        return df, None
    drawn = df.withColumn("_draw", draw(seed, F.col(key)))
    order = ["_draw", key]
    # Draws and keys are read from the corpus once, for the count and for the places.
    draws = workspace.saved(drawn.select(*order), "draws")
    size = math.ceil(draws.count() * fraction)
    if size == 0:
        return df, df.limit(0)
    capped = size if eval_cap is None else min(size, eval_cap)
    last = _nth(draws, order, [size - 1, capped - 1])
    train = drawn.where(~_at_most(order, last[size - 1])).drop("_draw")
    return train, drawn.where(_at_most(order, last[capped - 1])).drop("_draw")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds order_key, a seeded permutation; with an epoch column, another one for each epoch."""
    parts = [F.col("epoch"), F.col(key)] if "epoch" in df.columns else [F.col(key)]
    return df.withColumn("order_key", draw(seed, *parts))


def repeated(df: DataFrame, epochs: int) -> DataFrame:
    """Each row once for each epoch; order by (epoch, key) afterwards."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 1 else df.withColumn("epoch", F.lit(0))


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Dense positions from 0 in a total order, without one task for all rows; for narrow rows, which are saved once.

    Rows are range-partitioned by the order; positions are the rank within a
    partition plus the sizes of the partitions before, of which the driver sees
    one number each. Ranges come from a sample that another run would draw
    anew, so rows are saved with their range: ranks and sizes have to agree.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = workspace.saved(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row a partition: bounded by the partition count.
    return local.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_part", "_at", "_p", "_before")


#: Rounds of ``permuted``: each row is swapped or not this often.
SWAPS = 32


def _keys(seed: int, n: int) -> list[int]:
    """One point of reflection a round, from md5 as ``draw`` has it."""
    return [int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16) % n for k in range(SWAPS)]


def permuted(position: Column, n: int, seed: int, *, back: bool = False) -> Column:
    """A seeded permutation of the positions 0 to n - 1, of any n, without a sort or an exchange; ``back`` inverts it.

    A round pairs each position with its mirror image about a point and swaps
    the pair if a bit of the seed, the round and the greater of both says so. A
    round is its own inverse, so the inverse takes the rounds in reverse.
    """
    if n <= 0:
        return position
    rounds = list(enumerate(_keys(seed, n)))[:: -1 if back else 1]
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).cast("long").alias("at")) for k, at in rounds])

    def swap(x: Column, step: Column) -> Column:
        other = F.pmod(step["at"] - x, F.lit(n).cast("long"))
        bit = draw(seed, step["k"], F.greatest(x, other)) % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(steps, position.cast("long"), swap)


def in_batches(places: DataFrame, size: int) -> DataFrame:
    """Adds batch_id to rows with dense positions; the last short batch is dropped."""
    total = places.agg((F.floor(F.count(F.lit(1)) / size) * size).alias("_full"))
    return places.join(F.broadcast(total), F.col("position") < F.col("_full")).withColumn("batch_id", F.floor(F.col("position") / size)).drop("_full")


def batched(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Adds position and batch_id to consecutive groups of ``size`` rows; the last short group is dropped.

    Only the ordering columns are numbered; the rows meet their numbers in one
    exchange. Rows that the order does not tell apart stand in consecutive places.
    """
    names = [f"_o{i}" for i in range(len(order))]
    places = numbered(df.select(*[F.col(c).alias(n) for c, n in zip(order, names, strict=True)]), names)
    total = places.agg((F.floor(F.count(F.lit(1)) / size) * size).alias("_full"))
    starts = places.groupBy(*names).agg(F.min("position").alias("_start"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(order, names, strict=True)])
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    out = df.join(starts, same).withColumn("position", (F.col("_start") + rank - 1).cast("long"))
    out = out.join(F.broadcast(total), F.col("position") < F.col("_full"))
    return out.withColumn("batch_id", F.floor(F.col("position") / size)).drop("_full", "_start", *names)


def stratified(df: DataFrame, strata: str, per_stratum: int, key: str, seed: int = 42) -> DataFrame:
    """``per_stratum`` seeded rows of each stratum, with ``weight``, the rows that each stands for."""
    w = Window.partitionBy(strata).orderBy("_draw", key)
    drawn = df.withColumn("_draw", draw(seed, F.col(key))).withColumn("_rank", F.row_number().over(w))
    sizes = df.groupBy(F.col(strata).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    taken = drawn.where(F.col("_rank") <= per_stratum).join(sizes, F.col(strata).eqNullSafe(F.col("_s")))
    return taken.withColumn("weight", F.col("_n") / F.least(F.col("_n"), F.lit(per_stratum))).drop("_draw", "_rank", "_s", "_n")
