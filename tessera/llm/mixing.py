"""Mixing sources to target weights by Sainte-Laguë apportionment.

Only DataFrame functions run here. Sizes are counted once; a source's target is
its weighted share of all words, held to ``max_repeats`` times its size, the
excess shared again by weight. Highest quotients turn targets into whole blocks
for each source, and each source's blocks into whole quotas for its shards. A
shard is a seeded deal of a source's documents of about ``shard_words`` words,
so a hot source has many shards and no task holds a source, nor all sources. In a shard, the
documents stand in seeded order on a line of words that equal blocks divide; a
seeded permutation of the blocks picks the quota.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; ties of quotients go to the source or shard that comes first;
repeated rows count as rows of their own, each with what the seeded order gives
it; a text of any length is one row of its size; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 19
MAX_REPEATS = 3


def _running(frame: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of a column over the rows before in a total order, without one task for all rows.

    Rows are saved with the range of the order that they fall in, as ranges come
    from a sample; sums within a range meet the sums of the ranges before it.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.saved(frame.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    # One row a range: bounded by the partition count.
    before = F.broadcast(totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_sum_{n}") for n in sums]))
    local = ranged.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    out = local.join(before, F.col("_part") == F.col("_p")).withColumns({n: F.col(n) + F.col(f"_sum_{n}") for n in sums})
    return out.drop("_part", "_p", *[f"_sum_{n}" for n in sums])


def _with_groups(rows: DataFrame, facts: DataFrame, group: list[str]) -> DataFrame:
    """Rows with what is known of their group, from a saved table: Spark broadcasts it by its size or splits hot groups."""
    named = facts.select(*[F.col(g).alias(f"_group_{g}") for g in group], *[c for c in facts.columns if c not in group])
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in group])
    return rows.join(scratch.saved(named, "groups"), same).drop(*[f"_group_{g}" for g in group])


def sainte_lague(votes: DataFrame, group: list[str], key: str, votes_col: str, seats_col: str) -> DataFrame:
    """Whole seats for each row by highest quotients votes / (2k - 1).

    Seats of a group are given by ``seats_col`` on each of its rows; ties go to
    the smaller key. Only quotients near the cut are made: with n rows a row
    differs from its quota by at most quota * n / seats + 2 seats, so quotients
    before that range surely win and those after it surely lose. The rest stand
    in one order of all groups, so that no group is one task.
    """
    quota = F.when(F.col("_v") > 0, F.col(votes_col) / F.col("_v") * F.col(seats_col)).otherwise(F.lit(0.0))
    reach = F.ceil(F.col("_q") * F.col("_n") / F.greatest(F.col(seats_col), F.lit(1))) + 2
    counted = votes.groupBy(*group).agg(F.sum(votes_col).alias("_v"), F.count(F.lit(1)).alias("_n"))
    ranged = (
        _with_groups(votes, counted, group)
        .withColumn("_q", quota)
        .withColumn("_lo", F.greatest(F.floor("_q") - reach, F.lit(0)))
        .withColumn("_hi", F.floor("_q") + reach)
    )
    tried = ranged.withColumn("_k", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi")))).withColumn("_less", -(F.col(votes_col) / (2 * F.col("_k") - 1)))
    placed = scratch.saved(_running(tried, [*group, "_less", key, "_k"], {"_at": F.lit(1)}), "placed")
    # A row's surely won seats stand on each of its quotients: they count once, on its first.
    facts = placed.groupBy(*group).agg(F.min("_at").alias("_begin"), F.sum(F.when(F.col("_k") == F.col("_lo") + 1, F.col("_lo"))).alias("_sure"))
    won = _with_groups(placed, facts, group).withColumn("_won", (F.col("_at") - F.col("_begin") < F.col(seats_col) - F.col("_sure")) & (F.col(votes_col) > 0))
    keep = [c for c in votes.columns if c != key and c not in group]
    return (
        won.groupBy(*group, key)
        .agg(*[F.first(c).alias(c) for c in keep], (F.first("_lo") + F.count_if("_won")).cast("long").alias("seats"))
    )


def _water_fill(sources: DataFrame, weight: Column, cap: Column) -> DataFrame:
    """Adds ``target``: weight shares of the sum of ``source_size``, none over its cap.

    Sources that reach their cap are those with the least cap for their weight.
    With them taken out in that order, the level at which the rest share rises
    as long as the next one is over its cap and falls after that: it is the
    greatest level of the pass.
    """
    weighed = sources.withColumns({"_w": weight, "_cap": cap}).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    sums = weighed.agg(F.sum("source_size").alias("words"), F.sum("_w").alias("weights")).first()
    run = _running(weighed, ["_ratio", "source_rank"], {"_capped": F.col("_cap"), "_weighed": F.col("_w")})
    level = (F.lit(sums["words"]) - F.col("_capped")) / (F.lit(sums["weights"]) - F.col("_weighed"))
    run = run.withColumn("_level", level)
    top = run.agg(F.max("_level").alias("top")).first()["top"]
    return run.withColumn("target", F.least(F.col("_cap"), F.lit(top).cast("double") * F.col("_w")).cast("double")).drop(
        "_w", "_cap", "_ratio", "_capped", "_weighed", "_level"
    )


def mix(
    documents: DataFrame,
    *,
    seed: int = 17,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    max_repeats: int = MAX_REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken.

    Weights are 1, 2, 3, repeating, in code point order of the sources.
    ``taken`` is the number of the document's words in the mix, repeats counted.
    """
    sized = documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        # Rows without an id are dealt by their texts; a null has no part in a hash.
        F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("_other"),
    )
    sized = scratch.saved(sized, "sized")  # ids, sources and sizes: texts are read once
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    # Null last, else by code point.
    ranked = _running(sums, ["_null", "source"], {"source_rank": F.lit(1)}).withColumn("source_rank", (F.col("source_rank") + 1).cast("long")).drop("_null")
    weight = ((F.col("source_rank") - 1) % 3 + 1).cast("double")
    targets = scratch.saved(_water_fill(ranked, weight, (F.col("source_size") * max_repeats).cast("double")), "targets")
    # Targets add up to whole words but for rounding: as whole words, reruns agree on the blocks.
    words = round(targets.agg(F.sum("target").alias("s")).first()["s"] or 0)
    seats = (2 * words + block_words) // (2 * block_words)
    per_source = sainte_lague(targets.withColumns({"_one": F.lit(1), "_seats": F.lit(seats).cast("long")}), ["_one"], "source_rank", "target", "_seats")
    full = F.col("source_size") * max_repeats
    words = F.when(F.col("target") >= full, full).otherwise(F.least(F.col("seats") * block_words, full)).cast("long")
    per_source = (
        per_source.withColumn("_words", words)
        .withColumn("_times", F.when(F.col("source_size") > 0, F.floor(F.col("_words") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("_rest", F.round((F.col("_words") - F.col("_times") * F.col("source_size")) / block_words).cast("long"))
        .withColumn("_shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words))
        .select("source", "source_rank", "source_size", "target", "_times", "_rest", "_shards")
    )
    per_source = scratch.saved(per_source, "per-source")

    # A source's facts are a few numbers of a saved table: Spark broadcasts it by its size or splits a hot source.
    dealt = (
        sized.join(per_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .drop("_s")
        .withColumn("_order", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_other")))
        .withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("_order")), F.col("_shards")))
    )
    line = Window.partitionBy("source_rank", "_shard").orderBy("_order", "doc_id", "size")
    shard_sizes = scratch.saved(dealt.groupBy("source_rank", "_shard", "_rest").agg(F.sum("size").alias("_shard_size")), "shards")
    quotas = (
        sainte_lague(shard_sizes, ["source_rank"], "_shard", "_shard_size", "_rest")
        .select(F.col("source_rank").alias("_r"), F.col("_shard").alias("_h"), "_shard_size", "seats")
    )
    placed = dealt.withColumn(
        "_from", F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).join(quotas, (F.col("source_rank") == F.col("_r")) & (F.col("_shard") == F.col("_h")), "left")

    # Blocks of a shard: a power of two, so that odd multipliers permute them.
    bits = F.greatest(F.round(F.log2(F.greatest(F.col("_shard_size"), F.lit(1)) / block_words)), F.lit(0)).cast("int")
    blocks = placed.withColumn("_bits", bits).withColumn("_blocks", F.expr("shiftleft(1L, _bits)"))
    chosen = F.least(F.round(F.col("seats") * block_words * F.col("_blocks") / F.greatest(F.col("_shard_size"), F.lit(1))).cast("long"), F.col("_blocks"))
    key = F.xxhash64(F.lit(seed + 2), F.col("source_rank"), F.col("_shard"))
    blocks = (
        blocks.withColumn("_chosen", chosen)
        .withColumn("_odd", F.pmod(key, F.lit(1 << 20)).bitwiseOR(F.lit(1)))
        .withColumn("_shift", F.pmod(F.xxhash64(key), F.lit(1 << 20)))
    )
    extra = F.expr(
        """case when size = 0 or _chosen = 0 then 0L else aggregate(
             sequence(_from * _blocks div _shard_size, (_from + size - 1) * _blocks div _shard_size), 0L,
             (n, b) -> n + case when ((((b * _odd + _shift) & (_blocks - 1))
                                       ^ (((b * _odd + _shift) & (_blocks - 1)) >> cast((_bits + 1) div 2 as int)))
                                      * _odd & (_blocks - 1)) < _chosen
               then least(_from + size, ((b + 1) * _shard_size + _blocks - 1) div _blocks)
                    - greatest(_from, (b * _shard_size + _blocks - 1) div _blocks)
               else 0L end) end"""
    )
    return blocks.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_times") * F.col("size") + extra).cast("long").alias("taken")
    )
