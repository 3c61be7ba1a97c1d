"""Uniform shuffles into shards of exact sizes by a hypergeometric communication matrix.

Under a uniform permutation, the numbers of rows that go from parts of the input
to cells of the output follow a multivariate hypergeometric law. The matrix of
these numbers is drawn first; then each part permutes its rows and deals them
out by its line of the matrix, rows are exchanged by cell, and each cell
permutes what it got. Every permutation is equally likely, and each cell gets
its size exactly.

A part is at most ``part_rows`` rows of one input partition, a cell at most
``cell_rows`` neighbouring slots of one shard, so no task holds a shard or a hot
input partition, whatever the rows are. No task draws the whole matrix either:
it is split like a tree over the parts, with a seeded draw in each node, and a
part walks from the root to its own line. What all tasks get is one count a part.

Defined results: rows are dealt as they come, so null ids, null or repeated
texts and repeated rows are rows like others, each with a shard and slot of its
own; equal texts are not kept together; ``size`` of a null text is 8 and its
``text_crc32`` that of no bytes, 0; a text of any length is one row; with fewer
rows than shards the last shards are empty; an empty table gives no rows; other
columns may bear any name. Rows and their places are saved first, so reruns of
lost tasks agree; another run agrees if it reads the same input partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import rows, scratch

SHARDS = 24
PART_ROWS = 1 << 20
CELL_ROWS = 1 << 18
#: The library's own sampler takes smaller populations only.
LARGE = 10**9
#: Standard deviations on both sides of the mode that hold all but 1e-20 of a draw.
REACH = 10


def _large_draw(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """One hypergeometric draw by inversion around the mode, for populations of any size."""
    total = good + bad
    mode = (take + 1) * (good + 1) // (total + 2)
    spread = (take * (good / total) * (bad / total) * (total - take) / max(total - 1, 1)) ** 0.5
    reach = int(REACH * spread) + 64
    low, high = max(0, take - bad, mode - reach), min(take, good, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (take - k)) - np.log((k + 1) * (bad - take + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, take: np.ndarray) -> np.ndarray:
    """For each place, how many of ``take`` rows drawn without replacement are among the good ones."""
    out = np.zeros(len(good), dtype=np.int64)
    large = good + bad >= LARGE
    out[~large] = rng.hypergeometric(good[~large], bad[~large], take[~large])
    for i in np.flatnonzero(large):
        out[i] = _large_draw(rng, int(good[i]), int(bad[i]), int(take[i]))
    return out


def split(rng: np.random.Generator, totals: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` rows, drawn without replacement, come from each of some groups of given sizes.

    Halves of the groups share the draw first, then their halves: each level is
    one call for all its nodes.
    """
    ends = np.concatenate([[0], np.cumsum(totals)])
    low, high, taken = np.array([0]), np.array([len(totals)]), np.array([take])
    while len(low) and (high - low).max() > 1:
        middle = (low + high) // 2
        left = hypergeometric(rng, ends[middle] - ends[low], ends[high] - ends[middle], taken)
        halves = np.stack([low, middle], 1), np.stack([middle, high], 1), np.stack([left, taken - left], 1)
        low, high, taken = (h.ravel() for h in halves)
        there = high > low
        low, high, taken = low[there], high[there], taken[there]
    return taken


class Matrix:
    """Lines of the communication matrix of parts and cells, drawn when asked for."""

    def __init__(self, seed: int, parts: np.ndarray, cells: np.ndarray) -> None:
        self.seed, self.cells = seed, cells
        self.ends = np.concatenate([[0], np.cumsum(parts)])
        #: The nodes from the root to the last line: neighbours share most of theirs.
        self._path: list[tuple[int, int, np.ndarray]] = [(0, len(parts), cells)]

    def line(self, part: int) -> np.ndarray:
        """How many rows of a part go to each cell."""
        while not self._path[-1][0] <= part < self._path[-1][1]:
            self._path.pop()
        low, high, totals = self._path[-1]
        while high - low > 1:
            middle = (low + high) // 2
            left = split(np.random.default_rng([self.seed, low, high]), totals, int(self.ends[middle] - self.ends[low]))
            low, high, totals = (low, middle, left) if part < middle else (middle, high, totals - left)
            self._path.append((low, high, totals))
        return totals


def even(total: int, n: int) -> np.ndarray:
    """A total as n sizes that differ by one at most, larger ones first."""
    return total // n + (np.arange(n) < total % n)


def cells_of(total: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of all shards: their shards, first slots and sizes."""
    owners, firsts, sizes = [], [], []
    for shard, size in enumerate(even(total, shards)):
        own = even(int(size), max(1, -(-int(size) // cell_rows)))
        owners.append(np.full(len(own), shard))
        firsts.append(np.cumsum(own) - own)
        sizes.append(own)
    return np.concatenate(owners), np.concatenate(firsts), np.concatenate(sizes)


def _dealer(seed: int, parts: np.ndarray, cells: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The cell of each row from its part and its place there."""
    matrix, known = Matrix(seed, parts, cells), {}

    def deal(part: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(part), dtype=np.int64)
        for p in np.unique(part):
            if p not in known:
                known.clear()
                known[p] = np.repeat(np.arange(len(cells), dtype=np.int32), matrix.line(int(p)))
                np.random.default_rng([seed, 1, int(p)]).shuffle(known[p])
            here = part == p
            out[here] = known[p][place[here]]
        return out

    return deal


def deal(frame: DataFrame, shards: int = SHARDS, *, seed: int = 29, part_rows: int = PART_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All rows as ``row``, with ``shard``, ``slot`` (from 0 in its shard) and ``cell``: a uniform shuffle, shards at most one row apart."""
    spark = frame.sparkSession
    # The input partition stands in the upper bits of the number, the place in it in the lower 33.
    counted = frame.select(rows.as_struct(frame)).withColumn("_at", F.monotonically_increasing_id())
    counted = counted.select("row", F.shiftright("_at", 33).alias("_of"), F.expr("_at & 8589934591L").alias("_in"))
    saved = scratch.saved(counted.select("row", "_of", F.expr(f"_in div {part_rows}").alias("_block"), F.expr(f"_in % {part_rows}").alias("_place")), "rows")
    # One count for each part of up to part_rows rows.
    found = saved.groupBy("_of", "_block").count().orderBy("_of", "_block").collect()
    numbers = {(r["_of"], r["_block"]): i for i, r in enumerate(found)}
    parts = np.array([r["count"] for r in found], dtype=np.int64)
    owners, firsts, sizes = cells_of(int(parts.sum()), shards, cell_rows)
    sent = spark.sparkContext.broadcast((numbers, parts, owners, firsts, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, parts, owners, firsts, sizes = sent.value
        dealer = _dealer(seed, parts, sizes)
        for batch in batches:
            of, block, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            pairs, which = np.unique(np.stack([of, block], 1), axis=0, return_inverse=True)
            part = np.array([numbers[o, b] for o, b in pairs.tolist()], dtype=np.int64)[which.ravel()]
            cell = dealer(part, place)
            new = [pa.array(part), pa.array(place), pa.array(cell), pa.array(owners[cell].astype(np.int32)), pa.array(firsts[cell].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], ["row", "_part", "_place", "cell", "shard", "_first"])

    schema = T.StructType([saved.schema["row"], *[T.StructField(n, T.LongType()) for n in ("_part", "_place", "cell")], T.StructField("shard", T.IntegerType()), T.StructField("_first", T.LongType())])
    dealt = saved.mapInArrow(run, schema)
    # A cell has cell_rows rows at most; draws order them, and place breaks the ties of draws.
    again = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed), "_part", "_place"), "_part", "_place")
    return dealt.withColumn("slot", F.col("_first") + F.row_number().over(again) - 1).select("row", "shard", "slot", "cell")


def digest(documents: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """For each document: doc_id, size, text_crc32, law, shard, slot, grown_shard. Texts are read, not moved."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = documents.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = deal(narrow, shards, **options)
    return out.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(frame: DataFrame, path: str, shards: int = SHARDS, **options: int) -> None:
    """Writes whole rows in slot order: a folder for each shard, a file for each of its cells, named in order of the cells."""
    dealt = deal(frame, shards, **options)
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Cells in order over ranges: a task writes neighbouring cells, each row's slot tells the order within.
    ordered = dealt.repartitionByRange(n, "shard", "cell", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("row.*", "shard", "slot").write.partitionBy("shard").parquet(path)
