"""First-fit packing of examples into fixed windows.

A plan is made from lengths alone (some twenty bytes a row) and joined back with
the tokens. The fold is sequential by nature, but all that it carries from one
row to the next is the room left in at most ``open_windows`` windows, and two
folds that start apart soon have the same rooms. So ranges of the order are
packed side by side from guessed pools; a range whose guess differs from the
pool that the range before it left is packed again, until none differs. The
result is that of one fold over all rows, whatever the number of ranges.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, groupby
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered
from tessera.sources import workspace

LOG = logging.getLogger(__name__)
#: Lengths that one task packs at once.
RANGE_ROWS = 1 << 20
Placement = tuple[int, int, int, int]  # example index, window, segment, offset


class Packer:
    """Open windows in the order of their opening. Windows are numbered in the order they are emitted."""

    def __init__(self, max_length: int, open_windows: int = 8, room: Sequence[int] = ()):
        if open_windows < 1:
            raise ValueError("open_windows must be positive")
        self.max_length, self.open_windows = max_length, open_windows
        self.room = list(room)  # free places of each open window
        # Its members (index, length); what stood in the k-th window before counts as one, -1 - k.
        self.held: list[list[tuple[int, int]]] = [[(-1 - k, max_length - free)] for k, free in enumerate(room)]
        self.emitted = 0

    def _emit(self, at: int) -> list[Placement]:
        del self.room[at]
        members = self.held.pop(at)
        offsets = accumulate((size for _, size in members), initial=0)
        number, self.emitted = self.emitted, self.emitted + 1
        return [(index, number, segment, offset) for segment, ((index, _), offset) in enumerate(zip(members, offsets, strict=False), 1)]

    def add(self, index: int, size: int) -> list[Placement]:
        """Places an example in the first window with room; gives the window that had to leave, if any: the fullest, then oldest."""
        if size > self.max_length:
            raise ValueError(f"example {index} has {size} tokens; a window holds {self.max_length}")
        fitting = [at for at, room in enumerate(self.room) if size <= room]
        left: list[Placement] = []
        if not fitting:
            if len(self.room) >= self.open_windows:
                left = self._emit(self.room.index(min(self.room)))
            fitting = [len(self.room)]
            self.room.append(self.max_length)
            self.held.append([])
        self.room[fitting[0]] -= size
        self.held[fitting[0]].append((index, size))
        return left

    def flush(self) -> list[Placement]:
        return [placed for _ in range(len(self.room)) for placed in self._emit(0)]


def fold(sizes: Iterable[tuple[int, int]], max_length: int, open_windows: int = 8) -> Iterator[Placement]:
    packer = Packer(max_length, open_windows)
    for index, size in sizes:
        yield from packer.add(index, size)
    yield from packer.flush()


@dataclass(frozen=True)
class Walk:
    """How a range was packed: what its neighbours have to know of it."""

    entry: list[int]  # rooms of the windows that it began with
    rooms: list[int]  # rooms of the windows that it left open
    members: list[int]  # how many members each of these has, of this range or as one from before
    origin: list[int]  # which window of the entry each of these was, or -1
    emitted: int  # windows that left the pool
    left_at: list[int]  # when each window of the entry left, or -1

    @staticmethod
    def of(packer: Packer, entry: list[int], placed: list[Placement]) -> Walk:
        left = {-1 - index: window for index, window, *_ in placed if index < 0}
        firsts = [members[0][0] for members in packer.held]
        return Walk(entry, packer.room, [len(m) for m in packer.held], [-1 - i if i < 0 else -1 for i in firsts], packer.emitted, [left.get(k, -1) for k in range(len(entry))])


#: The fields of a walk that a task hands back.
WALKED = ("rooms", "members", "origin", "emitted", "left_at")


@dataclass
class _Open:
    """A window on its way through the ranges."""

    members: int
    number: int = -1


def chain(walks: list[Walk]) -> list[dict[str, Any]]:
    """For each range: its entry, its first window number, members and numbers of the windows it began with, numbers of those it left open."""
    out, slots, first = [], [], 0
    for walk in walks:
        found = {"entry": walk.entry, "first": first, "members": [w.members for w in slots], "began": slots}
        for window, at in zip(slots, walk.left_at, strict=True):
            if at >= 0:
                window.number = first + at
        after = []
        for origin, members in zip(walk.origin, walk.members, strict=True):
            window = slots[origin] if origin >= 0 else _Open(0)
            window.members += members - (origin >= 0)
            after.append(window)
        out.append(found | {"left": after})
        slots, first = after, first + walk.emitted
    return [x | {"began": [w.number for w in x["began"]], "left": [w.number for w in x["left"]]} for x in out]


def _walk(sizes: list[int], max_length: int, open_windows: int, entry: list[int], last: bool) -> tuple[Packer, list[Placement]]:
    packer = Packer(max_length, open_windows, entry)
    placed = [p for index, size in enumerate(sizes) for p in packer.add(index, size)]
    return packer, placed + (packer.flush() if last else [])


def _placements(sizes: list[int], max_length: int, open_windows: int, facts: dict[str, Any], last: bool) -> list[Placement]:
    """The rows of a range with their numbers in the whole order."""
    packer, placed = _walk(sizes, max_length, open_windows, facts["entry"], last)
    out = [(index, facts["first"] + window, segment, offset) for index, window, segment, offset in placed]
    for number, members in zip(facts["left"], packer.held, strict=True):
        offsets = accumulate((size for _, size in members), initial=0)
        out += [(index, number, segment, offset) for segment, ((index, _), offset) in enumerate(zip(members, offsets, strict=False), 1)]
    # Windows from before have more members than the one that stands for them here.
    before = {number: n - 1 for number, n in zip(facts["began"], facts["members"], strict=True)}
    return [(index, number, segment + before.get(number, 0), offset) for index, number, segment, offset in out if index >= 0]


def _agreed(rows: DataFrame, n: int, max_length: int, open_windows: int) -> tuple[list[Walk], list[int]]:
    """How each of n ranges is packed, and how many were packed in each round. The driver sees a few numbers a range."""

    def walked(entries: dict[int, list[int]]) -> dict[int, Walk]:
        def run(key: tuple, table: pa.Table) -> pa.Table:
            at, entry = key[0].as_py(), entries[key[0].as_py()]
            packer, placed = _walk(table.sort_by("position")["length"].to_pylist(), max_length, open_windows, entry, at == n - 1)
            walk = Walk.of(packer, entry, placed)
            fields = [("range", pa.int64()), *[(f, pa.int64() if f == "emitted" else pa.list_(pa.int64())) for f in WALKED]]
            return pa.table({"range": [at], **{f: [getattr(walk, f)] for f in WALKED}}, schema=pa.schema(fields))

        some = rows if len(entries) == n else rows.where(F.col("range").isin(list(entries)))
        found = some.groupBy("range").applyInArrow(run, "range long, rooms array<long>, members array<long>, origin array<long>, emitted long, left_at array<long>")
        # Without rows there is one range, and it has none.
        nothing = {k: Walk(entry, entry, [1] * len(entry), list(range(len(entry))), 0, [-1] * len(entry)) for k, entry in entries.items()}
        return nothing | {r["range"]: Walk(entries[r["range"]], *[r[f] for f in WALKED]) for r in found.collect()}

    walks, rounds = walked({k: [] for k in range(n)}), [n]
    while differ := {k: walks[k - 1].rooms for k in range(1, n) if walks[k].entry != walks[k - 1].rooms}:
        walks |= walked(differ)
        rounds.append(len(differ))
    LOG.info("packed %s ranges in %d rounds", "+".join(map(str, rounds)), len(rounds))
    return [walks[k] for k in range(n)], rounds


def plan(
    df: DataFrame, max_length: int, *, id_col: str, order: list[str], length_col: str = "unpadded_length", open_windows: int = 8, shards: int | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(id, window_id, segment, offset, length): where each example goes. window_id is dense from 0.

    The result is that of one fold over all rows in order, in ranges of
    ``range_rows`` at once. With two ``shards`` or more, as many contiguous
    parts of the order are packed apart, each with a pool of its own.
    """
    if open_windows < 1:
        raise ValueError("open_windows must be positive")
    # Ids, order and lengths are all that planning reads, several times over; encoding runs once for it.
    lengths = workspace.saved(df.select(id_col, *[c for c in order if c != id_col], F.col(length_col).cast("int").alias("length")), "lengths")
    total = max(1, lengths.count())
    apart = shards is not None and shards > 1
    n = shards if apart else -(-total // range_rows)
    part = F.floor(F.col("position") * n / F.lit(total)) if apart else F.floor(F.col("position") / range_rows)
    rows = numbered(lengths, order).select(F.col(id_col), "position", "length", part.cast("long").alias("range"))
    if apart or n == 1:
        # Nothing came before a range: there is no pool to agree on.
        facts = [{"entry": [], "first": 0, "members": [], "began": [], "left": []}] * n
    else:
        rows = workspace.saved(rows, "ranges")
        facts = chain(_agreed(rows, n, max_length, open_windows)[0])
    kind = df.schema[id_col].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, at = table.sort_by("position"), key[0].as_py()
        placed = _placements(table["length"].to_pylist(), max_length, open_windows, facts[at], apart or at == n - 1)
        take = pa.array([p[0] for p in placed], pa.int64())
        numbers = {name: pa.array([p[i] for p in placed], t) for name, i, t in (("window_id", 1, pa.int64()), ("segment", 2, pa.int32()), ("offset", 3, pa.int32()))}
        return pa.table({id_col: table[id_col].take(take), "length": table["length"].take(take), "range": table["range"].take(take), **numbers})

    packed = rows.groupBy("range").applyInArrow(run, f"{id_col} {kind}, length int, range long, window_id long, segment int, offset int")
    names = [id_col, "length", "window_id", "segment", "offset"]
    if not apart:
        return packed.select(*names)
    counts = packed.groupBy("range").agg((F.max("window_id") + 1).alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("range").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return packed.join(F.broadcast(starts), F.col("range") == F.col("_s")).withColumn("window_id", F.col("window_id") + F.col("_before")).select(*names)


def assemble(planned: DataFrame, examples: DataFrame, max_length: int, *, id_col: str, pad_id: int = 0) -> DataFrame:
    """One row a window: input_tokens, input_mask, positions, segment_ids, each of max_length.

    Tokens never pass through Python. The first token of a segment is not supervised.
    """
    joined = planned.join(examples.select(id_col, "input_ids", "spans"), id_col)
    members = F.array_sort(F.collect_list(F.struct("segment", "length", "input_ids", "spans")))
    windows = joined.groupBy("window_id").agg(members.alias("m"))
    each = lambda f: F.flatten(F.transform("m", f))
    places = lambda s: F.sequence(F.lit(0), s["length"] - 1)
    mask = lambda s: F.transform(places(s), lambda p: (p > 0) & F.exists(s["spans"], lambda x: (p >= x["start"]) & (p < x["end"])))
    fill = lambda c, v: F.slice(F.concat(c, F.array_repeat(F.lit(v), max_length)), 1, max_length)
    return windows.select(
        "window_id",
        fill(each(lambda s: s["input_ids"]), pad_id).alias("input_tokens"),
        fill(each(mask), False).alias("input_mask"),
        fill(each(places), 0).alias("positions"),
        fill(each(lambda s: F.transform(places(s), lambda p: s["segment"])), 0).alias("segment_ids"),
        F.size("m").alias("n_segments"),
    )


def batches(windows: DataFrame, size: int) -> DataFrame:
    """Adds batch_id to full batches of consecutive windows; window_id is dense, so no ranking is needed."""
    total = windows.agg((F.floor(F.count(F.lit(1)) / size) * size).alias("_full"))
    return windows.join(F.broadcast(total), F.col("window_id") < F.col("_full")).withColumn("batch_id", F.floor(F.col("window_id") / size)).drop("_full")


FIELDS = ("input_tokens", "input_mask", "positions", "segment_ids")


#: Batches in one file of a rank.
FILE_BATCHES = 64


def write_ranks(batched: DataFrame, path: str, ranks: int, *, fields: tuple[str, ...] = FIELDS, order: str = "window_id", file_batches: int = FILE_BATCHES) -> None:
    """Batches for trainers that read side by side: batch k goes to rank k % ranks, in files of ``file_batches`` batches.

    Rows go from executors to files. ``manifest.json``, written last, has what a
    reader needs to find its k-th batch without looking into other files.
    """
    spark = batched.sparkSession
    rank, file = (F.col("batch_id") % ranks).cast("int"), F.floor(F.col("batch_id") / (ranks * file_batches)).cast("int")
    rows = batched.select("batch_id", order, *fields, rank.alias("rank"), file.alias("file"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # All rows of a file are in one task: at most file_batches batches.
    rows.repartition(n, "rank", "file").sortWithinPartitions("rank", "file", "batch_id", order).write.partitionBy("rank", "file").parquet(path)
    total = (spark.read.parquet(path).agg(F.max("batch_id")).first()[0] + 1) if not spark.read.schema("batch_id long").parquet(path).isEmpty() else 0
    manifest = json.dumps({"ranks": ranks, "file_batches": file_batches, "batches": total, "fields": list(fields)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


class RankReader:
    """One rank's batches, the same on every pass, read file by file in the trainer's own process.

    ``start`` batches of the rank are passed over, by the names of files alone
    where these are whole files. All ranks in turn give the sequence of one reader.
    """

    def __init__(self, path: str, rank: int, start: int = 0):
        self.store, self.root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
        self.rank, self.start = rank, start
        (name,) = [f.path for f in self.store.get_file_info(pafs.FileSelector(f"{self.root}/manifest")) if f.base_name.startswith("part-")]
        self.manifest = json.loads(self.store.open_input_stream(name).read())

    def __len__(self) -> int:
        ranks = self.manifest["ranks"]
        return max(0, (self.manifest["batches"] - self.rank + ranks - 1) // ranks - self.start)

    def __iter__(self) -> Iterator[dict[str, Any]]:
        size, ranks = self.manifest["file_batches"], self.manifest["ranks"]
        for file in range(self.start // size, -(-(self.start + len(self)) // size)):
            parts = self.store.get_file_info(pafs.FileSelector(f"{self.root}/rank={self.rank}/file={file}"))
            (name,) = [f.path for f in parts if f.base_name.startswith("part-")]
            table = pq.read_table(name, filesystem=self.store, columns=["batch_id", *self.manifest["fields"]], partitioning=None)
            ids = table["batch_id"].to_numpy()
            cuts = [*np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), len(ids)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if (ids[low] - self.rank) // ranks >= self.start:
                    rows = table.slice(low, high - low)
                    columns = {f: rows[f].combine_chunks() for f in self.manifest["fields"]}
                    yield {f: c.flatten().to_numpy(zero_copy_only=False).reshape(high - low, -1) for f, c in columns.items()}


class BatchReader:
    """Batches as arrays of (batch, place) by field, the same on every pass; one partition at a time comes to the driver."""

    def __init__(self, batched: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "window_id"):
        self.fields = fields
        self.rows = batched.select("batch_id", order, *fields).orderBy("batch_id", order)

    def __iter__(self) -> Iterator[dict[str, Any]]:
        for _, rows in groupby(self.rows.toLocalIterator(prefetchPartitions=True), key=lambda r: r["batch_id"]):
            batch = list(rows)
            yield {f: np.array([r[f] for r in batch]) for f in self.fields}
