"""Removal of long repeated byte strings by prefix doubling over surviving positions.

A position's rank names the string of some length that starts there; equal
strings have equal ranks. Spark sorts (rank, rank at an offset) pairs of
positions, and positions whose string is unique leave. Ranks are 64-bit
fingerprints, which need no dense renumbering of all positions between rounds.

Round 0 (LENGTH / 2 bytes). Every window of LENGTH bytes is stood for by the
anchor: the position among its LENGTH / 2 + 1 half-length strings whose rank is
least. Equal windows have equal anchors at equal offsets, so a window can repeat
only if its anchor's rank does. One row stands for a run of windows with the
same anchor. Runs with a unique anchor leave; runs whose whole context, from the
first byte of the first window to the last of the last, is the context of
another run are repeated and settled.

Round 1 (CELL windows at a time). What is left is cut into cells of windows at
equal offsets from their anchor. A cell whose bytes common to all its windows
are unique leaves; one whose bytes of any of its windows recur is settled.

Round 2 (LENGTH bytes). Single windows are ranked by the pair (rank of the first
half, rank of the second half), 128 bits in all: the last doubling.

In each round a key is counted with map-side sums, so hot strings meet as one
row from each task; of rows that are alike one goes on for all. Rows get their
keys' counts back by two joins: keys with at least one in HOT of all rows are at
most HOT and go to every task, the rows of the others are shuffled.

The same rounds run over words (Unit ``WORDS``): they find passages of over 50
words that stand anywhere else, also where these have fewer than LENGTH bytes.
Such passages are counted, not removed. Below, a unit's length, anchor, reach and
cell stand for LENGTH, LENGTH / 2, the offsets of windows around an anchor and CELL.

Matches never cross documents; the same document may hold both occurrences.
Defined results: a null text has no bytes; texts under LENGTH bytes are never
touched; texts of many scan blocks are looked at whole, a block of windows at a
time; rows equal in id and text count as copies of each other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as b
from tessera.llm import scratch

LENGTH = 400
PASSAGE_WORDS = 51
HOT = 1000
_RUNS = 1 << 14
_STARTS = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Unit:
    """What windows are made of: bytes, or words named by their hashes."""

    name: str
    length: int  # of a window
    anchor: int  # of the strings among which a window's anchor is chosen
    cell: int  # offsets from the anchor in a cell
    kind: type  # of an item
    least_bytes: int  # of a text with a window

    @property
    def reach(self) -> int:
        """The furthest that a window starts before its anchor."""
        return self.length - self.anchor

    def read(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of texts and the first item of each text (n + 1)."""
        if self.kind is np.uint8:
            return data, at
        starts, ends, first = b.words(data, at)
        return b.hashes(data, starts, ends), first

    def prefix(self, items: np.ndarray) -> np.ndarray:
        return b.prefix_hash(items) if self.kind is np.uint8 else b.prefix_of(b.mix(items))


BYTES = Unit("bytes", LENGTH, LENGTH // 2, 16, np.uint8, LENGTH)
WORDS = Unit("words", PASSAGE_WORDS, 11, 8, np.uint64, 2 * PASSAGE_WORDS - 1)


def _least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of keys[i : i + width] for each i that has as many."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    blocks = np.concatenate([keys, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(items: np.ndarray, at: np.ndarray, unit: Unit = BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window, windows - 1, anchor - first, anchor rank, context rank) of runs, a block of windows at a time.

    Windows and anchors count from the start of their text.
    """
    n = len(items) - unit.length + 1
    for low in range(0, max(0, n), _STARTS):
        # One window before the block shows whether its first run is new, and a run has at most reach + 1 windows.
        high = min(low + _STARTS, n)
        begin, stop = max(0, low - 1), min(high + unit.reach + 1, n)
        prefix = unit.prefix(items[begin : stop + unit.length - 1])
        places = np.arange(stop - begin + unit.reach)
        rank = b.span_hash(prefix, places, places + unit.anchor)
        keys = (rank & ~_PLACE) | places.astype(np.uint64)
        starts = np.arange(stop - begin)
        anchor = (_least_in_windows(keys, unit.reach + 1) & _PLACE).astype(np.int64)
        row = np.searchsorted(at, starts + begin, side="right") - 1
        inside = starts + begin + unit.length <= at[row + 1]
        starts, anchor, row = starts[inside], anchor[inside], row[inside]
        if not len(starts):
            continue
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        i = np.flatnonzero(new)
        j = np.concatenate([i[1:], [len(starts)]]) - 1
        own = (starts[i] + begin >= low) & (starts[i] + begin < high)
        i, j = i[own], j[own]
        first, last, a = starts[i], starts[j], anchor[i]
        context = b.mix(b.span_hash(prefix, first, last + unit.length) ^ b.mix((a - first).astype(np.uint64)))
        yield row[i], first - (at[row[i]] - begin), last - first, a - first, b.mix(rank[a]), context


def _scan(documents: DataFrame, unit: Unit) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, at in b.chunks(batch.column(2)):
                for row, first, more, shift, rank, context in runs(*unit.read(data, at), unit):
                    take = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(take), batch.column(1).take(take), pa.array(first), pa.array(more.astype(np.int32)),
                            pa.array(shift.astype(np.int32)), pa.array(rank.view(np.int64)), pa.array(context.view(np.int64)),
                        ],
                        names=["doc_id", "mark", "first", "more", "shift", "core", "outer"],
                    )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, mark long, first long, more int, shift int, core long, outer long")


def _with_keys(rows: DataFrame, keys: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Rows joined with saved keys, whose ``_n`` is the number of rows of each key; hot rows are not shuffled."""
    total = rows.count()
    hot = F.col("_n") * HOT >= total
    match = reduce(lambda x, y: x & y, [F.col(r) == F.col(k) for r, k in on.items()])
    # Keys that hold a HOT-th of all rows each are HOT at most: a proven bound for the broadcast.
    few = F.broadcast(keys.where(hot))
    spread = rows.join(few, match, "left_anti").join(keys.where(~hot), match, how)
    return rows.join(few, match, how).union(spread).drop(*on.values(), "_n")


def _told_apart(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(settled, going): rows repeated as a whole, and one row for each kind of the rest.

    Rows have ``core``, the rank of what their windows have in common, and
    ``outer``, that of all their bytes (null if they have less than their kind).
    Unique cores leave. ``going`` has ``alone``: whether the row stands for itself
    only. The saved ``rows`` are freed.
    """
    cores = (
        rows.groupBy(F.col("core").alias("_core"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("outer").alias("_low"), F.max("outer").alias("_high"), F.count("outer").alias("_full"))
        .where("_n > 1")
        .select("_core", "_n", (~F.coalesce((F.col("_low") == F.col("_high")) & (F.col("_full") == F.col("_n")), F.lit(False))).alias("_mixed"))
    )
    own = list(rows.columns)
    left = scratch.saved(_with_keys(rows, scratch.saved(cores, f"{name}-cores"), {"core": "_core"}), name)
    scratch.free(rows)
    mixed = left.where("_mixed").select(own)
    kinds = scratch.saved(
        mixed.groupBy("core", F.coalesce("outer", F.xxhash64("doc_id", "mark", "first", "core")).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*[c for c in own if c not in ("core", "outer")])).alias("_one"), F.first("outer").alias("outer")),
        f"{name}-kinds",
    )
    again = kinds.where("n > 1 and outer is not null").select(F.col("core").alias("_core"), F.col("outer").alias("_outer"), F.col("n").alias("_n"))
    settled = left.where("not _mixed").select(own).union(_with_keys(mixed, again, {"core": "_core", "outer": "_outer"}, "left_semi").select(own))
    going = kinds.select("core", "_one.*", ((F.col("n") == 1) | F.col("outer").isNull()).alias("alone"))
    return settled, going


def _with_items(going: DataFrame, documents: DataFrame, unit: Unit) -> DataFrame:
    """Adds ``items``, those around the anchor, and ``at``, the place of the first. A text is read once for all its runs."""
    wanted = going.select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.struct("first", "more", "shift", "core", "alone").alias("_run")
    ).groupBy("_id", "_mark").agg(F.collect_list("_run").alias("_runs"))
    joined = wanted.join(documents, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(unit.kind).itemsize
        for batch in batches:
            for i, j, data, ends in b.chunks(batch.column(2)):
                items, begin = unit.read(data, ends)
                raw, lists = items.tobytes(), batch.column(3).slice(i, j - i)
                every, rows = lists.flatten(), np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
                for low in range(0, len(every), _RUNS):
                    some, row = every.slice(low, _RUNS), rows[low : low + _RUNS]
                    anchor = some.field(0).to_numpy() + some.field(2).to_numpy()  # first + shift
                    at = np.maximum(anchor - unit.reach, 0)
                    start, stop = begin[row] + at, np.minimum(begin[row] + anchor + unit.length, begin[row + 1])
                    cut = [raw[x:y] for x, y in zip((start * width).tolist(), (stop * width).tolist(), strict=True)]
                    take = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), *[some.field(k) for k in range(5)], pa.array(at), pa.array(cut, pa.binary())],
                        names=["doc_id", "mark", "first", "more", "shift", "core", "alone", "at", "items"],
                    )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "mark", "text", "_runs").mapInArrow(
        run, f"doc_id {kind}, mark long, first long, more int, shift int, core long, alone boolean, at long, items binary"
    )


def _lots(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """The batches in slices of runs with about a million items."""
    step = max(1, (1 << 20) // (unit.length + unit.reach))
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            yield batch.slice(low, step)


def _together(column: pa.Array, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes over the items of all runs, and where each run's items begin there and how many they are."""
    width = np.dtype(unit.kind).itemsize
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if len(column) and at[-1] > at[0] else np.zeros(0, np.uint8)
    items = data if unit.kind is np.uint8 else np.frombuffer(data.tobytes(), dtype=unit.kind)
    return unit.prefix(items), (at[:-1] - at[0]) // width, np.diff(at) // width


def _cells(around: DataFrame, unit: Unit) -> DataFrame:
    """One row for each cell that a run's windows lie in.

    Cell c has the windows that start cell * c .. cell * c + cell - 1 places before
    the anchor. ``first`` and ``more`` are the run's windows in the cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches, unit):
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            prefix, base, size = _together(get["items"], unit)
            first, more, shift, core, at = (get[n].to_numpy().astype(np.int64) for n in ("first", "more", "shift", "core", "at"))
            # Offsets of each run's windows before the anchor, and the cells they lie in.
            far, near = shift, shift - more
            count = far // unit.cell - near // unit.cell + 1
            row = np.repeat(np.arange(batch.num_rows), count)
            c = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (near // unit.cell)[row]
            nearest, furthest = c * unit.cell, np.minimum(c * unit.cell + unit.cell - 1, unit.reach)
            anchor = (first + shift - at)[row]
            h_core = b.span_hash(prefix, base[row] + anchor - nearest, base[row] + anchor - furthest + unit.length)
            full = (anchor - furthest >= 0) & (anchor - nearest + unit.length <= size[row])
            low, high = np.where(full, anchor - furthest, 0), np.where(full, anchor - nearest + unit.length, 0)
            h_outer = b.span_hash(prefix, base[row] + low, base[row] + high)
            key = b.mix(core[row].view(np.uint64) ^ b.mix(c.astype(np.uint64) + np.uint64(1)))
            w_far, w_near = np.minimum(far[row], furthest), np.maximum(near[row], nearest)
            start, more_here = at[row] + anchor - w_far, (w_far - w_near).astype(np.int32)
            h1, h2 = b.mix(key ^ h_core).view(np.int64), b.mix(key ^ h_outer).view(np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    get["doc_id"].take(take), get["mark"].take(take), pa.array(start), pa.array(more_here),
                    get["alone"].take(take), pa.array(h1), pa.array(h2, mask=~full), get["core"].take(take),
                ],
                names=["doc_id", "mark", "first", "more", "mine", "core", "outer", "anchor"],
            )

    kind = around.schema["doc_id"].dataType.simpleString()
    return around.mapInArrow(run, f"doc_id {kind}, mark long, first long, more int, mine boolean, core long, outer long, anchor long")


def _windows(going: DataFrame, around: DataFrame, unit: Unit) -> DataFrame:
    """(doc_id, mark, first, mine, r1, r2): single windows with the ranks of their halves."""
    cells = going.select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("anchor").alias("_anchor"),
        F.struct("first", "more", (F.col("alone") & F.col("mine")).alias("mine")).alias("_cell"),
    ).groupBy("_id", "_mark", "_anchor").agg(F.collect_set("_cell").alias("cells"))
    joined = around.select("doc_id", "mark", "core", "at", "items", F.col("first").alias("_first"), F.col("more").alias("_more")).join(
        cells, (F.col("mark") == F.col("_mark")) & (F.col("core") == F.col("_anchor")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    )
    # A text may have an anchor's rank more than once; each cell goes with the run it came from.
    own = F.filter("cells", lambda c: (c["first"] >= F.col("_first")) & (c["first"] <= F.col("_first") + F.col("_more")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = unit.length // 2
        for batch in _lots(batches, unit):
            prefix, base, _ = _together(batch.column(3), unit)
            lists = batch.column(4)
            every, cell_row = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            first, count = every.field(0).to_numpy(), every.field(1).to_numpy().astype(np.int64) + 1
            cell = np.repeat(np.arange(len(count)), count)
            place = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
            row = cell_row[cell]
            s = base[row] + place - batch.column(2).to_numpy()[row]
            r1, r2 = b.span_hash(prefix, s, s + half).view(np.int64), b.span_hash(prefix, s + half, s + unit.length).view(np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(place), every.field(2).take(pa.array(cell)), pa.array(r1), pa.array(r2)],
                names=["doc_id", "mark", "first", "mine", "r1", "r2"],
            )

    kind = around.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "mark", "at", "items", own.alias("cells")).where(F.size("cells") > 0).mapInArrow(
        run, f"doc_id {kind}, mark long, first long, mine boolean, r1 long, r2 long"
    )


def repeated_spans(documents: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """(doc_id, mark, start, end): ranges of items that repeated windows cover; they may overlap.

    ``documents`` has doc_id, mark (a hash of the row) and text.
    """
    documents = documents.where(F.octet_length("text") >= unit.least_bytes)
    settled0, going0 = _told_apart(scratch.saved(_scan(documents, unit), f"{unit.name}-runs"), f"{unit.name}-round0")
    around = scratch.saved(_with_items(going0, documents, unit), f"{unit.name}-around")
    settled1, going1 = _told_apart(scratch.saved(_cells(around, unit), f"{unit.name}-cells"), f"{unit.name}-round1")
    windows = scratch.saved(_windows(going1, around, unit), f"{unit.name}-windows")
    scratch.free(around)
    ranked = windows.groupBy(F.col("r1").alias("_r1"), F.col("r2").alias("_r2")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    settled2 = _with_keys(windows, scratch.saved(ranked, f"{unit.name}-ranked"), {"r1": "_r1", "r2": "_r2"}, "left_semi").where("mine")
    span = lambda d, more: d.select("doc_id", "mark", F.col("first").alias("start"), (F.col("first") + more + unit.length).alias("end"))
    return span(settled0, F.col("more")).union(span(settled1.where("mine"), F.col("more"))).union(span(settled2, F.lit(0)))


def remove(documents: DataFrame, *, keep_bytes: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, spans (maximal removed ranges), n_passages, kept_sha256 and kept.

    ``kept`` are the bytes that stay (null unless ``keep_bytes``). ``n_passages``
    is the number of passages of PASSAGE_WORDS words or more, runs of words
    ``[^\\x20\\x09-\\x0D]+``, all of whose windows of as many words stand anywhere else.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    source = documents.select(F.col(id_col).alias("doc_id"), key.alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = [repeated_spans(source, unit).withColumn("unit", F.lit(unit.name)) for unit in (BYTES, WORDS)]
    of = lambda unit: F.collect_set(F.when(F.col("unit") == unit.name, F.struct("start", "end")))
    spans = (
        found[0].union(found[1])
        .groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        .agg(of(BYTES).alias("spans"), of(WORDS).alias("passages"))
    )
    joined = source.join(spans, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in b.chunks(batch.column(1)):
                sizes, ranges, passages, left, sums = np.diff(at), [], [], [], []
                for r in range(j - i):
                    raw = data[at[r] : at[r + 1]].tobytes()
                    merged = _merged(batch.column(2)[i + r])
                    edges = [0, *merged.ravel().tolist(), len(raw)]
                    kept = b"".join(raw[edges[e] : edges[e + 1]] for e in range(0, len(edges), 2))
                    ranges.append([{"start": x, "end": y} for x, y in merged.tolist()])
                    passages.append(len(_merged(batch.column(3)[i + r])))
                    left.append(kept if keep_bytes else None)
                    sums.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(ranges, _SPANS), pa.array(passages, pa.int64()), pa.array(sums, pa.string()), pa.array(left, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "n_passages", "kept_sha256", "kept"],
                )

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, n_passages long, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "spans", "passages").mapInArrow(run, schema)


def _merged(spans: pa.Scalar) -> np.ndarray:
    """Maximal ranges (n, 2) of possibly overlapping ones."""
    if not spans.is_valid or not len(spans.values):
        return np.zeros((0, 2), dtype=np.int64)
    start, end = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([first[1:], [True]])
    return np.stack([start[first], end[last]], axis=1)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def digest(removed: DataFrame) -> DataFrame:
    gone: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_passages")
