"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

1. Rows with the same shingle set form a class; only classes go on, so thousands
   of copies cost one row.
2. Sketches of all classes are cut into bands; classes with a band in common
   share a bucket.
3. In each bucket every class is compared with the least one, on full sets.
   Links make components; a bucket within one component is finished.
4. Members of unfinished buckets are compared with each other in seeded blocks
   of BLOCK, then, still across components only, block by block: those outside
   the bucket's largest component against all. No bucket is capped, no group is
   in one task, and no pair of texts is made twice by Spark: a task counts the
   intersections of two blocks by matrix products.

Links are exact. A pair at the threshold shares a bucket with probability
``sketch.RECALL`` at least.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; rows that share an id and a text share a component;
a null id is a component of its own row, without id; of rows that share an id
but not a text, all leave the kept documents if one does; ties are settled by the
least id; a text of any length has its whole set; an empty table gives no rows;
``label`` ignores other columns, ``keep`` hands them on whatever their names. Ids
are whole numbers; others are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytescan as b
from tessera.llm import graph, scratch
from tessera.llm import sketch as sk
from tessera.llm.rows import as_struct, restored

SHINGLE, SIMILARITY = 5, 80
BLOCK, WIDE_BLOCK = 128, 512
_COLUMNS = 4096


def _sketched(documents: DataFrame, k: int, plan: sk.Banding) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in b.chunks(batch.column(2)):
                elements, first = sk.shingles(data, at, k)
                one, two = sk.fingerprints(elements, first)
                keys = sk.band_keys(sk.sketches(elements, first, plan.coordinates), plan)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * plan.bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first)), pa.array(one), pa.array(two), lists],
                    names=["doc_id", "mark", "n", "fp1", "fp2", "bands"],
                )

    return documents.mapInArrow(run, "doc_id long, mark long, n long, fp1 long, fp2 long, bands array<long>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(rep, n, elements) with the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in b.chunks(batch.column(1)):
                elements, first = sk.shingles(data, at, k)
                cells = [np.sort(elements[first[r] : first[r + 1]]).tobytes() for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(cells, pa.binary())], names=["rep", "n", "elements"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, n long, elements binary")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The links among rows (u, v, left, right) of two sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = int((y[at] == x).sum()) if len(y) else 0
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return pairs.select("u", "v", "left", "right").mapInArrow(run, "u long, v long")


def _links(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (row of left, row of right) that are linked and bear different labels, as indices into sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    names, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[place] > 1
    # An element of one set alone is in no intersection; what is left bounds all intersections.
    most = np.bincount(rows[shared], minlength=len(sets))
    bound = np.minimum(most[left][:, None], most[right][None, :])
    open_ = (labels[left][:, None] != labels[right][None, :]) & (100 * bound >= percent * (sizes[left][:, None] + sizes[right][None, :] - bound))
    if not open_.any():
        return np.zeros((0, 2), dtype=np.int64)
    left, right, open_ = left[open_.any(1)], right[open_.any(0)], open_[open_.any(1)][:, open_.any(0)]
    used = np.zeros(len(sets), dtype=bool)
    used[left] = used[right] = True
    pick = shared & used[rows]
    columns, at = np.unique(place[pick], return_inverse=True)
    rows = rows[pick]
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, len(columns), _COLUMNS):
        i, j = np.searchsorted(at, [c, c + _COLUMNS])
        cells = np.zeros((len(sets), min(_COLUMNS, len(columns) - c)), dtype=np.float32)
        cells[rows[i:j], at[i:j] - c] = 1
        total += cells[left] @ cells[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - total
    x, y = np.nonzero(open_ & (100 * total >= percent * union))
    return np.stack([left[x], right[y]], axis=1)


def _in_blocks(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links within one block, or between the two sides of a cell."""

    def run(cell: pa.Table) -> pa.Table:
        reps, labels = cell["rep"].to_numpy(), cell["label"].to_numpy()
        side = cell["side"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in cell["elements"]]
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        found = _links(left, right, sets, labels, percent) if len(left) and len(right) else np.zeros((0, 2), np.int64)
        u, v = reps[found[:, 0]], reps[found[:, 1]]
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return run


def classes_and_links(documents: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, roots): rows by class, classes with their least id, and (node, root) of linked classes."""
    plan = sk.banding(percent / 100)
    marked = documents.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    rows = scratch.saved(_sketched(marked, k, plan), "rows")
    classes = (
        rows.where("n > 0 and doc_id is not null")
        .groupBy("fp1", "fp2", "n")
        .agg(F.min(F.struct("doc_id", "mark")).alias("_least"), F.first("bands").alias("bands"))
        .select("fp1", "fp2", "n", F.col("_least.doc_id").alias("rep"), F.col("_least.mark").alias("mark"), "bands")
    )
    classes = scratch.saved(classes, "classes")
    members = classes.select("rep", "n", "mark", F.explode("bands").alias("bucket"))
    # What is known of buckets is saved: a hot bucket's rows meet it in a broadcast or in a plain exchange, which adaptive execution splits.
    full = members.groupBy(F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("least")).where("size > 1")
    full = scratch.saved(full, "buckets")
    members = scratch.saved(members.join(full, F.col("bucket") == F.col("_b")).drop("_b"), "members")

    wanted = members.groupBy("rep", "mark").agg(F.lit(1).alias("_one"))
    texts = marked.join(wanted, (F.col("doc_id") == F.col("rep")) & (marked["mark"] == wanted["mark"])).select("rep", "text")
    sets = scratch.saved(_sets(texts, k), "sets")
    left = sets.select(F.col("rep").alias("_l"), F.col("n").alias("_nl"), F.col("elements").alias("left"))
    right = sets.select(F.col("rep").alias("_r"), F.col("n").alias("_nr"), F.col("elements").alias("right"))
    pairs = members.where("rep <> least").groupBy(F.col("rep").alias("u"), F.col("least").alias("v")).agg(F.lit(1).alias("_one"))
    fits = F.least("_nl", "_nr") * 100 >= F.greatest("_nl", "_nr") * percent
    pairs = pairs.join(left, F.col("u") == F.col("_l")).join(right, F.col("v") == F.col("_r")).where(fits)
    links = scratch.saved(_verified(pairs, percent), "links")
    roots = graph.components(links)

    for wide in (False, True):
        many = members.where("size > 2").select("bucket", "rep", "size")
        named = many.join(roots, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "size", F.coalesce("root", "rep").alias("label"))
        by_label = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("_n"))
        open_ = (
            by_label.groupBy(F.col("bucket").alias("_b"))
            .agg(F.max_by("label", F.struct("_n", "label")).alias("main"), F.max("_n").alias("n_main"), F.count(F.lit(1)).alias("_labels"))
            .where("_labels > 1")
        )
        open_ = scratch.saved(open_, "open")
        named = named.join(open_, F.col("bucket") == F.col("_b"))
        if not wide:
            parts = F.ceil(F.col("size") / BLOCK)
            cells = named.withColumn("x", F.pmod(F.xxhash64("rep", "bucket"), parts)).withColumns({"y": F.lit(0).cast("long"), "side": F.lit(0)})
        else:
            apart = F.col("size") - F.col("n_main")
            few, most = F.ceil(apart / WIDE_BLOCK), F.ceil(F.col("n_main") / WIDE_BLOCK)
            is_main = F.col("label") == F.col("main")
            mine = F.pmod(F.xxhash64("rep", "bucket"), F.when(is_main, most).otherwise(few))
            # Cells (x, y): block x of those apart against block y of the main label, or against their own block -1 - y.
            cell = lambda x, y, side: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(side).alias("side"))
            up_to = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: n > 0)
            to_main = F.transform(up_to(most), lambda y: cell(F.col("_mine"), y, -1))
            to_own = F.transform(
                up_to(few),
                lambda y: F.struct(
                    F.least(F.col("_mine"), y).cast("long").alias("x"),
                    (-1 - F.greatest(F.col("_mine"), y)).cast("long").alias("y"),
                    F.when(F.col("_mine") < y, -1).when(F.col("_mine") > y, 1).otherwise(0).alias("side"),
                ),
            )
            from_main = F.transform(up_to(few), lambda x: cell(x, F.col("_mine"), 1))
            cells = named.withColumn("_mine", mine).withColumn("_c", F.explode(F.when(is_main, from_main).otherwise(F.concat(to_main, to_own))))
            cells = cells.select("bucket", "rep", "label", "_c.x", "_c.y", "_c.side")
        cells = cells.select("bucket", "x", "y", "rep", "label", "side").join(sets.select(F.col("rep").alias("_l"), "elements"), F.col("rep") == F.col("_l"))
        found = cells.select("bucket", "x", "y", "rep", "label", "side", "elements").groupBy("bucket", "x", "y").applyInArrow(_in_blocks(percent), "u long, v long")
        roots = graph.components(found.union(roots))
    return rows, classes, roots


def label(documents: DataFrame, *, k: int = SHINGLE, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id and kept."""
    if not isinstance(documents.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be a column of whole numbers")
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, classes, roots = classes_and_links(source, k, percent)
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(
        F.col("fp1").alias("_1"), F.col("fp2").alias("_2"), F.col("n").alias("_n"), F.coalesce("root", "rep").alias("root")
    )
    named = scratch.saved(named, "named")
    same = (F.col("fp1") == F.col("_1")) & (F.col("fp2") == F.col("_2")) & (F.col("n") == F.col("_n"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = rows.where("n > 0").join(named, same, "left").select("doc_id", "n", component.alias("c"))
    out = out.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("c")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"))


def keep(documents: DataFrame, *, k: int = SHINGLE, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that a smaller id of their component stands for."""
    gone = label(documents, k=k, percent=percent, id_col=id_col, text_col=text_col).where("not kept").select(F.col("doc_id").alias("_gone"))
    # The caller's columns travel in one struct, so that their names cannot clash.
    kept = documents.select(as_struct(documents)).join(gone.distinct(), F.col("row")[id_col] == F.col("_gone"), "left_anti")
    return restored(kept, documents.columns)
