"""How far the sources of a language differ in their words, by a baseline-corrected inverted index.

A pair of sources would need a term of ``f`` for each kept term of the language,
most of which neither has. So a pair starts at its baseline, the number of kept
terms times ``f`` of two zero counts, and term postings put right only what
differs from it. A term that one of both has is put right from that source's own
histogram of counts, as the other side's zero count is the same for all terms; a
term that both have is put right where their postings meet. Postings meet in
tasks that add up blocks of pairs of sources and emit one sum a pair, not one
row for each pair of each term. A window ranks each source's own terms.

Texts are counted in Arrow batches, with a bounded number of counters a task;
all else is DataFrame code on rows of the size of the vocabulary. All arithmetic
is on whole numbers.

Defined results: null text, lang and source count as ''; a source without kept
terms has zero counts; a language with one source has no pairs, one without
kept terms has pairs of value 0; repeated rows, null ids and texts of any length
count like others, other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import scratch

#: Bytes of text to what they count as: A-Z in lower case, bytes outside of terms as spaces.
FOLDED = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Counters in a task before they are handed on.
COUNTERS = 300_000
#: Sources a side of a block of pairs, blocks held in a task, and pairs made at once.
SIDE, BLOCKS, PAIRS = 512, 64, 1 << 19


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang, source, text into partial counts of terms and of documents that have them; a null term for each group."""

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (words, docs) in groups.items():
            n = len(words) + 1
            columns = [
                pa.array([lang] * n), pa.array([source] * n), pa.array([*words, None], pa.binary()).cast(pa.string()),
                pa.array([*words.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, words), 0], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        groups.clear()

    groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            words, docs = groups[lang, source]
            found = text.as_py().translate(FOLDED).split()
            before = len(words)
            words.update(found)
            docs.update(set(found))
            held += len(words) - before + 1
            if held > COUNTERS:
                yield from flush()
                held = 0
    yield from flush()


def index(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Postings lang, source, term, n, docs: occurrences and documents; a row with a null term for each group."""
    plain = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # A task counts one group after the other, so that few counters are in use and hand on each term once.
    counted = plain.sortWithinPartitions("lang", "source").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), past the range of long."""
    return F.expr(f"1L + (cast({count} + 2 as decimal(20, 0)) * {SCALE}) div cast(nullif({total} + 2 * terms, 0) as decimal(20, 0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _np_f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _meetings(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within runs of rows, a bounded number at a time; ``starts`` are the runs' first rows."""
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    later = ends - np.arange(n) - 1
    done = np.cumsum(later)
    low = 0
    while low < n:
        # Rows whose pairs fit; one row's pairs are as many as a language has sources.
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + PAIRS, side="right")))
        left = np.repeat(np.arange(low, high), later[low:high])
        first = np.cumsum(later[low:high]) - later[low:high]
        yield left, left + 1 + np.arange(len(left)) - np.repeat(first, later[low:high])
        low = high


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of lang and term into sums of corrections for pairs of sources that both have a term."""
    blocks: dict[tuple[str, int, int], np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, x, y), sums in blocks.items():
            a, b = np.nonzero(sums)
            columns = [pa.array([lang] * len(a), pa.string()), pa.array(a + x * SIDE), pa.array(b + y * SIDE), pa.array(sums[a, b])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])
        blocks.clear()

    def add(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        coded, place, p, zero = rows["lang"].combine_chunks().dictionary_encode(), *(rows[c].to_numpy() for c in ("place", "p", "zero"))
        langs, names, wide = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), int(place.max()) // SIDE + 1
        for left, right in _meetings(_starts(rows), len(p)):
            p_left, p_right, z_left, z_right = p[left], p[right], zero[left], zero[right]
            value = _np_f(p_left, p_right) - _np_f(p_left, z_right) - _np_f(z_left, p_right) + _np_f(z_left, z_right)
            some = value != 0
            left, right, value = left[some], right[some], value[some]
            if not len(value):
                continue
            # Pairs in order of their blocks, a block one number; rows of numbers are slow to compare.
            a, b = np.minimum(place[left], place[right]), np.maximum(place[left], place[right])
            where = (langs[left] * wide + a // SIDE) * wide + b // SIDE
            order = np.argsort(where, kind="stable")
            where, cell, value = where[order], (a % SIDE * SIDE + b % SIDE)[order], value[order]
            cuts = np.flatnonzero(np.diff(where, prepend=where[0] - 1))
            for low, high in zip(cuts, np.append(cuts[1:], len(where)), strict=True):
                lang, x, y = (int(i) for i in np.unravel_index(where[low], (len(names), wide, wide)))
                name = (names[lang], x, y)
                if name not in blocks and len(blocks) >= BLOCKS:
                    yield from flush()
                np.add.at(blocks.setdefault(name, np.zeros((SIDE, SIDE), dtype=np.int64)).reshape(-1), cell[low:high], value[low:high])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not len(rows):
            continue
        last = int(_starts(rows)[-1])  # the last term may go on in the next batch
        held = rows.slice(last)
        if last:
            yield from add(rows.slice(0, last))
    if held is not None and len(held):
        yield from add(held)
    yield from flush()


def _starts(rows: pa.Table) -> np.ndarray:
    """The first row of each term."""
    changed = np.ones(len(rows), dtype=bool)
    codes = [rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term")]
    changed[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return np.flatnonzero(changed)


def audit(documents: DataFrame, *, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, **columns: str) -> DataFrame:
    """Rows of lang, source, part, item, value, rank: each pair of a language's sources, and each source's most typical terms."""
    n_parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = scratch.saved(index(documents, **columns), "postings")
    of_term = Window.partitionBy("lang", "term")
    kept = (
        postings.where("term is not null")
        .withColumns({"_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "_nth": F.row_number().over(of_term.orderBy("source"))})
        .where(F.col("_docs") >= least_docs)
        .select("lang", "source", "term", "n", "lang_n", (F.col("_nth") == 1).alias("first"))
    )
    kept = scratch.saved(kept, "kept")

    # A row for each source of each language, at its place among them.
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    facts = (
        postings.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .na.fill(0, ["total", "lang_total", "terms"])
        .withColumns({"zero": _share("0", "total"), "place": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1})
    )
    # Saved, so that its size is known: Spark broadcasts it or splits what is hot.
    facts = scratch.saved(facts, "facts")
    posted = kept.join(facts, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total")})

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = posted.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)

    others = facts.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("zero").alias("other_zero"))
    nobody = F.lit(None).cast("string")
    base = (
        facts.repartition(n_parts, "lang", "source").join(others, "lang").where("place != b")
        .select("lang", F.col("place").alias("a"), "b", "source", "item", F.coalesce(F.col("terms") * _f("zero", "other_zero"), F.lit(0)).alias("value"))
    )
    histogram = posted.groupBy("lang", F.col("place").alias("a"), "p", "zero").agg(F.count(F.lit(1)).alias("times"))
    one = (
        histogram.repartition(n_parts, "lang", "a", "p").join(others, "lang").where("a != b")
        .withColumn("value", F.col("times") * (_f("p", "other_zero") - _f("zero", "other_zero")))
        .where("value != 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    met = posted.select("lang", "term", "place", "p", "zero").repartition(n_parts, "lang", "term").sortWithinPartitions("lang", "term")
    both = met.mapInArrow(_both, "lang string, a long, b long, value long")
    corrections = one.unionByName(both)
    mirrored = corrections.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    changes = corrections.unionByName(mirrored).select("lang", "a", "b", nobody.alias("source"), nobody.alias("item"), "value")
    pairs = base.unionByName(changes).groupBy("lang", "a", "b").agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
