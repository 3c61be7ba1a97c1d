"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of words: runs of letters and digits in lower
case. A document holds an item if some run of its words is within
``max_edits(n)`` word edits of the item's n words.

The CGK walk embeds a sequence x for 2 * len steps: step j writes x[i] and moves
i on by a random bit that depends on j and x[i] alone, so two sequences at a
small edit distance soon walk in step again and differ in few places. Bit
sampling takes SAMPLES places of an embedding as a key; a walk has TABLES such
keys, and each class of lengths has as many walks as reach RECALL at the most
edits that count, by a seeded simulation of the walks themselves. Windows start at every word where a match can start: by the
q-gram lemma, a run within e edits of n words shares n - Q + 1 - Q * e of the
item's Q-grams, so windows with fewer grams of any item at all are left out
without loss. The chance of a common key falls with the number of edits, so an
item is cut into pieces of PIECE words or a few more, each embedded by itself: if
an item is within its edits, so is one piece at least within its own share of
them. A window's key depends on its first words only, so pieces are put in
classes of near lengths and a window has keys for each class. Items and windows
with a piece's key in common are compared by exact edit distance (Myers'
bit-parallel matching), over the region of all the item's windows in a run.

A benchmark of at most BLOCK_ITEMS items and BLOCK_BYTES of text is a block that
goes to the executors whole, where a Python worker prepares it once for all its
tasks: one pass, no exchange. A larger one stays in tables, and documents are
still read once: two bitmaps of fixed size, of the items' grams and of their keys,
go to all tasks, which write the keys that the second lets through and the words of
their documents, cut into segments; these join the table of keys, and each pair of
document and item joins the segments that its places reach for the exact distance.
A full bitmap lets more through and loses nothing. Both ways find what has a key in
common.

Defined results: null and empty texts hold nothing; a row is judged by its text
alone, also where its id is null or another row's; items that are null or have
fewer than Q words are left out; repeated rows and items give repeated results;
a text of many scan blocks is searched whole; an empty table gives no rows;
``find`` ignores other columns, ``keep`` hands them on whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import bytescan as b
from tessera.llm import scratch
from tessera.llm.rows import filtered

Q = 3
EDIT_SHARE = 0.2
#: Target: the share of items at exactly max_edits(n) edits that are found, at every length.
RECALL = 0.99
TABLES, SAMPLES = 6, 5
PIECE = 8
_MOST_WALKS, _TRIALS = 64, 2000
CLASS_RATIO = 1.5
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 4 << 20
#: Bits of each bitmap over a benchmark of more than one block (16 MB), and words of a segment of a document.
BITMAP_BITS, SEGMENT = 27, 1024

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_FILTER_BITS = 22


def max_edits(n: int) -> int:
    """Word edits that still count: a share of the words, and few enough for one gram to stay whole."""
    return max(0, min(int(EDIT_SHARE * n), (n - Q) // Q))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = b.lowered(data)
    starts, ends, first = b.words(low, at, _LETTER)
    return b.hashes(low, starts, ends), first


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """(n, steps) CGK embeddings of words[starts[i]:ends[i]], with 0 past the end."""
    out = np.zeros((len(starts), steps), dtype=np.uint64)
    at = starts.copy()
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    for j in range(steps):
        now = np.where(at < ends, padded[np.minimum(at, len(words))], np.uint64(0))
        out[:, j] = now
        bit = b.mix(now ^ b.mix(np.array([walk * 1_000_003 + j + 1], dtype=np.uint64))) & np.uint64(1)
        at = at + bit.astype(np.int64)
    return out


def keys(embedded: np.ndarray, walk: int, size: int) -> np.ndarray:
    """(n, TABLES) keys of sampled places of the first 2 * size steps."""
    rnd = np.random.default_rng([walk, size])
    out = np.empty((len(embedded), TABLES), dtype=np.uint64)
    for t in range(TABLES):
        key = np.full(len(embedded), (walk * TABLES + t) * 1_000_003 + size, dtype=np.uint64)
        for place in rnd.choice(2 * size, SAMPLES, replace=False):
            key = b.mix(key ^ embedded[:, place]) * np.uint64(0xD6E8FEB86659FD93)
        out[:, t] = b.mix(key)
    return out


def distance(pattern: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance of the pattern to a run of the text."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for w in text.tolist():
        eq = masks.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (~(x | up) & full), up & x
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1) & full, (less << 1) & full
        up, down = less | (~((eq | down) | more) & full), more & (eq | down)
        best = min(best, score)
    return best


def class_of(n: int) -> int:
    """The class of a piece of n words: keys are made of its first ``size`` words at least."""
    size = Q
    while size * CLASS_RATIO <= n:
        size = int(size * CLASS_RATIO)
    return size


def _edited(words: np.ndarray, edits: int, rnd: np.random.Generator) -> np.ndarray:
    """The words after so many replaced, deleted and inserted ones, and a tail of others."""
    out = words.tolist()
    for kind in rnd.integers(0, 3, edits):
        at = int(rnd.integers(0, len(out)))
        if kind == 1 and len(out) > 1:
            del out[at]
        else:
            out[at : at + (kind != 2)] = [int(rnd.integers(1, 1 << 62))]
    return np.concatenate([np.array(out, dtype=np.uint64), rnd.integers(1, 1 << 62, 2 * len(words), dtype=np.uint64)])


@cache
def walks(size: int) -> int:
    """The fewest walks that miss half of what RECALL allows of simulated pieces of the class, of each length, at ``max_edits``."""
    most = 1
    for n in (n for n in range(size, 2 * PIECE) if class_of(n) == size and max_edits(n)):
        rnd = np.random.default_rng([size, n])
        items = rnd.integers(1, 1 << 62, (_TRIALS, n), dtype=np.uint64)
        texts = [_edited(x, max_edits(n), rnd) for x in items]
        ends = np.cumsum([len(t) for t in texts])
        begins, flat = ends - [len(t) for t in texts], np.concatenate(texts)
        found, k = np.zeros(_TRIALS, dtype=bool), 0
        while found.mean() < (1 + RECALL) / 2 and k < _MOST_WALKS:
            mine = keys(embed(items.ravel(), np.arange(_TRIALS) * n, np.arange(1, _TRIALS + 1) * n, 2 * size, k), k, size)
            for shift in range(max_edits(n) + 1):
                found |= (keys(embed(flat, begins + shift, ends, 2 * size, k), k, size) == mine).any(axis=1)
            k += 1
        most = max(most, k)
    return most


def pieces_of(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(place in the item, words) of an item's pieces."""
    out, at = [], 0
    for piece in np.array_split(words, max(1, len(words) // PIECE)):
        out.append((at, piece))
        at += len(piece)
    return out


def piece_keys(pieces: list[np.ndarray], rounds: dict[int, int]) -> dict[int, tuple[list[int], np.ndarray]]:
    """For each class the pieces that are of it and their (n, walks * TABLES) keys."""
    members: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        members.setdefault(class_of(len(piece)), []).append(i)
    out = {}
    for size, of in members.items():
        flat = np.concatenate([pieces[i] for i in of])
        n = np.array([len(pieces[i]) for i in of])
        ends = np.cumsum(n)
        out[size] = of, np.concatenate([keys(embed(flat, ends - n, ends, 2 * size, k), k, size) for k in range(rounds[size])], axis=1)
    return out


def all_walks() -> dict[int, int]:
    """The walks of every class of pieces; simulated on the driver, once for all tasks."""
    return {size: walks(size) for size in sorted({class_of(n) for n in range(Q, 2 * PIECE)})}


def limits_of(lengths: Iterable[int]) -> dict[int, tuple[int, int]]:
    """For each class of pieces of these lengths: the most words of a run within their edits, the fewest grams it shares."""
    classes: dict[int, list[int]] = {}
    for n in lengths:
        classes.setdefault(class_of(n), []).append(n)
    return {size: (max(n + max_edits(n) for n in of), max(1, min(n - Q + 1 - Q * max_edits(n) for n in of))) for size, of in classes.items()}


def hits(h: np.ndarray, first: np.ndarray, known: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Whether the gram at each word is a known one."""
    grams, rows = b.window_hashes(h, first, Q)
    per = np.bincount(rows, minlength=len(first) - 1)
    some = np.flatnonzero(known(grams))
    out = np.zeros(len(h), dtype=bool)
    out[some + (first[:-1] - (np.cumsum(per) - per))[rows[some]]] = True
    return out


def windows(
    h: np.ndarray, ends: np.ndarray, hit: np.ndarray, limits: dict[int, tuple[int, int]], rounds: dict[int, int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, places, keys) of lots of windows with enough known grams; ``ends`` has where each word's row ends."""
    total = np.concatenate([[0], np.cumsum(hit)])
    for size, (reach, least) in limits.items():
        stop = np.minimum(np.arange(len(h)) + reach, ends)
        starts = np.flatnonzero(total[stop] - total[: len(h)] >= least)
        # Piece-sized windows: keys read at most the class's walk, and never past the document.
        for lot in range(0, len(starts), 4096):
            s = starts[lot : lot + 4096]
            for k in range(rounds[size]):
                yield size, s, keys(embed(h, s, stop[s], 2 * size, k), k, size)


def regions(places: Iterable[int], n: int) -> Iterator[tuple[int, int]]:
    """The runs of words to compare with an item of n words that may start at these places."""
    # A piece's words stand up to e words from where they stand in the item, and its window may be as far off.
    reach = 2 * max_edits(n)
    low = high = None
    for place in sorted(set(places)):
        if high is not None and place > high:
            yield low - reach, high + reach
            low = None
        low, high = place if low is None else low, place + n
    if high is not None:
        yield low - reach, high + reach


@dataclass
class Items:
    """A block of items, their grams, their pieces and the pieces' keys."""

    ids: list[int]
    words: list[np.ndarray]

    def __post_init__(self) -> None:
        self.name = uuid.uuid4().hex
        self.walks = all_walks()

    def prepare(self) -> Items:
        grams = [np.zeros(0, np.uint64)]
        pieces: list[np.ndarray] = []
        self.piece_of: list[tuple[int, int]] = []
        for i, w in enumerate(self.words):
            grams.append(b.window_hashes(w, np.array([0, len(w)]), Q)[0])
            for at, piece in pieces_of(w):
                pieces.append(piece)
                self.piece_of.append((i, at))
        self.grams = np.unique(np.concatenate(grams))
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[(self.grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        self.limits = limits_of(map(len, pieces))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, (members, found) in piece_keys(pieces, self.walks).items():
            order = np.argsort(found.ravel(), kind="stable")
            self.tables[size] = found.ravel()[order], np.repeat(members, found.shape[1])[order]
        return self

    def known(self, grams: np.ndarray) -> np.ndarray:
        out = self.maybe[(grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)]
        if len(self.grams):
            some = np.flatnonzero(out)
            at = np.minimum(np.searchsorted(self.grams, grams[some]), len(self.grams) - 1)
            out[some] = self.grams[at] == grams[some]
        return out

    def search(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, distance) of every item that a row's words hold."""
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pairs: dict[tuple[int, int], list[int]] = {}
        for size, s, found in windows(h, first[1:][row_of], hits(h, first, self.known), self.limits, self.walks):
            table, owners = self.tables[size]
            lo, hi = np.searchsorted(table, found.ravel()), np.searchsorted(table, found.ravel(), side="right")
            for c in np.flatnonzero(hi > lo):
                place = int(s[c // TABLES])
                for piece in set(owners[lo[c] : hi[c]].tolist()):
                    item, before = self.piece_of[piece]
                    pairs.setdefault((int(row_of[place]), item), []).append(place - before)
        out = []
        for (row, item), places in sorted(pairs.items()):
            pattern = self.words[item]
            within = ((max(int(first[row]), low), min(int(first[row + 1]), high)) for low, high in regions(places, len(pattern)))
            best = min(distance(pattern, h[low:high]) for low, high in within)
            if best <= max_edits(len(pattern)):
                out.append((row, item, best))
        return out


_ready: dict[str, Items] = {}


def _prepared(items: Items) -> Items:
    """The block with its tables, kept by a Python worker for its next tasks; one block at a time."""
    if items.name not in _ready:
        _ready.clear()
        _ready[items.name] = items.prepare()
    return _ready[items.name]


def _block(benchmark: DataFrame, id_col: str, text_col: str) -> Items | None:
    """The benchmark as one block, or None if it is larger than one may be."""
    rows = benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull())
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    if count > BLOCK_ITEMS or size > BLOCK_BYTES:
        return None
    ids, words = [], []
    for r in rows.collect():
        data = np.frombuffer(r[1].encode(), dtype=np.uint8)
        h, _ = word_hashes(data, np.array([0, len(data)]))
        if len(h) >= Q:
            ids.append(r[0])
            words.append(h)
    return Items(ids, words)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.uint64, copy=False).view(np.int64)))


def _item_table(benchmark: DataFrame, text_col: str) -> DataFrame:
    """(item, words, grams, lengths of pieces, keys, places of their pieces): one row for each distinct text of Q words or more."""
    rounds = all_walks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, at in b.chunks(batch.column(1)):
                h, first = word_hashes(data, at)
                rows = [r for r in range(len(at) - 1) if first[r + 1] - first[r] >= Q]
                words = [h[first[r] : first[r + 1]] for r in rows]
                cut = [pieces_of(w) for w in words]
                begins = np.cumsum([0] + [len(c) for c in cut])
                mine: list[np.ndarray] = [np.zeros(0, np.uint64)] * int(begins[-1])
                for of, found in piece_keys([p for c in cut for _, p in c], rounds).values():
                    for piece, its in zip(of, found, strict=True):
                        mine[piece] = its
                lists: list[tuple[np.ndarray, ...]] = []
                for k, w in enumerate(words):
                    its = mine[begins[k] : begins[k + 1]]
                    befores = [np.full(len(x), before) for (before, _), x in zip(cut[k], its, strict=True)]
                    grams, _ = b.window_hashes(w, np.array([0, len(w)]), Q)
                    lists.append((w, grams, np.array([len(p) for _, p in cut[k]]), np.concatenate(its), np.concatenate(befores)))
                if rows:
                    columns = [_lists(np.concatenate(x), np.cumsum([0, *map(len, x)])) for x in zip(*lists, strict=True)]
                    taken = batch.column(0).take(pa.array([i + r for r in rows]))
                    yield pa.RecordBatch.from_arrays([taken, *columns], names=["item", "pattern", "grams", "lengths", "keys", "befores"])

    texts = benchmark.select(F.md5(text_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").dropDuplicates(["item"])
    lists = ", ".join(f"{c} array<long>" for c in ("pattern", "grams", "lengths", "keys", "befores"))
    return scratch.saved(texts.mapInArrow(run, f"item string, {lists}"), "items")


def _bitmap(items: DataFrame, column: str) -> np.ndarray:
    """Bits that stand for the values of an array column; of a fixed size, whatever the number of items."""
    slot = items.select(F.explode(column).alias("value")).select(F.col("value").bitwiseAND((1 << BITMAP_BITS) - 1).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    got = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _set(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values & np.uint64((1 << BITMAP_BITS) - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


#: Keys and places that a task gathers before it hands them on.
_LOT = 1 << 18


def _keyed(first: np.ndarray, row_of: np.ndarray, places: list[np.ndarray], found: list[np.ndarray]) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """Rows with their keys and the places, counted from the row's first word, of the windows that have them."""
    at, key = np.concatenate(places), np.concatenate(found)
    order = np.argsort(row_of[at], kind="stable")
    at, key = at[order], key[order]
    rows, begins = np.unique(row_of[at], return_index=True)
    begins = np.append(begins, len(at))
    return rows, _lists(key, begins), _lists((at - first[row_of[at]]).astype(np.uint64), begins)


def _candidates(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Of (held, text) rows with a key that may be an item's: rows of keys and places, and rows of the text's words, SEGMENT a part."""
    rounds = all_walks()
    # Lengths of pieces are under 2 * PIECE, so these are a few numbers.
    limits = limits_of(r[0] for r in items.select(F.explode("lengths")).distinct().collect())
    share = texts.sparkSession.sparkContext.broadcast((_bitmap(items, "grams"), _bitmap(items, "keys")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, wanted = share.value
        for batch in batches:

            def made(
                at: np.ndarray, part: np.ndarray | None = None, words: pa.Array | None = None, keys: pa.Array | None = None, places: pa.Array | None = None, batch: pa.RecordBatch = batch
            ) -> pa.RecordBatch:
                lists = [pa.nulls(len(at), pa.list_(pa.int64())) if x is None else x for x in (words, keys, places)]
                parts = pa.nulls(len(at), pa.int64()) if part is None else pa.array(part, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in (0, 1)), parts, *lists], names=["row", "held", "part", "words", "keys", "places"])

            for i, _, data, at in b.chunks(batch.column(2)):
                h, first = word_hashes(data, at)
                row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                some = np.zeros(len(first) - 1, dtype=bool)
                places: list[np.ndarray] = []
                found: list[np.ndarray] = []
                for _, s, its in windows(h, first[1:][row_of], hits(h, first, partial(_set, grams)), limits, rounds):
                    ok = _set(wanted, its.ravel()).reshape(its.shape)
                    if ok.any():
                        places.append(s[np.nonzero(ok)[0]])
                        found.append(its[ok])
                        some[row_of[places[-1]]] = True
                    if sum(map(len, places)) >= _LOT:
                        rows, key, place = _keyed(first, row_of, places, found)
                        yield made(i + rows, keys=key, places=place)
                        places, found = [], []
                if places:
                    rows, key, place = _keyed(first, row_of, places, found)
                    yield made(i + rows, keys=key, places=place)
                for r in np.flatnonzero(some):
                    words = h[first[r] : first[r + 1]]
                    cuts = np.append(np.arange(0, len(words), SEGMENT), len(words))
                    yield made(np.full(len(cuts) - 1, i + r), np.arange(len(cuts) - 1), _lists(words, cuts))

    kind = texts.schema["held"].dataType.simpleString()
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "held", "text")
    out = scratch.saved(rows.mapInArrow(run, f"row long, held {kind}, part long, words array<long>, keys array<long>, places array<long>"), "candidates")
    share.destroy()
    return out


def _exact(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step from candidates to the (row, item, n_words, distance) of those within their edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, least = [], [], []
            for k, (pattern, places, parts) in enumerate(zip(*[batch.column(c) for c in (2, 3, 4)], strict=True)):
                words = np.asarray(pattern.values).view(np.uint64)
                text = {p["part"].as_py(): np.asarray(p["words"].values).view(np.uint64) for p in parts}
                best = len(words)
                for low, high in regions(places.as_py(), len(words)):
                    begin = max(0, low) // segment
                    near = [text[p] for p in range(begin, (high - 1) // segment + 1) if p in text]
                    if near:
                        best = min(best, distance(words, np.concatenate(near)[max(0, low) - begin * segment : high - begin * segment]))
                if best <= max_edits(len(words)):
                    at.append(k)
                    size.append(len(words))
                    least.append(best)
            taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(size, pa.int64()), pa.array(least, pa.int64())], names=["row", "item", "n_words", "distance"])

    return run


def _joined(texts: DataFrame, benchmark: DataFrame, text_col: str) -> DataFrame:
    """(held, item, n_words, distance) of (held, text) rows: one for each distinct item of a benchmark of any size that a row holds."""
    items = _item_table(benchmark, text_col)
    rows = _candidates(texts, items)
    by_key = items.select("item", F.explode(F.arrays_zip("keys", "befores")).alias("k")).select("item", "k.keys", "k.befores")
    windows = rows.where("keys is not null").select("row", F.explode(F.arrays_zip("keys", "places")).alias("k")).select("row", "k.keys", "k.places")
    pairs = windows.join(by_key, "keys").groupBy("row", "item").agg(F.collect_set(F.col("places") - F.col("befores")).alias("places"))

    def part(place: Column) -> Column:
        return F.floor(F.greatest(place, F.lit(0)) / SEGMENT)

    n = F.size("pattern")
    # At least 2 * max_edits(n) words on both sides.
    reach = (2 * EDIT_SHARE * n).cast("int") + 1
    parts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(part(p - reach), part(p + n + reach)))))
    needed = pairs.join(items.select("item", "pattern"), "item").select("row", "item", "places", F.explode(parts).alias("part"))
    segments = rows.where("words is not null").select("row", "part", "words")
    whole = needed.join(segments, ["row", "part"]).groupBy("row", "item").agg(F.any_value("places").alias("places"), F.collect_list(F.struct("part", "words")).alias("parts"))
    ready = whole.join(items.select("item", "pattern"), "item").select("row", "item", "pattern", "places", "parts")
    checked = ready.mapInArrow(_exact(SEGMENT), "row long, item string, n_words long, distance long")
    return checked.join(rows.where("part = 0").select("row", "held"), "row").select("held", "item", "n_words", "distance")


def find(
    documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_words, distance): one row for each item that a document holds."""
    items = _block(benchmark, item_col, item_text_col)
    if items is None:
        found = _joined(documents.select(F.col(id_col).alias("held"), F.col(text_col).alias("text")), benchmark, item_text_col)
        ids = benchmark.select(F.col(item_col).alias("item_id"), F.md5(item_text_col).alias("item"))
        return found.join(ids, "item").select(F.col("held").alias("doc_id"), "item_id", "n_words", "distance")
    kind = documents.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    ids_type = to_arrow_type(benchmark.schema[item_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _prepared(items)
        for batch in batches:
            for i, _, data, at in b.chunks(batch.column(1)):
                found = ready.search(*word_hashes(data, at))
                take = pa.array([i + r for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        pa.array([ready.ids[k] for _, k, _ in found], ids_type),
                        pa.array([len(ready.words[k]) for _, k, _ in found], pa.int64()),
                        pa.array([d for _, _, d in found], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "n_words", "distance"],
                )

    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, n_words long, distance long")


def keep(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns; ids play no part."""
    items = _block(benchmark, "item_id", text_col)
    if items is None:
        # Rows are found again by their text, which need not be exchanged for it.
        texts = documents.select(F.md5(text_col).alias("held"), F.col(text_col).alias("text"))
        found = scratch.saved(_joined(texts, benchmark, text_col).select("held").distinct(), "found")
        return documents.join(found, F.md5(documents[text_col]) == found["held"], "left_anti")

    def make() -> Callable[[pa.Array], np.ndarray]:
        ready = _prepared(items)

        def clean(column: pa.Array) -> np.ndarray:
            out = np.ones(len(column), dtype=bool)
            for i, _, data, at in b.chunks(column):
                out[[i + r for r, _, _ in ready.search(*word_hashes(data, at))]] = False
            return out

        return clean

    return filtered(documents, text_col, make)
