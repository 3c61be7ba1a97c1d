"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed insult list, of a lexicon learned
from the labelled training rows (words and word beginnings whose share among
toxic documents is far above that among others), nearness of insults to
second-person words, and rates of capitals, punctuation, marks and obfuscated
words. Trees are boosted on three quarters of the sample; the last quarter
calibrates their output.

Learning sees at most ``rows`` labelled documents outside the held-out part; the
lexicon is at most LEXICON entries. Both bounds are documented parameters; the
scores cover every document. Labels, lang, source and doc_id are not features.

Defined results: null and empty texts get the score of a text without words;
without training rows of both labels every score is the share of toxic ones, or
0.5 without any; a text of many scan blocks is scored whole; repeated rows give
repeated results; an empty table none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as b
from tessera.llm import labelled, trees

PARTS, HELD_OUT = 3, 1
LEXICON = 4096
BEGINNING = 6
THRESHOLD = 0.7

# Insults, and second-person words, of several languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb worthless trash garbage scum loser losers clown pathetic disgusting "
    "filthy imbecile retard freak pig vermin ugly hate kill die fool fools jerk bastard bitch whore slut "
    "arschloch dumm idiotisch abschaum versager widerlich "
    "connard imbécile salaud ordure minable dégoûtant "
    "imbécil estúpido basura escoria perdedor asqueroso"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre usted tú ti tus su".split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_SPELT = _LETTER.copy()
_SPELT[[ord(c) for c in "@$!"]] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[[ord(c) for c in "013457@$!"]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
for _a, _b in zip("013457@$!", "oieastasi", strict=True):
    _PLAIN[ord(_a)] = ord(_b)
_NEAR = 5


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHA = _UPPER + _table("abcdefghijklmnopqrstuvwxyz")
_BANG, _ASK, _MARK, _STOP = _table("!"), _table("?"), _table("#*$%&|<>@~^_=+"), _table(".,;:")


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of learned words and of learned word beginnings."""

    words: np.ndarray
    beginnings: np.ndarray


NO_LEXICON = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
_INSULTS = np.sort(np.array([b.hash_of(w) for w in INSULTS], dtype=np.uint64))
_SECOND = np.sort(np.array([b.hash_of(w) for w in SECOND_PERSON], dtype=np.uint64))
FEATURES = (
    "insults insults_share learned learned_share begun begun_share near_second second_share spelt "
    "capitals bangs asks marks stops words_log"
).split()


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if len(table) == 0:
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes; starts, ends and first indices of letter runs; their hashes."""
    low = b.lowered(data)
    starts, ends, first = b.words(low, at, _LETTER)
    return low, starts, ends, first, b.hashes(low, starts, ends)


def _begun(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the first bytes of longer words (0 for others)."""
    out = np.zeros(len(starts), dtype=np.uint64)
    long = np.flatnonzero(ends - starts > BEGINNING)
    out[long] = b.hashes(low, starts[long], starts[long] + BEGINNING)
    return out


def features(data: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    low, starts, ends, first, h = _tokens(data, at)
    n_words = np.diff(first)
    per_word = 100.0 / np.maximum(n_words, 1)
    insult = _in(h, _INSULTS)
    learned = _in(h, lexicon.words)
    begun = _in(_begun(low, starts, ends), lexicon.beginnings)
    second = _in(h, _SECOND)
    # An insult with a second-person word at most _NEAR tokens away.
    seen = np.concatenate([[0], np.cumsum(second)])
    hit = np.flatnonzero(insult | learned)
    row = np.searchsorted(first, hit, side="right") - 1
    left, right = np.maximum(hit - _NEAR, first[row]), np.minimum(hit + _NEAR + 1, first[row + 1])
    near = np.zeros(len(h), dtype=bool)
    near[hit] = seen[right] > seen[left]
    # Words spelt with digits or marks in place of letters.
    s2, e2, f2 = b.words(low, at, _SPELT)
    odd = np.concatenate([[0], np.cumsum(_ODD[low])]) if len(low) else np.zeros(1, np.int64)
    some = np.flatnonzero((odd[e2] - odd[s2] > 0) & (e2 - s2 - (odd[e2] - odd[s2]) >= 2) & (e2 - s2 <= 24))
    spelt = np.zeros(len(s2), dtype=bool)
    if len(some):
        trail = e2[some] - (low[e2[some] - 1] == ord("!"))
        spelt[some] = _in(b.hashes(_PLAIN[low], s2[some], trail), _INSULTS)
    chars = np.maximum(np.diff(at), 1)
    alpha = np.maximum(b.per_row(_ALPHA[data], at), 1)
    counts = {k: b.per_row(v, first).astype(np.float64) for k, v in (("i", insult), ("l", learned), ("b", begun), ("n", near), ("s", second))}
    return np.stack(
        [
            counts["i"], counts["i"] * per_word, counts["l"], counts["l"] * per_word, counts["b"], counts["b"] * per_word,
            counts["n"], counts["s"] * per_word, b.per_row(spelt, f2).astype(np.float64),
            b.per_row(_UPPER[data], at) / alpha, b.per_row(_BANG[data], at) / chars, b.per_row(_ASK[data], at) / chars,
            b.per_row(_MARK[data], at) / chars, b.per_row(_STOP[data], at) / chars, np.log1p(n_words),
        ],
        axis=1,
    )


def learn_lexicon(sample: DataFrame, least_docs: int = 3, ratio: float = 8.0) -> Lexicon:
    """Words and beginnings by their shares among toxic and other documents.

    Counted on the executors; the driver gets at most LEXICON entries, those
    with the greatest evidence. ``sample`` has doc_id, text and label.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(1).to_pylist()) > 0
            for i, j, data, at in b.chunks(batch.column(0)):
                low, starts, ends, first, h = _tokens(data, at)
                rows = np.repeat(np.arange(j - i), np.diff(first))
                begun = _begun(low, starts, ends)
                for kind, values in ((0, h), (1, begun)):
                    keep = values != 0
                    pairs = np.unique(np.stack([values[keep], rows[keep].astype(np.uint64)], axis=1), axis=0) if keep.any() else np.zeros((0, 2), np.uint64)
                    names, place = np.unique(pairs[:, 0], return_inverse=True)
                    toxic = np.bincount(place, label[i:j][pairs[:, 1].astype(np.int64)], len(names)).astype(np.int64)
                    both = np.bincount(place, minlength=len(names)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(names), kind, np.int32)), pa.array(names.view(np.int64)), pa.array(toxic), pa.array(both - toxic)],
                        names=["kind", "word", "toxic", "clean"],
                    )

    sizes = sample.agg(F.count_if(F.col("label") > 0).alias("t"), F.count_if(F.col("label") <= 0).alias("c")).first()
    if not sizes["t"] or not sizes["c"]:
        return NO_LEXICON
    share = F.col("toxic") / sizes["t"] / ((F.col("clean") + 0.5) / sizes["c"])
    top = (
        sample.select("text", "label")
        .mapInArrow(count, "kind int, word long, toxic long, clean long")
        .groupBy("kind", "word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= least_docs) & (share >= ratio))
        .orderBy((F.col("toxic") * F.log(share)).desc(), "kind", "word")
        .limit(LEXICON)
        .collect()
    )
    pick = lambda k: np.sort(np.array([r["word"] for r in top if r["kind"] == k], dtype=np.int64).view(np.uint64))
    return Lexicon(pick(0), pick(1))


def _featured(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and ids of the sample on the driver, in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in b.chunks(batch.column(1)):
                x = features(data, at, lexicon)
                cells = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), cells], names=["doc_id", "label", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {kind}, label double, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return x, rows["label"].to_numpy(dtype=np.float64), rows["doc_id"].to_numpy()


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    boosted: trees.Boosted | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.boosted is None:
            return np.full(len(at) - 1, self.knots[1][0])
        return trees.calibrated(self.boosted.raw(features(data, at, self.lexicon)), self.knots)


def learn(documents: DataFrame, labels: DataFrame, rows: int = labelled.TRAIN_ROWS) -> Model:
    sample = labelled.training_sample(documents, labels, "toxic", PARTS, HELD_OUT, rows).persist()
    # Each half of the sample is looked up in the lexicon of the other, so that counts are as on unseen texts and all rows train the trees.
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    halves = [sample.where(half == k) for k in (0, 1)]
    parts = [_featured(own, learn_lexicon(other)) for own, other in (halves, halves[::-1])]
    x, y, ids = (np.concatenate(v) for v in zip(*parts, strict=True))
    if len(np.unique(y)) < 2:
        sample.unpersist()
        return Model(NO_LEXICON, None, (np.zeros(1), np.array([y.mean() if len(y) else 0.5])))
    lexicon = learn_lexicon(sample)
    sample.unpersist()
    calibrate = np.array([labelled.bucket(f"c{i}", 4) == 0 for i in ids])
    if len(np.unique(y[calibrate])) < 2 or len(np.unique(y[~calibrate])) < 2:
        calibrate[:] = False
    boosted = trees.fit(x[~calibrate], y[~calibrate])
    some = calibrate if calibrate.any() else ~calibrate
    return Model(lexicon, boosted, trees.isotonic(boosted.raw(x[some]), y[some]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(data, at) for _, _, data, at in b.chunks(batch.column(1))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    held = (labelled.part("doc_id", PARTS) == HELD_OUT).alias("held")
    return documents.select("doc_id", "text", held).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
