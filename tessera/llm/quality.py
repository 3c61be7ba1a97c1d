"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are training rows labelled 1. Unlabelled web text is a seeded
sample of all documents outside the held-out part, whether they have a label or
not; no label is looked at there, and no label 0 is used at all. The share of
positives among it is estimated from a first scorer of each half on the other half: the least ratio
of unlabelled to positive rows above a threshold. A small network on dense text features then
minimises ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with the logistic loss,
stepping back where the second term is negative.

Learning sees at most ``rows`` positive and ``rows`` unlabelled documents outside
the held-out part; scores cover every whole text, also one of many scan blocks. Labels, lang, source and doc_id are not features.

Defined results: null and empty texts get the score of a text without words;
without positive training rows every score is 0.5; repeated rows give repeated
results; an empty table none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import bytescan as b
from tessera.llm import labelled
from tessera.llm.rows import filtered

PARTS, HELD_OUT = 5, 0
THRESHOLD = 0.3
HIDDEN = 12

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True
_KIND = np.zeros((256, 8), dtype=np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?", "#*$%&@^~", "|<>{}[]=_\\/", '"')):
    for _c in _chars:
        _KIND[ord(_c), _k] = 1

FEATURES = (
    "capitals digits stops bangs symbols markup quotes marked_words repeated_next repeated_words distinct word_length "
    "long_words dup_lines piped_lines words_per_line words_log stop_per_word"
).split()


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    starts, ends, first = b.words(data, at)
    low = b.lowered(data)
    h = b.hashes(low, starts, ends)
    n = np.diff(first)
    many = np.maximum(n, 1)
    rows = np.repeat(np.arange(len(n)), n)
    chars = np.maximum(np.diff(at), 1)
    kinds = [b.per_row(_KIND[:, k][data], at) for k in range(8)]
    letters = np.maximum(kinds[0] + kinds[1], 1)
    # Words that end in a mark other than a full stop or comma.
    final = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marked = b.per_row(_KIND[final, 4] + _KIND[final, 5] + _KIND[final, 6], first)
    same = np.zeros(len(h), dtype=bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    key = np.sort(h ^ b.mix(rows.astype(np.uint64) + np.uint64(1)))
    # Distinct words of a row: tags are mixed with the row, so each is counted where it first stands.
    order = np.argsort(h ^ b.mix(rows.astype(np.uint64) + np.uint64(1)), kind="stable")
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount(rows[order], fresh, len(n))
    # Repeats of three-word windows.
    grams, gram_rows = b.window_hashes(h, first, 3)
    mixed = grams ^ b.mix(gram_rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(mixed, kind="stable")
    again = np.zeros(len(mixed), dtype=bool)
    if len(mixed):
        ordered = mixed[order]
        again[1:] = ordered[1:] == ordered[:-1]
    repeats = np.bincount(gram_rows[order], again, len(n))
    ls, le, lf = b.lines(data, at)
    n_lines = np.maximum(np.diff(lf), 1)
    line_rows = np.repeat(np.arange(len(n)), np.diff(lf))
    lh = b.hashes(data, ls, le) ^ b.mix(line_rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(lh, kind="stable")
    again = np.zeros(len(lh), dtype=bool)
    ordered = lh[order]
    again[1:] = ordered[1:] == ordered[:-1]
    dup_lines = np.bincount(line_rows[order], again, len(n))
    pipes = np.concatenate([[0], np.cumsum(data == ord("|"))])
    piped = b.per_row(pipes[le] - pipes[ls] >= 2, lf)
    length = b.per_row(ends - starts, first) / many
    long_words = b.per_row(ends - starts > 20, first) / many
    return np.stack(
        [
            kinds[0] / letters, kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, kinds[5] / chars, kinds[6] / chars, kinds[7] / chars,
            marked / many, b.per_row(same, first) / many, repeats / many, distinct / many, length / 10, long_words,
            dup_lines / n_lines, piped / n_lines, np.log1p(n / n_lines) / 4, np.log1p(n) / 6, kinds[3] / many,
        ],
        axis=1,
    )


@dataclass
class Network:
    """One hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def risk(f: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of positives as positive, risk of negatives): the second, from unlabelled less positive rows, may fall below zero."""
    as_positive, as_negative = np.logaddexp(0, -f), np.logaddexp(0, f)
    return prior * as_positive[is_p].mean(), as_negative[~is_p].mean() - prior * as_negative[is_p].mean()


def slopes(f: np.ndarray, is_p: np.ndarray, prior: float | None) -> np.ndarray:
    """Derivatives by each raw score of what a step lowers.

    That is the sum of both risks, or minus the second alone where it is below
    zero; without a prior, the mean loss of either kind of row.
    """
    s = _sigmoid(f)  # log(1 + exp(f)) has the derivative s, log(1 + exp(-f)) has s - 1
    n_p, n_u = max(1, int(is_p.sum())), max(1, int((~is_p).sum()))
    if prior is None:
        return np.where(is_p, (s - 1) / n_p, s / n_u)
    if risk(f, is_p, prior)[1] < 0:
        return np.where(is_p, prior * s / n_p, -s / n_u)
    return np.where(is_p, -prior / n_p, s / n_u)


def fit(p: np.ndarray, u: np.ndarray, prior: float | None, *, steps: int = 1200, rate: float = 0.05, decay: float = 1e-5, seed: int = 5) -> Network:
    """Non-negative risk minimisation; without a prior, plain separation of p from u.

    Every step uses all rows, so the sign of the negative risk is exact.
    """
    rnd = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    net = Network(both.mean(0), both.std(0) + 1e-6, rnd.normal(0, 0.3, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, 0.3, HIDDEN), 0.0)
    zp, zu = (np.clip((v - net.mean) / net.scale, -6, 6) for v in (p, u))
    z = np.concatenate([zp, zu])
    is_p = np.arange(len(z)) < len(zp)
    theta = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        a = np.tanh(z @ theta[0] + theta[1])
        f = a @ theta[2] + theta[3][0]
        d = slopes(f, is_p, prior)
        da = np.outer(d, theta[2]) * (1 - a * a)
        grads = [z.T @ da + decay * theta[0], da.sum(0), a.T @ d + decay * theta[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            theta[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = theta[0], theta[1], theta[2], float(theta[3][0])
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of unseen rows of both kinds.

    Among rows scored above a threshold that keeps at least half of the
    positives, the two shares differ by at least that factor: the least ratio is
    taken, with one standard error of both shares against chance minima.
    """
    if len(positive) == 0 or len(unlabelled) == 0:
        return 0.5
    cuts = np.quantile(positive, np.linspace(0, 0.5, 51))
    above_p = (positive[None, :] >= cuts[:, None]).mean(1)
    above_u = (unlabelled[None, :] >= cuts[:, None]).mean(1)
    error = np.sqrt((1 - above_p) / above_p / len(positive) + (1 - above_u) / np.maximum(above_u, 1e-9) / len(unlabelled))
    best = int(np.argmin(above_u / above_p * (1 + error)))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def learn_from(p: np.ndarray, p_fold: np.ndarray, u: np.ndarray, u_fold: np.ndarray) -> tuple[Network, float]:
    """The network and the prior, from positive and unlabelled rows, each in one of two folds."""
    found = []
    for k in (0, 1):
        if (p_fold == k).any() and (u_fold == k).any():
            first = fit(p[p_fold == k], u[u_fold == k], None, steps=200, rate=0.02, decay=1e-2)
            found.append((first.raw(p[p_fold != k]), first.raw(u[u_fold != k])))
    ranks = [np.concatenate(v) for v in zip(*found, strict=True)]
    prior = estimate_prior(*ranks) if ranks else 0.5
    return fit(p, u, prior), prior


@dataclass(frozen=True)
class Model:
    net: Network | None
    prior: float

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(at) - 1, 0.5)
        return self.net.score(features(data, at))


def learn(documents: DataFrame, labels: DataFrame, rows: int = labelled.TRAIN_ROWS) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in b.chunks(batch.column(1)):
                x = features(data, at)
                cells = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), cells], names=["doc_id", "x"])

    kind = documents.schema["doc_id"].dataType.simpleString()

    def featured(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = sample.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>").toPandas().sort_values("doc_id", kind="stable")
        x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
        return x, np.array([labelled.bucket(f"p{i}", 2) for i in got["doc_id"]], dtype=np.int64)

    p = featured(labelled.training_sample(documents, labels.where("quality > 0"), "quality", PARTS, HELD_OUT, rows))
    if not len(p[0]):
        return Model(None, 0.5)
    return Model(*learn_from(*p, *featured(labelled.unlabelled_sample(documents, PARTS, HELD_OUT, rows))))


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(data, at) for _, _, data, at in b.chunks(batch.column(1))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = documents.schema[id_col].dataType.simpleString()
    held = (labelled.part(id_col, PARTS) == HELD_OUT).alias("held")
    return documents.select(id_col, text_col, held).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep(documents: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least THRESHOLD, with all their columns."""

    def high(column: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[model.score(data, at) for _, _, data, at in b.chunks(column)]]) >= THRESHOLD

    return filtered(documents, text_col, lambda: high)
