"""Shingle sets of texts and fast similarity sketches of them.

A sketch of t coordinates is filled in rounds. In round i < t every element of
the set is thrown into a bin by a hash of that round; in round t + i every
element goes to bin i. A bin keeps the least value of the first round that
reached it, and rounds stop when no bin is empty: large sets need a few rounds,
and the last t rounds guarantee every coordinate even for one element. Two sets
agree in a coordinate with probability of their Jaccard similarity, concentrated
as for independent draws.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tessera.llm import bytescan as b

MOST_COORDINATES = 128
RECALL = 0.9999


@dataclass(frozen=True)
class Banding:
    rows: int
    bands: int

    @property
    def coordinates(self) -> int:
        return self.rows * self.bands


def banding(similarity: float, recall: float = RECALL, most: int = MOST_COORDINATES) -> Banding:
    """The most selective bands that find a pair at the threshold with the target recall."""
    best = Banding(1, max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - similarity)))))
    for rows in range(2, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if rows * bands <= most:
            best = Banding(rows, bands)
    return best


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles of each text, and the first index of each text (n + 1).

    A-Z count as a-z. A text of fewer than k words has its whole sequence as one
    shingle; one without words has none.
    """
    low = b.LOWER[data]
    starts, ends, first = b.words(low, at)
    h = b.hashes(low, starts, ends)
    grams, rows = b.window_hashes(h, first, k)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.full(len(short), 1, dtype=np.uint64)
        for i in range(k - 1):
            some = n[short] > i
            whole[some] = b.mix(whole[some] ^ h[first[short[some]] + i]) * np.uint64(0xD6E8FEB86659FD93)
        grams = np.concatenate([grams, b.mix(whole ^ b.mix(n[short].astype(np.uint64)))])
        rows = np.concatenate([rows, short])
        back = np.argsort(rows, kind="stable")
        grams, rows = grams[back], rows[back]
    tagged = grams ^ b.mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(tagged, kind="stable")
    fresh = np.ones(len(grams), dtype=bool)
    ordered = tagged[order]
    keep = np.ones(len(grams), dtype=bool)
    if len(grams):
        keep[1:] = ordered[1:] != ordered[:-1]
    fresh[order] = keep
    rows = rows[fresh]
    return grams[fresh], np.searchsorted(rows, np.arange(len(at)))


def fingerprints(elements: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set, whatever the order of its elements."""
    out = []
    for salt in (0x51ED27, 0x7F4A7C15):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b.mix(elements ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(b.mix(total[first[1:]] - total[first[:-1]]))
    return out[0].view(np.int64), out[1].view(np.int64)


def sketches(elements: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """(n, t) values; rows of empty sets are all ones."""
    n = len(first) - 1
    out = np.full((n, t), ~np.uint64(0), dtype=np.uint64)
    flat = out.ravel()
    rows = np.repeat(np.arange(n), np.diff(first))
    x = elements
    for i in range(2 * t):
        if len(x) == 0:
            break
        h = b.mix(x ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        bins = ((h >> np.uint64(44)) % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        value = (np.uint64(i) << np.uint64(44)) | (h & np.uint64((1 << 44) - 1))
        np.minimum.at(flat, rows * t + bins, value)
        empty = (out == ~np.uint64(0)).any(axis=1)
        going = empty[rows]
        if not going.all():
            x, rows = x[going], rows[going]
    return out


def band_keys(values: np.ndarray, plan: Banding) -> np.ndarray:
    """(n, bands) keys, each of ``rows`` coordinates and its band's number."""
    out = np.empty((len(values), plan.bands), dtype=np.uint64)
    for j in range(plan.bands):
        key = np.full(len(values), j + 1, dtype=np.uint64)
        for c in range(j * plan.rows, (j + 1) * plan.rows):
            key = b.mix(key ^ values[:, c]) * np.uint64(0xD6E8FEB86659FD93)
        out[:, j] = b.mix(key)
    return out.view(np.int64)
