"""Vectorised scanning of UTF-8 text held in Arrow string columns.

Documents are looked at as bytes, a few megabytes at a time, so that memory
stays bounded however many rows a batch has. White space is the six ASCII
characters of ``[\\x20\\x09-\\x0D]``; none of them can be part of a longer
UTF-8 character, so byte positions are safe word limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
SEGMENT_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_of(codes: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of codes[j] * base**j over j < i."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(len(codes))[0], dtype=np.uint64, out=out[1:])
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``prefix_of`` the codes of bytes."""
    return prefix_of(_BYTE_CODE[data])


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes at any place."""
    down = powers(len(prefix))[1]
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64)))


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, at = column(array)
    row, n = 0, len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of the first word of each row (n + 1).

    A word is a run of bytes other than white space, or of those that the table
    ``inside`` marks.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(at), dtype=np.int64)
    full = ~_SPACE[data] if inside is None else inside[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    first = full.copy()
    first[1:] &= ~full[:-1] | cut[1:n]
    last = full.copy()
    last[:-1] &= ~full[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of \\n-separated lines, and the index of each row's first line (n + 1)."""
    feeds = np.flatnonzero(data == 0x0A)
    rows = np.searchsorted(at, feeds, side="right") - 1
    per = np.bincount(rows, minlength=len(at) - 1).astype(np.int64) + 1 if len(at) > 1 else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    starts = np.empty(first[-1], dtype=np.int64)
    ends = np.empty(first[-1], dtype=np.int64)
    place = np.arange(len(feeds)) + rows
    inner = np.ones(first[-1], dtype=bool)
    inner[first[:-1]] = False
    starts[first[:-1]] = at[:-1]
    starts[inner] = feeds + 1
    ends[place] = feeds
    ends[first[1:] - 1] = at[1:]
    return starts, ends, first


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capitals of Latin-1 in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def hash_of(word: str) -> int:
    """The hash that ``hashes`` gives a span with these characters."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending spans, a segment of the bytes at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SEGMENT_BYTES)))
        base, stop = int(starts[i]), int(ends[j - 1])
        if stop - base > 4 * SEGMENT_BYTES and j == i + 1:
            out[i] = _long_hash(data[base:stop])
        else:
            out[i:j] = span_hash(prefix_hash(data[base:stop]), starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def _long_hash(data: np.ndarray) -> np.uint64:
    """The hash of one very long span, without arrays as long as itself."""
    total, scale = 0, 1
    step = pow(int(_BASE), SEGMENT_BYTES, 1 << 64)
    for i in range(0, len(data), SEGMENT_BYTES):
        total = (total + int(prefix_hash(data[i : i + SEGMENT_BYTES])[-1]) * scale) & ((1 << 64) - 1)
        scale = scale * step & ((1 << 64) - 1)
    size = mix(np.array([len(data)], dtype=np.uint64))
    return mix(np.array([total], dtype=np.uint64) ^ size)[0]


def window_hashes(word_hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word windows within rows, and the row of each; rows of under k words give none."""
    per = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per) + first[:-1][rows]
    h = np.full(len(rows), k, dtype=np.uint64)
    for i in range(k):
        h = mix(h ^ word_hashes[place + i]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), rows


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
