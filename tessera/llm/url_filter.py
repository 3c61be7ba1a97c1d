"""URL rules by a bit-parallel wildcard automaton.

All patterns are packed into the bits of a few 64-bit words. A step of the
Shift-And automaton reads one character and moves every pattern at once:
``state = ((state << 1 | starts) & fits[char]) | (state & stays[char])``. URLs of
a batch step together, so a step is a few array operations whatever the number
of patterns and URLs.

A URL's canonical form is ``.host`` + path, host in lower case. In a pattern,
``*`` stands for characters other than ``/`` and ``**`` for any characters; a
pattern has to match the whole form. A rule (host, path) is the pattern
``*.host path**``: the leading dot lets it fit the host and all its subdomains.

Among matching rules the longest wins, then block before allow, then the
smaller text; the caller's rules come before the built-in globs. A URL that
nothing matches is allowed.

Defined results: a null URL, or one without ``://``, has empty host and path and
is allowed unless a pattern matches the single dot; repeated rows give repeated
results; an empty table none; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as b

# Globs of the built-in list, over the canonical form.
DEFAULT_GLOBS: tuple[tuple[str, str], ...] = (
    ("block", "**.spam-*/**"),
    ("block", "**.spam-*"),
    ("block", "**.ads-*/**"),
    ("block", "**.ads-*"),
    ("block", "**.casino-*/**"),
    ("block", "**.casino-*"),
    ("block", "**.cheap-*/**"),
    ("block", "**.cheap-*"),
    ("block", "**.free-bets*/**"),
    ("block", "**.free-bets*"),
    ("block", "**.doubleclick.*/**"),
    ("block", "**/wp-login.php"),
    ("block", "**.exe"),
)

#: URLs that run through the automaton at once, and words of state that these may hold: 16 MB an array.
STEP_ROWS, STEP_WORDS = 4096, 1 << 21


@dataclass(frozen=True)
class Rule:
    """``text`` is host followed by path; ``fits`` its canonical glob."""

    verdict: str
    text: str
    fits: str
    rank: int


def rule(line: str) -> Rule:
    """A rule from ``block host/path`` or ``allow host/path``."""
    verdict, _, text = line.strip().partition(" ")
    host, slash, path = text.partition("/")
    if verdict not in ("block", "allow") or not host:
        raise ValueError(f"not a rule: {line!r}")
    return Rule(verdict, text, f"*.{host}{slash}{path}**" if slash else f"*.{host}**", 0)


def glob(verdict: str, pattern: str) -> Rule:
    return Rule(verdict, pattern, pattern, 1)


class Automaton:
    """The bits of all patterns. Bit i of a pattern is set when its first i + 1 letters are read."""

    def __init__(self, patterns: list[str]):
        letters: list[str] = []
        loops: list[int] = []  # of the place before each letter: 0 none, 1 within a segment, 2 any
        self.last, begins, tails = [], [], []
        for p in patterns:
            begins.append(len(letters))
            loop, i = 0, 0
            while i < len(p):
                if p[i] == "*":
                    loop, i = max(loop, 2 if p[i : i + 2] == "**" else 1), i + (2 if p[i : i + 2] == "**" else 1)
                    continue
                letters.append(p[i])
                loops.append(loop)
                loop, i = 0, i + 1
            tails.append(loop)
            self.last.append(len(letters) - 1)
        self.words = max(1, -(-len(letters) // 64))
        self.alphabet = np.array(sorted({ord(c) for c in letters} | {ord("/")}), dtype=np.uint32)
        classes = len(self.alphabet) + 1  # the last is any other character
        slash = int(np.searchsorted(self.alphabet, ord("/")))
        self.fits = np.zeros((classes, self.words), dtype=np.uint64)
        self.stays = np.zeros((classes, self.words), dtype=np.uint64)
        self.first = np.zeros(self.words, dtype=np.uint64)  # may start at the first character
        self.again = np.zeros((classes, self.words), dtype=np.uint64)  # a leading wildcard that still holds
        at_start = np.zeros(self.words, dtype=np.uint64)
        self.lead_segment = np.zeros(self.words, dtype=np.uint64)
        self.lead_any = np.zeros(self.words, dtype=np.uint64)
        starts = set(begins)
        for i, c in enumerate(letters):
            word, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
            self.fits[np.searchsorted(self.alphabet, ord(c)), word] |= bit
            if i in starts:
                at_start[word] |= bit
                if loops[i] == 1:
                    self.lead_segment[word] |= bit
                elif loops[i] == 2:
                    self.lead_any[word] |= bit
            elif loops[i]:
                # The place before letter i is bit i - 1: it stays while the wildcard reads.
                w, b = (i - 1) // 64, np.uint64(1) << np.uint64((i - 1) % 64)
                for k in range(classes):
                    if loops[i] == 2 or k != slash:
                        self.stays[k, w] |= b
        for p, loop in enumerate(tails):
            i = self.last[p]
            w, b = i // 64, np.uint64(1) << np.uint64(i % 64)
            for k in range(classes):
                if loop == 2 or (loop == 1 and k != slash):
                    self.stays[k, w] |= b
        self.first = at_start
        self.slash = slash
        self.carry = ~at_start  # a shift may not move one pattern's last bit into the next

    def classes(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == points, at, len(self.alphabet)).astype(np.intp)

    def run(self, forms: list[str] | pa.Array) -> np.ndarray:
        """matches[i, p]: whether pattern p matches the whole of forms[i]."""
        data, at = b.column(forms if isinstance(forms, pa.Array) else pa.array(forms, pa.large_string()))
        # Code points of all forms, and where each form begins among them.
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
        out = np.zeros((len(at) - 1, len(self.last)), dtype=bool)
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        sizes, begins = sizes[order], first[:-1][order]
        state = np.zeros((len(sizes), self.words), dtype=np.uint64)
        open_segment = np.ones(len(sizes), dtype=bool)  # no slash read yet
        n = len(sizes)
        block, width = None, 256
        for at in range(int(sizes[0]) if n else 0):
            n = int(np.searchsorted(-sizes, -at, side="left"))  # rows longer than at
            if at % width == 0:
                places = begins[:n, None] + np.arange(at, at + width)
                block = self.classes(points[np.minimum(places, len(points) - 1)])
            k = block[:n, at % width]
            s = state[:n]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            moved &= self.carry
            begin = self.first if at == 0 else self.lead_any
            moved |= begin
            if at:
                moved |= np.where(open_segment[:n, None], self.lead_segment, np.uint64(0))
            state[:n] = (moved & self.fits[k]) | (s & self.stays[k])
            open_segment[:n] &= k != self.slash
        for p, i in enumerate(self.last):
            out[order, p] = (state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1
        return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path without query and fragment; both empty without ``://``."""
    at = F.position(F.lit("://"), url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


SCHEMA = "page_id {kind}, host string, path string, rule string, verdict string, matched string"


def judge(
    pages: DataFrame,
    rules: list[str],
    *,
    globs: tuple[tuple[str, str], ...] = DEFAULT_GLOBS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row a page: page_id, host, path, rule (null if none of ``rules`` fits), verdict, matched glob."""
    parsed = [rule(r) for r in rules] + [glob(v, p) for v, p in globs]
    ranked = sorted(parsed, key=lambda r: (r.rank, -len(r.text), r.verdict != "block", r.text))
    # The last place is that of a URL which nothing matches.
    named = [pa.array([f(r) for r in ranked] + [last], pa.string()) for f, last in ((lambda r: r.text if r.rank == 0 else None, None), (lambda r: r.verdict, "allow"), (lambda r: r.text, None))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([r.fits for r in ranked])
        step = max(1, min(STEP_ROWS, STEP_WORDS // machine.words))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                hits = machine.run(part.column(3))
                won = pa.array(np.where(hits.any(axis=1), hits.argmax(axis=1), len(ranked)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *[n.take(won) for n in named]], names=["page_id", "host", "path", "rule", "verdict", "matched"])

    kind = pages.schema[id_col].dataType.simpleString()
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return parts.withColumn("form", F.concat(F.lit("."), "host", "path")).mapInArrow(apply, SCHEMA.format(kind=kind))
