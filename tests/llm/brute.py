"""Plain versions of the contracts, to hold the distributed ones against."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text: str | None) -> dict:
    text, found = text or "", []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                found.append((m.start(), rank, kind, m.end()))
    found.sort()
    out = {f"n_{k}": sum(x[2] == k for x in found) for k in PII}
    line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    return out | {"base_sha256": hashlib.sha256(line.encode()).hexdigest(), "base": line}


def line_dedup(rows: list[tuple[int, str | None]], drop_empty: bool = True) -> dict[int, str | None]:
    """Texts by id (ids are unique): lines of a pair that stands earlier, and does not overlap its first place, are left out."""
    first: dict[str, tuple[int, int]] = {}
    gone: dict[int, set[int]] = {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [k for k, x in enumerate(lines) if WORD.search(x)]
        for a, z in zip(full, full[1:], strict=False):
            at = first.setdefault("\n".join(lines[a : z + 1]), (i, z))
            if not (at[0] == i and a <= at[1]):
                gone.setdefault(i, set()).update(range(a, z + 1))
    out = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if i in gone else t for i, t in rows}
    return {i: out[i] for i, t in rows if not (drop_empty and i in gone and len(gone[i]) == len(t.split("\n")))}


def near_dups(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """(set size, least reachable id) by id, from all pairs."""
    sets = {}
    for i, text in rows:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                same = len(x & y)
                if 100 * same >= percent * (len(x) + len(y) - same):
                    one, two = sorted((root(i), root(j)))
                    parent[two] = one
    return {i: (len(sets[i]), root(i)) for i in ids}


def word_rules(text: str | None) -> dict:
    from collections import Counter

    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dups,
        "n_repeat_words": r,
        "base_failed": n < 50 or 100 * r > 50 * n,
    }


def repeats(rows: list[tuple[int, str | None]], length: int = 400) -> dict[int, tuple[int, int, int, str]]:
    """(bytes, removed, spans, sha256 of the rest) by id."""
    from collections import Counter

    texts = {i: (t or "").encode() for i, t in rows}
    seen: Counter = Counter()
    for raw in texts.values():
        seen.update(hash(raw[s : s + length]) for s in range(len(raw) - length + 1))
    out = {}
    for i, raw in texts.items():
        gone, until, spans = 0, 0, 0
        kept = []
        for s in range(len(raw) - length + 1):
            if seen[hash(raw[s : s + length])] > 1:
                if s > until or until == 0:
                    kept.append(raw[until:s])
                    spans += 1
                    gone += length
                else:
                    gone += s + length - until
                until = s + length
        kept.append(raw[until:])
        out[i] = (len(raw), gone, spans, hashlib.sha256(b"".join(kept)).hexdigest())
    return out


def passages(rows: list[tuple[int, str | None]], size: int = 51) -> dict[int, int]:
    """By id, the runs of words whose windows of ``size`` words all stand anywhere else; windows that overlap or touch make one."""
    from collections import Counter

    words = {i: WORD.findall(t or "") for i, t in rows}
    windows = lambda w: [tuple(w[s : s + size]) for s in range(len(w) - size + 1)]
    seen = Counter(x for w in words.values() for x in windows(w))
    out = {}
    for i, w in words.items():
        until, n = -1, 0
        for s, x in enumerate(windows(w)):
            if seen[x] > 1:
                n += s > until
                until = s + size
        out[i] = n
    return out
