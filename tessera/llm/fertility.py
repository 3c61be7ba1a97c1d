"""Quality rules on words and lines, and on how public tokenisers take a text.

Fertility measures, from each vocabulary: characters per token, the share of
tokens that are single bytes (fallback bytes where a vocabulary has them), and
the entropy of the text's tokens as a share of the greatest for as many tokens.
Words are tokenised one by one, each distinct word once a block of texts.

A text is rejected outside either of two kinds of bands:

* fixed bands of its script, the one that most of its letters belong to, on the
  first vocabulary: what no text of the script comes near;
* bands of its language (its script where that is null or absent) and its number
  of words to the power of two, on every measure of every vocabulary: SPREADS
  spreads around the median of all documents of the kind that pass all other
  rules, where a spread is that of a normal law with the same quartiles. Counts
  cover all documents, in bins of STEP. A kind of under LEAST_DOCS documents has
  the bands of its script at the same size, or else at its size and the next two
  (sizes by threes); where these are under LEAST_DOCS as well, nothing says what
  is usual, and there are none.

Vocabulary files are read on the driver and handed to the executors as bytes.

Defined results: a null or empty text has no words, so it fails the base rules;
a text of any length is read whole, one word of any length as one; repeated rows
count as rows of their own and get repeated results; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bytescan as b
from tessera.llm import scratch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
VOCABULARIES = (VOCABULARY, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SPREADS = 5.0
LEAST_DOCS = 50
STEP = 0.001
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte-fallback share, least entropy share."""

    low: float
    high: float
    bytes_share: float
    entropy: float


# Bands of each script for a vocabulary of mostly European words.
BANDS = {
    "latin": Band(1.5, 8.0, 0.05, 0.40),
    "cyrillic": Band(1.0, 8.0, 0.10, 0.40),
    "greek": Band(0.7, 8.0, 0.20, 0.40),
    "cjk": Band(0.3, 3.0, 0.90, 0.40),
    "other": Band(0.2, 8.0, 0.95, 0.35),
}
_SCRIPTS = list(BANDS)

# The script of a letter by its first UTF-8 byte.
_SCRIPT = np.full(256, -1, dtype=np.int64)
_SCRIPT[65:91] = _SCRIPT[97:123] = 0
_SCRIPT[0xC3:0xCA] = 0
_SCRIPT[0xD0:0xD4] = 1
_SCRIPT[0xCD:0xD0] = 2
_SCRIPT[0xE3:0xEE] = 3
_SCRIPT[0xD4:0xE3] = 4
_SCRIPT[0xC2] = -1
_SCRIPT[0xE2] = -1
_LEADING = (np.arange(256) & 0xC0) != 0x80
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


class Words:
    """Token ids of words by a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.size)])

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.pieces.encode(words, num_threads=1)

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first index of each word (n + 1)."""
        found = self.encode([w.decode("utf-8", "replace") for w in words])
        first = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=first[1:])
        return np.fromiter(chain.from_iterable(found), np.int64, int(first[-1])), first


class ByteWords(Words):
    """Token ids of words by a byte-level vocabulary of (token, rank) lines; a word is never split before."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.pieces = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=pairs, special_tokens={})
        self.size = max(pairs.values()) + 1
        self.is_byte = np.zeros(self.size, dtype=bool)
        self.is_byte[[rank for token, rank in pairs.items() if len(token) == 1]] = True

    def encode(self, words: list[str]) -> list[list[int]]:
        return [self.pieces.encode_ordinary(w) for w in words]


def vocabulary(path: str, content: bytes) -> Words:
    return ByteWords(content) if path.endswith(".tiktoken") else Words(content)


def _repeats(tags: np.ndarray) -> np.ndarray:
    """Whether each tag stands elsewhere as well, and whether it stood earlier: (n, 2)."""
    out = np.zeros((len(tags), 2), dtype=bool)
    if len(tags) > 1:
        order = np.argsort(tags, kind="stable")
        ordered = tags[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(tags), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[order, 0] = twice
        out[order[1:], 1] = same
    return out


def _tag(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return h ^ b.mix(rows.astype(np.uint64) + np.uint64(1))


def _fertility(words: Words, distinct: list[bytes], pair_row: np.ndarray, pair_word: np.ndarray, times: np.ndarray, chars: np.ndarray, n_rows: int) -> dict[str, np.ndarray]:
    """n_tokens and the measures of each row, from how often it has each distinct word."""
    ids, token_first = words.tokens(distinct)
    per_word = np.diff(token_first)
    byte_words = b.per_row(words.is_byte[ids], token_first)
    n_tokens = np.bincount(pair_row, per_word[pair_word] * times, n_rows).astype(np.int64)
    n_bytes = np.bincount(pair_row, byte_words[pair_word] * times, n_rows)
    size = per_word[pair_word]
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(token_first[pair_word], size)
    key = np.repeat(pair_row, size) * words.size + ids[place]
    weight = np.repeat(times, size)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.add.reduceat(weight, cut).astype(np.float64) if len(cut) else np.zeros(0)
    count_rows = key[cut] // words.size
    share = counts / np.maximum(n_tokens[count_rows], 1)
    entropy = np.bincount(count_rows, -share * np.log2(share), n_rows)
    return {
        "n_tokens": n_tokens,
        "chars_per_token": chars / np.maximum(n_tokens, 1),
        "byte_share": n_bytes / np.maximum(n_tokens, 1),
        "entropy_share": entropy / np.maximum(np.log2(np.maximum(n_tokens, 2)), 1e-9),
    }


def measure(data: np.ndarray, at: np.ndarray, words: Words, *others: Words) -> dict[str, np.ndarray]:
    """Counts, measures (of further vocabularies with their number) and the verdict of the fixed bands, for each text."""
    n_rows = len(at) - 1
    starts, ends, first = b.words(data, at)
    n = np.diff(first)
    rows = np.repeat(np.arange(n_rows), n)
    h = b.hashes(data, starts, ends)
    leading = np.concatenate([[0], np.cumsum(_LEADING[data])])
    chars = b.per_row(leading[ends] - leading[starts], first)
    # Words in three-word windows that the text has twice or more.
    grams, gram_rows = b.window_hashes(h, first, 3)
    twice = _repeats(_tag(grams, gram_rows))[:, 0]
    covered = np.zeros(len(h) + 3, dtype=bool)
    at_word = np.flatnonzero(twice)
    at_word = at_word + _window_shift(first, gram_rows)[at_word]
    for i in range(3):
        covered[at_word + i] = True
    ls, le, lf = b.lines(data, at)
    line_rows = np.repeat(np.arange(n_rows), np.diff(lf))
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    lh, lr = b.hashes(data, ls[full], le[full]), line_rows[full]
    earlier = _repeats(_tag(lh, lr))[:, 1]
    out = {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": b.per_row(_SYMBOL[data], at),
        "n_dup_lines": np.bincount(lr, earlier, n_rows).astype(np.int64),
        "n_repeat_words": b.per_row(covered[: len(h)], first),
    }
    out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    # Each distinct word of the block is tokenised once.
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    distinct = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    # Counts of (row, distinct word), from which the counts of tokens follow.
    pair, times = np.unique(rows.astype(np.int64) * max(1, len(where)) + which, return_counts=True)
    pair_row, pair_word = pair // max(1, len(where)), pair % max(1, len(where))
    for k, words in enumerate((words, *others)):
        got = _fertility(words, distinct, pair_row, pair_word, times, chars, n_rows)
        out |= {name if k == 0 else f"{name}_{k + 1}": values for name, values in got.items()}
    scripts = np.stack([b.per_row(_SCRIPT[data] == k, at) for k in range(len(_SCRIPTS))])
    script = scripts.argmax(axis=0)
    script[scripts.sum(axis=0) == 0] = len(_SCRIPTS) - 1
    band = np.array([[v.low, v.high, v.bytes_share, v.entropy] for v in BANDS.values()])[script]
    fits = (out["chars_per_token"] >= band[:, 0]) & (out["chars_per_token"] <= band[:, 1])
    fits &= (out["byte_share"] <= band[:, 2]) & (out["entropy_share"] >= band[:, 3])
    out["kept"] = ~out["base_failed"] & fits
    out["script"] = script
    return out


def _window_shift(first: np.ndarray, gram_rows: np.ndarray) -> np.ndarray:
    """What to add to a window's index to get the index of its first word."""
    per = np.bincount(gram_rows, minlength=len(first) - 1)
    return (first[:-1] - (np.cumsum(per) - per))[gram_rows]


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
_MEASURES = ("chars_per_token", "byte_share", "entropy_share")


def _bands(measured: DataFrame, names: list[str]) -> DataFrame:
    """(_k, _s, _c, _limits) of each kind of text, size and script, from all documents that pass the other rules."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.round(F.col(n) / STEP).cast("long").alias("bin")) for n in names]))
    kept = measured.where("kept").select("_kind", "_size", "script", values.alias("_v")).groupBy("_kind", "_size", "script", "_v.measure", "_v.bin").agg(F.count(F.lit(1)).alias("n"))
    script = F.concat(F.lit("script "), "script")
    # From the kind itself to wider ones, each a few rows for each kind, size and script.
    wider = F.array(*[F.struct(F.lit(k).alias("level"), of.alias("of"), size.cast("int").alias("size")) for k, (of, size) in enumerate(((F.col("_kind"), F.col("_size")), (script, F.col("_size")), (script, F.floor(F.col("_size") / 3))))])
    bins = kept.withColumn("_w", F.explode(wider)).groupBy("_w.level", "_w.of", "_w.size", "measure", "bin").agg(F.sum("n").alias("n"))
    # A group has as many rows as bins at most, whatever the number of documents.
    group = Window.partitionBy("level", "of", "size", "measure")
    up_to = F.sum("n").over(group.orderBy("bin"))
    quartile = lambda q: F.min(F.when(F.col("up_to") >= F.col("total") * q, F.col("bin"))).alias(f"q{round(q * 4)}")
    found = (
        bins.withColumns({"up_to": up_to, "total": F.sum("n").over(group)})
        .where(F.col("total") >= LEAST_DOCS)
        .groupBy("level", "of", "size", "measure")
        .agg(quartile(0.25), quartile(0.5), quartile(0.75))
    )
    # The quartiles of a normal law are 1.349 spreads apart.
    reach = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(1.0)) * SPREADS
    limits = F.struct("measure", ((F.col("q2") - reach) * STEP).alias("low"), ((F.col("q2") + reach) * STEP).alias("high"))
    limits = found.groupBy("level", "of", "size").agg(F.collect_list(limits).alias("_limits"))
    kinds = measured.select("_kind", "_size", "script").distinct().withColumn("_w", F.explode(wider)).select("_kind", "_size", "script", "_w.*")
    nearest = kinds.join(limits, ["level", "of", "size"]).groupBy("_kind", "_size", "script").agg(F.min_by("_limits", "level").alias("_limits"))
    return nearest.select(F.col("_kind").alias("_k"), F.col("_size").alias("_s"), F.col("script").alias("_c"), "_limits")


def rules(documents: DataFrame, *, vocabularies: tuple[str, ...] = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: the counts, base_failed, kept, the measures of each vocabulary and the script."""
    files = [(path, Path(path).read_bytes()) for path in vocabularies]
    names = [m if k == 0 else f"{m}_{k + 1}" for k in range(len(files)) for m in _MEASURES]
    columns = [*_LONGS, "base_failed", "kept", *names, "script"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [vocabulary(*f) for f in files]
        for batch in batches:
            for i, j, data, at in b.chunks(batch.column(2), _BLOCK_BYTES):
                m = measure(data, at, *words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        *[pa.array(m[c].astype(np.int64)) for c in _LONGS],
                        pa.array(m["base_failed"]),
                        pa.array(m["kept"]),
                        *[pa.array(m[c].astype(np.float64)) for c in names],
                        pa.array([_SCRIPTS[k] for k in m["script"]], pa.string()),
                    ],
                    names=["doc_id", "_kind", *columns],
                )

    kind = documents.schema[id_col].dataType.simpleString()
    types = [f"{c} long" for c in _LONGS] + ["base_failed boolean", "kept boolean"] + [f"{c} double" for c in names] + ["script string"]
    lang = F.col(lang_col).cast("string") if lang_col in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.col(id_col), lang.alias("_kind"), text_col).mapInArrow(run, f"doc_id {kind}, _kind string, {', '.join(types)}")
    size = F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")
    rows = scratch.saved(rows.withColumns({"_kind": F.coalesce("_kind", F.concat(F.lit("script "), "script")), "_size": size}), "measured")
    bands = scratch.saved(_bands(rows, names), "bands")
    value = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    inside = F.forall("_limits", lambda x: value[x["measure"]].between(x["low"], x["high"]))
    # Kinds of text are a small table, which Spark broadcasts by its size; hot kinds are split where it does not.
    judged = rows.join(bands, (F.col("_kind") == F.col("_k")) & (F.col("_size") == F.col("_s")) & F.col("script").eqNullSafe(F.col("_c")), "left")
    return judged.withColumn("kept", F.col("kept") & F.coalesce(inside, F.lit(True))).select("doc_id", *columns)
