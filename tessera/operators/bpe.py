"""Byte-pair encoding with a public vocabulary, as joins.

A vocabulary is a table of tokens (bytes) and ranks; a rank is also the token's
id. Two neighbouring tokens merge if the vocabulary has their bytes as one, the
pair of the least rank first. Texts are cut into pieces by the vocabulary's
pattern, and each distinct piece of a corpus is encoded once: a piece that is a
token is looked up, others go through merge rounds. A round joins neighbouring
tokens with the table of pairs and merges, in each piece, the leftmost pair of
the least rank; rounds of one job share one sort of the pieces, and pieces
without a pair left leave after each job. The ids are joined back by piece.

Pieces of over LONG bytes, which would need as many rounds, are merged in Arrow
batches by the same rule. The tables of tokens and pairs are bounded by the
vocabulary; nothing that is broadcast or held in a task grows with the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.template import ASSISTANT
from tessera.sources import workspace

# Fixed value: how public byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a piece that goes through rounds of joins, and rounds in one job.
LONG, ROUNDS = 64, 6


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: pairs merge in order of rank, then place."""
    parts = {i: piece[i : i + 1] for i in range(len(piece))}
    after = {i: i + 1 for i in parts}
    before = {i + 1: i for i in parts}
    heap = [(ranks[piece[i : i + 2]], i, 2) for i in range(len(piece) - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)

    def propose(i: int) -> None:
        if i in parts and after[i] in parts and (both := parts[i] + parts[after[i]]) in ranks:
            heapq.heappush(heap, (ranks[both], i, len(both)))

    while heap:
        rank, i, size = heapq.heappop(heap)
        # Parts have changed since if their bytes are not those of the rank any more.
        if i not in parts or after[i] not in parts or len(parts[i]) + len(parts[after[i]]) != size or ranks[parts[i] + parts[after[i]]] != rank:
            continue
        gone = after[i]
        parts[i] += parts.pop(gone)
        after[i] = after.pop(gone)
        before[after[i]] = i
        propose(i)
        if i in before:
            propose(before[i])
    return [ranks[parts[i]] for i in sorted(parts)]


@dataclass(frozen=True)
class Vocabulary:
    """A rank file: a line has a token in base 64 and its rank. Spark reads it, so it may stand in any store."""

    path: str
    pattern: str = PATTERN

    def table(self, spark: SparkSession) -> DataFrame:
        """(token, id)"""
        line = F.split("value", " ")
        return spark.read.text(self.path).where("value != ''").select(F.unbase64(line[0]).alias("token"), line[1].cast("int").alias("id"))

    def ranks(self, spark: SparkSession) -> dict[bytes, int]:
        """The whole table, as large as the vocabulary."""
        return {bytes(r["token"]): r["id"] for r in self.table(spark).collect()}

    def pairs(self, spark: SparkSession) -> DataFrame:
        """(left, right, both): each way to make a token of two."""
        table = self.table(spark)
        cuts = table.where(F.octet_length("token") > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), F.octet_length("token") - 1)))
        halves = cuts.select(F.col("id").alias("both"), F.expr("substring(token, 1, cut)").alias("x"), F.expr("substring(token, cut + 1)").alias("y"))
        left, right = table.toDF("x", "left"), table.toDF("y", "right")
        return halves.join(left, "x").join(right, "y").select("left", "right", "both")

    def pieces(self, text: Column) -> Column:
        # Blanks and letters are those of Unicode.
        return F.regexp_extract_all(text, F.lit(f"(?U){self.pattern}"), F.lit(0))


def _round(symbols: DataFrame, pairs: DataFrame) -> DataFrame:
    """One merge in each piece that has one; ``live`` tells whether it had. Keeps the order of piece and place."""
    line = Window.partitionBy("piece").orderBy("place")
    found = symbols.withColumn("next", F.lead("id").over(line)).join(pairs, (F.col("id") == F.col("left")) & (F.col("next") == F.col("right")), "left")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = found.withColumn("best", F.min(F.when(F.col("both").isNotNull(), F.struct("both", "place"))).over(whole))
    here = F.col("best.place") == F.col("place")
    marked = best.withColumn("gone", F.coalesce(F.lag(here).over(line), F.lit(False)))
    return marked.where(~F.col("gone")).select("piece", "place", F.when(here, F.col("both")).otherwise(F.col("id")).alias("id"), F.col("best").isNotNull().alias("live"))


def encode_pieces(pieces: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(piece, ids) of distinct pieces."""
    spark = pieces.sparkSession
    ranks = vocabulary.ranks(spark)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary {vocabulary.path} has no token for the byte {missing[0]}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = workspace.saved(vocabulary.pairs(spark), "pairs")
    coded = pieces.withColumn("token", F.encode("piece", "utf-8"))
    known = workspace.saved(coded.join(vocabulary.table(spark), "token", "left").select("piece", "token", "id"), "pieces")
    done = [known.where("id is not null").select("piece", F.array("id").alias("ids"))]

    single = F.array(*[F.lit(ranks[bytes([b])]) for b in range(256)])
    byte = F.conv(F.hex(F.expr("substring(token, place, 1)")), 16, 10).cast("int")
    short = known.where((F.col("id").isNull()) & (F.octet_length("token") <= LONG))
    symbols = short.withColumn("place", F.explode(F.sequence(F.lit(1), F.octet_length("token")))).select("piece", "place", F.get(single, byte).alias("id"))
    while True:
        symbols = symbols.repartition(n, "piece")
        for _ in range(ROUNDS):
            symbols = _round(symbols.select("piece", "place", "id"), pairs)
        state = workspace.saved(symbols, "symbols")
        done.append(state.where("not live").groupBy("piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("ids")))
        symbols = state.where("live").select("piece", "place", "id")
        if symbols.isEmpty():
            break

    sent = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [merged(token, sent.value) for token in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["piece", "ids"])

    longer = known.where((F.col("id").isNull()) & (F.octet_length("token") > LONG)).select("piece", "token")
    out = longer.mapInArrow(run, "piece string, ids array<int>")
    for part in done:
        out = out.unionByName(part)
    return out


def tokenize(texts: DataFrame, text_col: str, by: list[str], vocabulary: Vocabulary) -> DataFrame:
    """``by``, which tells rows apart, and ids: those of a null or empty text are empty."""
    cut = texts.select(*by, F.posexplode(vocabulary.pieces(F.coalesce(F.col(text_col), F.lit("")))).alias("_at", "piece"))
    known = workspace.saved(encode_pieces(cut.select("piece").distinct(), vocabulary), "encoded-pieces")
    # Each piece stands in one row of the encoded ones: adaptive execution splits those that many texts have.
    found = cut.join(known, "piece").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "ids"))).alias("_ids"))
    joined = texts.select(*by).join(found, by, "left")
    return joined.select(*by, F.coalesce(F.flatten(F.transform("_ids", lambda p: p["ids"])), F.array().cast("array<int>")).alias("ids"))


@dataclass(frozen=True)
class Chat:
    """A chat layout over a vocabulary: open mark, role, line end, content, close mark, line end.

    Marks are ids of their own; a mark's text within a content is ordinary text.
    """

    vocabulary: Vocabulary
    marks: dict[str, int] = field(hash=False)
    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    pad: str = "<|endoftext|>"

    @cached_property
    def pad_id(self) -> int:
        if self.pad not in self.marks:
            raise ValueError(f"tokenizer.special_tokens has no id for the padding mark {self.pad}")
        return self.marks[self.pad]

    def rendered(self, df: DataFrame, *, spans: bool = True, longest: int | None = None) -> DataFrame:
        """Adds ids, spans, prompt and error, as an adapter does; every turn is encoded once."""
        spark = df.sparkSession
        ranks = self.vocabulary.ranks(spark)
        # What a turn ends in, and what asks for a reply; both are one or two pieces.
        line_end = merged(b"\n", ranks)
        asks = merged(ASSISTANT.encode(), ranks) + line_end
        ints = lambda ids: F.array(*[F.lit(i) for i in ids]).cast("array<int>")
        rows = workspace.saved(df.withColumn("_row", F.monotonically_increasing_id()), "turns")
        text = F.posexplode(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["content"])))
        turns = rows.where("turns is not null").select("_row", text.alias("_turn", "_text"))
        coded = tokenize(turns, "_text", ["_row", "_turn"], self.vocabulary)
        whole = lambda ids: F.concat(ints([self.marks[self.open]]), ids, ints([self.marks[self.close], *line_end]))
        lined = coded.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_turn", "ids"))), lambda t: t["ids"]).alias("_ids"))
        out = rows.join(lined, "_row", "left").withColumn("ids", F.flatten(F.transform("_ids", whole)))

        added = 2 + len(line_end)
        each = F.arrays_zip(F.transform("turns", lambda m: m["role"] == ASSISTANT).alias("said"), F.col("_ids").alias("ids"))

        def step(state: Column, turn: Column) -> Column:
            start, end = state["at"] + 1 + len(asks), state["at"] + F.size(turn["ids"]) + added
            span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
            stable = F.slice(turn["ids"], 1, len(asks)) == ints(asks)
            return F.struct(
                end.cast("int").alias("at"),
                F.when(turn["said"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
                (state["stable"] & (~turn["said"] | stable)).alias("stable"),
                stable.alias("last"),
            )

        none = F.array().cast("array<struct<start:int,end:int>>")
        zero = F.struct(F.lit(0).alias("at"), none.alias("spans"), F.lit(True).alias("stable"), F.lit(False).alias("last"))
        walk = F.aggregate(each, zero, step)
        out = out.withColumn("_walk", F.when(F.col("turns").isNotNull(), walk))
        start = F.size("ids") - F.size(F.element_at("_ids", -1)) - added + 1 + len(asks)
        prompt = F.when(F.col("_walk.last"), start).cast("int")
        if not spans:
            return out.withColumns({"spans": none, "prompt": prompt, "error": F.lit(None).cast("string")}).drop("_row", "_ids", "_walk")
        first = F.get("turns", F.lit(0))["role"] == ASSISTANT
        error = F.when(first, "assistant_first").when(~F.col("_walk.stable"), "prefix_unstable")
        return out.withColumns({"error": error, "prompt": prompt}).withColumn("spans", F.when(F.col("error").isNull(), F.col("_walk.spans")).otherwise(none)).drop("_row", "_ids", "_walk")


def from_recipe(section: dict) -> Chat | None:
    """The layout that a recipe's ``tokenizer`` section asks for by ``ranks``; None where it names no vocabulary."""
    if not section.get("ranks"):
        return None
    layout = {k: section[k] for k in ("open", "close", "pad") if section.get(k)}
    chat = Chat(Vocabulary(section["ranks"], section.get("pattern") or PATTERN), dict(section.get("special_tokens") or {}), **layout)
    for mark in (chat.open, chat.close):
        if mark not in chat.marks:
            raise ValueError(f"tokenizer.special_tokens has no id for {mark}")
    return chat
