"""Line dedup by content-defined chunks of lines.

Only DataFrame functions run here. A cyclic rolling hash over the hashes of the
last ``WINDOW`` lines with text (and the blank lines between them) runs along
each text. Its low ``MASK`` bits choose where chunks end, so that limits depend
on the lines of the window alone and stand at the same places of a passage
whatever stands around it. Of a passage of k lines, k - WINDOW + 1 windows lie
within it; so that passages of two lines are found, MASK is 0: each window is a
limit, and the chunk that ends there is the window itself.

Chunks that occur again anywhere are compared byte for byte with the first
occurrence (least doc_id, then place) and removed if equal. Repeated chunks that
overlap or touch join into runs, so a repeated passage of two or more lines
goes whole. First occurrences stay, except for lines that are part of a repeat
as well; a chunk that shares a line with its own first occurrence is not a
repeat of it. Every line that is removed stays at its first place in the corpus.

Hashes are counted without texts; only chunks whose hash repeats carry bytes.
A chunk that makes up a HOT-th or more of all repeated ones is dealt to as many
more tasks by a salt: such chunks are at most HOT, which bounds what is broadcast
of them, and their bytes are repeated at most HOT times more in all.

Defined results: a null text stays null; an empty text stays empty; rows equal
in id and text count as one document and get the same result; documents that
lose every line are dropped when ``drop_empty`` is set, else have an empty text;
a text of any length is cut whole; an empty table gives no rows; other columns are
handed on unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import rows, scratch

WINDOW = 2
MASK = 0  # chunks end where these bits of the rolling hash are zero: here at each line
HOT = 1000


def _rolled(hashes: Column) -> Column:
    """The cyclic hash of a window of line hashes."""
    turned = lambda h: F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda rolled, h: turned(rolled).bitwiseXOR(h))


def _has_text(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def _chunks(texts: DataFrame) -> DataFrame:
    """(_id, _key, _start, _end, _hash) of each chunk: WINDOW lines with text that end where the rolling hash sets a limit."""
    lined = (
        texts.withColumn("_lines", F.split("_text", "\n", -1))
        .withColumn("_hashes", F.transform("_lines", lambda x: F.xxhash64(x)))
        .withColumn("_full", F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1), lambda i: _has_text(F.get("_lines", i))))
    )
    firsts = F.slice("_full", F.lit(1), F.greatest(F.size("_full") - (WINDOW - 1), F.lit(0)))
    end = lambda k: F.get("_full", k + (WINDOW - 1)) + 1
    chunk = lambda start, k: F.struct(start.alias("start"), end(k).alias("end"), _rolled(F.slice("_hashes", start + 1, end(k) - start)).alias("hash"))
    every = F.transform(firsts, chunk)
    limits = F.filter(every, lambda c: c["hash"].bitwiseAND(F.lit(MASK)) == 0) if MASK else every
    return lined.select("_id", "_key", F.explode(limits).alias("_c")).select("_id", "_key", F.col("_c.start").alias("_start"), F.col("_c.end").alias("_end"), F.col("_c.hash").alias("_hash"))


def _slice(start: Column, end: Column) -> Column:
    return F.slice("_lines", start + 1, end - start)


def remove_repeats(
    documents: DataFrame, *, drop_empty: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with repeated runs of two or more lines taken out of ``text_col``."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = documents.select(F.col(id_col).alias("_id"), key.alias("_key"), F.col(text_col).alias("_text"))
    keyed = keyed.where(F.contains("_text", F.lit("\n")))

    spans = _chunks(keyed)
    repeated = (
        spans.groupBy("_hash")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_key", "_start", "_end")).alias("_first"))
        .where("_n > 1")
        .select(F.col("_hash").alias("_h"), "_first", "_n")
    )
    repeated = scratch.saved(repeated, "repeated")
    total = repeated.agg(F.sum("_n").alias("n")).first()["n"] or 1
    parts = F.ceil(F.col("_n") * HOT / F.lit(total)).cast("int")
    hot = F.broadcast(repeated.where(F.col("_n") * HOT >= total).select(F.col("_h").alias("_hot"), parts.alias("_parts")))
    # Bytes of the first occurrence of each repeated hash.
    firsts = repeated.select("_h", F.col("_first._id").alias("_id"), F.col("_first._key").alias("_key"), F.col("_first._start").alias("_start"), F.col("_first._end").alias("_end"))
    texts = keyed.select(F.col("_key").alias("_k"), F.col("_id").alias("_i"), "_text")
    text_of = F.array_join(_slice(F.col("_start"), F.col("_end")), "\n")
    # A merge join at every size: a broadcast of the firsts is no choice where they are many, and plans are alike.
    first_text = (
        firsts.hint("merge").join(texts, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")))
        .withColumn("_lines", F.split("_text", "\n", -1))
        .select("_h", F.struct("_id", "_key", "_end").alias("_place"), text_of.alias("_first_text"))
        .join(hot, F.col("_h") == F.col("_hot"), "left")
        .withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_hot", "_parts")
        .dropDuplicates(["_h", "_s"])
    )
    salt = F.coalesce(F.pmod(F.xxhash64("_id", "_key", "_start"), F.col("_parts")), F.lit(0)).cast("int")
    salted = spans.join(hot, F.col("_hash") == F.col("_hot"), "left").withColumn("_salt", salt)
    # The first occurrence has the least start of its document, so what starts before its end is it or overlaps it.
    own = F.struct("_id", "_key").eqNullSafe(F.struct("_place._id", "_place._key")) & (F.col("_start") < F.col("_place._end"))
    later = (
        salted.join(first_text, (F.col("_hash") == F.col("_h")) & (F.col("_salt") == F.col("_s")) & ~own)
        .groupBy(F.col("_id").alias("_i"), F.col("_key").alias("_k"))
        .agg(F.collect_set(F.struct("_start", "_end", "_first_text")).alias("_later"))
    )
    # The caller's columns travel in one struct, so that their names cannot clash with those used here.
    text = F.col("row")[text_col]
    out = documents.select(rows.as_struct(documents), key.alias("_key")).join(later, (F.col("_key") == F.col("_k")) & F.col("row")[id_col].eqNullSafe(F.col("_i")), "left")
    out = out.withColumn("_lines", F.split(F.when(F.col("_later").isNotNull(), text), "\n", -1))
    equal = F.filter("_later", lambda c: F.array_join(_slice(c["_start"], c["_end"]), "\n") == c["_first_text"])
    out = out.withColumn("_gone", F.flatten(F.transform(equal, lambda c: F.sequence(c["_start"], c["_end"] - 1))))
    out = out.withColumn("_kept", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"))
    rebuilt = F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n")
    done = F.struct(F.when(F.size("_gone") > 0, rebuilt).otherwise(text).alias("text"), (F.size("_kept") == 0).alias("empty"))
    # A generator keeps the filter above it: pushed down, it would bring the whole chunking into each of its terms.
    out = out.withColumn("_done", F.explode(F.array(done)))
    if drop_empty:
        out = out.where(~F.coalesce("_done.empty", F.lit(False)))
    return rows.restored(out, documents.columns, **{text_col: F.col("_done.text")})
