"""Bounded samples of labelled rows for fitting on the driver."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on.
TRAIN_ROWS = 20_000


def bucket(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text modulo ``parts`` (null: as the empty text)."""
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % parts


def part(id_col: str, parts: int) -> Column:
    """The same as ``bucket`` for a column, in the JVM."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % parts


def _texts(documents: DataFrame, few: DataFrame) -> DataFrame:
    """The few ids with their text; of rows that share an id, the least text."""
    rows = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return rows.groupBy(*few.columns).agg(F.min("text").alias("text")).select("doc_id", "text", *few.columns[1:])


def training_sample(documents: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled documents outside the held-out part.

    The rows with the least hash of their id are taken, so reruns agree. The
    labels that are joined are at most ``rows`` rows, whence the broadcast.
    Repeated label rows give one row with the greatest label; a label without a
    document and a null label give none.
    """
    few = (
        labels.select("doc_id", F.col(label).cast("double").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (part("doc_id", parts) != held_out))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    return _texts(documents, few)


def unlabelled_sample(documents: DataFrame, parts: int, held_out: int, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and text of at most ``rows`` documents of all outside the held-out part, with a label or not: those with the least hash of their id."""
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull() & (part("doc_id", parts) != held_out))
    return _texts(documents, ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct())
