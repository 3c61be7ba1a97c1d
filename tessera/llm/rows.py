"""Whole rows through operators that must not care how their columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_struct(frame: DataFrame) -> Column:
    """All columns as one struct, ``row``."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("row")


def restored(frame: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """The columns that ``row`` holds, but for those that something else takes the place of."""
    return frame.select(*[instead.get(c, F.col("row")[c]).alias(c) for c in columns])


def filtered(frame: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows whose text a test of Arrow columns lets stand; ``make`` gives the test, once in each task."""
    at = frame.columns.index(text_col)
    numbered = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(frame.schema.fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            yield batch.filter(pa.array(test(batch.column(at))))

    return frame.toDF(*[f.name for f in numbered]).mapInArrow(run, T.StructType(numbered)).toDF(*frame.columns)
