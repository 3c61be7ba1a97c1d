"""Clean-up of generated replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's strip() also takes the four separators U+001C to U+001F.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def clean_reply(text: Column) -> Column:
    """Without at most one end marker, then without white space at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(<\|im_end\|>|<\|endoftext\|>)\z", ""), _EDGES, "")


def visible_reply(text: Column) -> Column:
    """Without an empty reasoning block at the start."""
    return F.regexp_replace(text, r"(?U)\A<think>[\s\x1c-\x1f]*</think>[\s\x1c-\x1f]*", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")
