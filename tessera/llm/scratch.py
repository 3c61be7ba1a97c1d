"""Saved tables, as the rest of the library has them."""

from tessera.sources.workspace import clean, free, saved, tables

__all__ = ["clean", "free", "saved", "tables"]
