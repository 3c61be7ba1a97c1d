"""Structured Streaming forms of encoding, packing and transcript sampling."""
