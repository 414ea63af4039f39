"""Feeding tables from streams. The engine's queries themselves are batch queries."""

from relspark.streaming.ingest import stream_into

__all__ = ["stream_into"]
