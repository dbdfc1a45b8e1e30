"""Exact deduplication of arriving chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import storage


def new_chunks(stream: DataFrame, size: int, data: str = "bytes", ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Chunks of a stream of objects that have not arrived before.

    With a time column, hashes are forgotten once they are older than the
    watermark, so state stays bounded; without, it grows with distinct chunks.
    """
    rows = storage.chunks(stream, size, data).drop("chunk")
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(["sha256"]) if ts else rows.dropDuplicates(["sha256"])
