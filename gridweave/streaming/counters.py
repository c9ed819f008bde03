"""Running confusion counts over a stream of cells: beyond the batch engine's scope, with the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridweave.operators.pixels import counted, finished


def running_counts(cells: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    """Counts and ratios by keys of a streaming frame (byte, truth); sums merge, so no watermark is needed in update mode."""
    return finished(counted(cells, *keys, threshold=threshold))


def started(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """An update-mode query into the in-memory table name."""
    return counts.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
