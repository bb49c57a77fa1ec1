"""Run a stream to the end of its available input, with state in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def to_folder(out: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that replaces its own folder, so a repeated batch leaves no duplicates."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def drain(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
          mode: str = "append") -> None:
    """Process everything available now and stop; a later call goes on from the checkpoint."""
    stream = df.writeStream.foreachBatch(write).outputMode(mode).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
