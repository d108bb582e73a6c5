"""Sinks that keep an order: results before the event that announces them, and an audit trail that a failure doesn't undo."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(results_path: str, events_path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch's results are written first, then the final state of their jobs.

    Each batch has its own folder, so a repeated batch replaces itself; no reader sees an event without its result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{results_path}/batch={batch_id}")
        stored = batch.sparkSession.read.parquet(f"{results_path}/batch={batch_id}")
        final = stored.where(F.col("status").isin("COMPLETED", "FAILED")).select("job_id", "status")
        final.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")

    return write


def audited(action: Callable[[], DataFrame | None], entries: DataFrame, path: str) -> DataFrame | None:
    """Append the entries, then act: the trail tells of an action that failed too."""
    entries.write.mode("append").parquet(path)
    return action()
