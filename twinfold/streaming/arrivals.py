"""Checking records as they arrive: the batch check, once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.resolve import Resolution, check_incoming


def check_arrivals(arrivals: DataFrame, found: Resolution, folder: str, report: DataFrame,
                   threshold: float | None = None) -> DataStreamWriter:
    """A stream writer that stores the verdicts on ``arrivals`` (with ``unique_id``) under
    ``folder``, one sub-folder per batch, so a repeated batch replaces itself. ``report``
    is the written report of the run."""

    def check(batch: DataFrame, number: int) -> None:
        checked = check_incoming(batch, found, report, threshold)
        checked.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return arrivals.writeStream.foreachBatch(check)
