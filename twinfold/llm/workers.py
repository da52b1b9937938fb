"""Keeping Python workers small. Spark reuses a worker from task to task and from stage to stage, so what
one leaves in memory stays beside all that follows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from twinfold.sources.package import ship_package

_BATCH_SETTING, _USUAL, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and have texts come in batches of ``BATCH_BYTES`` rather than of 64 MB, so that
    memory does not hang on their length. A size that the session has set itself is kept."""
    ship_package(spark)
    try:
        if spark.conf.get(_BATCH_SETTING) == _USUAL:
            spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    except PySparkException:  # a Spark that knows no such setting
        pass


def give_back() -> None:
    """Return freed memory to the system, which the allocators would keep for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator[Any]], Iterator[Any]], *forget: Callable[[], None]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """``run`` over the batches of a task; at its end ``forget`` is called and freed memory given back."""
    def whole(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            for clear in forget:
                clear()
            give_back()

    return whole


def sliced(batch: pa.RecordBatch, column: int, most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most_rows`` rows and about ``most_bytes`` of the texts in a column,
    one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = upto[start - 1] if start else 0
        stop = int(np.searchsorted(upto, done + most_bytes, side="right"))
        stop = min(max(stop, start + 1), start + most_rows)
        yield batch.slice(start, stop - start)
        start = stop
