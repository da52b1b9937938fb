"""Groups of rows in tasks of bounded size: a grid over crowded keys, whole groups from batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.scratch import materialize

MOST_BROADCAST = 100_000  # rows of (key, stripes) that may be broadcast; beyond, a shuffled join


def gridded(rows: DataFrame, key: str, item: str, limit: int) -> DataFrame:
    """Add ``cell_a``, ``cell_b`` and ``stripe`` so that every pair of rows with one key meets
    in exactly one cell (key, cell_a, cell_b), and a cell holds about 2 * ``limit`` rows.

    A key of n rows gets ceil(n / limit) stripes by a hash of the item; a row is copied to the
    cells of its stripe with every other stripe. Usual keys have one stripe, so one copy.
    Within a cell a != b only pairs across the two stripes count.
    """
    crowded = materialize(
        rows.groupBy(key).count().where(F.col("count") > limit)
        .select(key, F.ceil(F.col("count") / limit).cast("int").alias("stripes")), "crowded")
    found = crowded.count()
    if not found:
        zero = F.lit(0)
        return rows.select("*", zero.alias("stripe"), zero.alias("cell_a"), zero.alias("cell_b"))
    side = F.broadcast(crowded) if found <= MOST_BROADCAST else crowded
    striped = rows.join(side, key, "left").withColumn("stripes", F.coalesce("stripes", F.lit(1)))
    striped = striped.withColumn("stripe", F.pmod(F.xxhash64(item), F.col("stripes")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))
    return striped.withColumn("other", other).select(
        *rows.columns, "stripe", F.least("stripe", "other").alias("cell_a"),
        F.greatest("stripe", "other").alias("cell_b"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups, with the row numbers where groups begin and the end.

    The batches come sorted by the (non-null, integer) keys. Rows of the last group wait for
    the next batch, so memory is a batch and a group.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if waiting:
            last, first = waiting[-1], batch
            same = all(last[k][last.num_rows - 1] == first[k][0] for k in keys)
            if same and len(starts) == 1:
                waiting.append(batch)
                continue
            cut = (starts[1] if len(starts) > 1 else batch.num_rows) if same else 0
            if cut:
                waiting.append(batch.slice(0, int(cut)))
            yield _table(waiting, keys)
            batch = batch.slice(int(cut))
            if not batch.num_rows:
                waiting = []
                continue
            starts = _starts(batch, keys)
        if len(starts) > 1:
            yield _table([batch.slice(0, int(starts[-1]))], keys)
        waiting = [batch.slice(int(starts[-1]))]
    if waiting:
        yield _table(waiting, keys)


def _starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        column = rows[k].to_numpy() if isinstance(rows, pa.Table) else rows[k].to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _table(parts: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    return table, np.append(_starts(table, keys), table.num_rows)
