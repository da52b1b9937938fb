"""Joining a large table, some of whose keys may be very frequent, to one row per key."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_HOT_ROWS = 200_000
HOT_SHARE = 1000  # a hot key holds over 1/1000 of the rows, so there are under 1000
# A task that counts or deals out rows holds their keys in memory: about this many at most.
TASK_KEYS = 250_000


def in_small_tasks(df: DataFrame, keys: int = 1, rows: int | None = None) -> DataFrame:
    """``df``, each row of which makes ``keys`` keys, in tasks of about ``TASK_KEYS`` keys, however few files
    it comes from. Equal rows go together, so that counting still takes them as one. ``rows`` is their
    number, counted when not given; a table of one task stays as it is."""
    tasks = ceil((df.count() if rows is None else rows) * keys / TASK_KEYS)
    if tasks < 2:
        return df
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    return df.repartition(tasks, *hashable)


def not_sent(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles it: files of a written table may be so small next to its rows that Spark
    would broadcast it, or the other side, and hold it whole on the driver."""
    return df.hint("merge")


def _usual_join(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """A plain join, but rows of the big side without a key do not all meet in one task."""
    small = not_sent(small)
    if how != "left":
        return big.join(small, on, how)
    hashable = [f.name for f in big.schema if not isinstance(f.dataType, T.MapType)]
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = F.when(no_key, F.xxhash64(*hashable)).otherwise(F.lit(0).cast("bigint"))
    return big.withColumn("_spread", spread).join(
        small.withColumn("_spread", F.lit(0).cast("bigint")), [*on, "_spread"], "left"
    ).drop("_spread")


def skew_join(big: DataFrame, small: DataFrame, on: str | list[str], rows: str,
              how: str = "inner", min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Join ``big`` to ``small``, which has one row per key and, in column ``rows``, how
    many rows of ``big`` (or more) carry the key.

    Frequent keys would each land in one task of a shuffled join. Their rows of ``small``
    are few (under ``HOT_SHARE``, by counting), so that part is broadcast and the big side
    stays where it is; all other keys go through a shuffled join, unless all keys are as few.
    """
    on = [on] if isinstance(on, str) else on
    largest, total, keys = small.agg(F.max(rows), F.sum(rows), F.count("*")).first()
    limit = max(min_hot_rows, (total or 0) // HOT_SHARE)
    if (largest or 0) <= limit:
        if keys <= HOT_SHARE:
            return big.join(F.broadcast(small), on, how)
        return _usual_join(big, small, on, how)
    hot = F.broadcast(small.where(F.col(rows) > limit))
    usual = small.where(F.col(rows) <= limit)
    return big.join(hot, on).unionByName(
        _usual_join(big.join(hot.select(*on), on, "left_anti"), usual, on, how)
    )
