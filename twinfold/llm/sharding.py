"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries of many fine ranges; the exact bytes of
every range are then counted, overfull ranges are sampled again and subdivided, and runs of
adjacent ranges become shards of nearly equal bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.operators.scratch import materialize
from twinfold.sources.package import ship_package

# A key is 40 bits of the text's hash, then 23 bits that tell copies apart: 11 by id, 12 by row.
ID_BITS, ROW_BITS = 11, 12
GROUP_BITS = ID_BITS + ROW_BITS
FINE_RANGES = 32  # per shard: a shard is off by about one part in this many
ROWS_PER_RANGE = 1_000_000  # ranges grow in number, not in rows, with the table
SAMPLE_PER_RANGE = 16
MOST_ROUNDS = 8


def _cuts(codes: np.ndarray, weights: np.ndarray, step: float) -> np.ndarray:
    """Boundaries after every ``step`` of weight, moved back to the edge of a group of equal
    texts; a boundary stays inside a group only where the group alone fills a range."""
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    passed = np.floor(np.cumsum(weights) / step)
    chosen = codes[1:][passed[:-1] > np.append(-1, passed[:-2])] if len(codes) > 1 else codes[:0]
    edges = chosen >> GROUP_BITS << GROUP_BITS
    again = np.append(False, edges[1:] == edges[:-1])
    return np.unique(np.where(again, chosen, edges))


def _sampled(keyed: DataFrame, points: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``points`` keys, each row drawn with a chance in proportion to its size."""
    chance = F.col("size") * (points / total)
    draw = F.pmod(F.xxhash64("code", "id", "size"), F.lit(1 << 30)) / float(1 << 30)
    found = keyed.where(draw < chance).select("code", "size").toPandas()
    return found["code"].to_numpy(), np.maximum(found["size"].to_numpy(), total / points)


def _ranged(keyed: DataFrame, bounds: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def place(code: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, code.to_numpy(), side="right").astype("int32"))

    return keyed.withColumn("range", place("code"))


def _per_range(keyed: DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    return _ranged(keyed, bounds).groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"),
        F.min("code").alias("low"), F.max("code").alias("high"),
    ).toPandas().sort_values("range")


def assign_shards(records: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """(id, size, text_crc32, shard, slot, fine_range) of every row.

    Law ``bytes``: the sizes (UTF-8 bytes and 1) of the shards are nearly equal, off by a range
    (1/``FINE_RANGES`` of a shard) or by one row, whichever is larger. Rows with equal texts share
    a shard unless they alone fill a range; then they are subdivided by id. Slots count from 0 in
    every shard. A null text has size 1 and checksum 0, like an empty one; null ids are ids like
    others; repeated rows get a slot each; an empty table gives an empty result. Other columns
    are ignored. The driver holds the sampled keys and one row per range: as many as
    shards * FINE_RANGES, or a millionth of the rows.
    """
    ship_package(records.sparkSession)
    text = F.col(text_col)
    group = F.pmod(F.xxhash64(text), F.lit(1 << 40))
    by_id = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1 << ID_BITS))
    by_row = F.pmod(F.xxhash64(F.lit(8), F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))
    within = F.shiftleft(by_id, ROW_BITS) + by_row
    keyed = materialize(records.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        (F.shiftleft(group, GROUP_BITS) + within).alias("code"),
    ), "keyed")
    total, rows = keyed.agg(F.sum("size"), F.count("*")).first()
    total = total or 1
    ranges = max(shards * FINE_RANGES, -(-rows // ROWS_PER_RANGE))
    step = total / ranges
    bounds = _cuts(*_sampled(keyed, ranges * SAMPLE_PER_RANGE, total), step)
    counted = _per_range(keyed, bounds)
    for _ in range(MOST_ROUNDS):
        over = counted[(counted["bytes"] > 2 * step) & (counted["low"] < counted["high"])]
        if over.empty:
            break
        inside = _ranged(keyed, bounds).where(F.col("range").isin([int(r) for r in over["range"]]))
        codes, weights = _sampled(inside, ranges * SAMPLE_PER_RANGE, int(over["bytes"].sum()))
        parts = np.searchsorted(bounds, codes, side="right")
        more = [_cuts(codes[parts == r], weights[parts == r], step) for r in over["range"]]
        finer = np.unique(np.concatenate([bounds, *more]))
        if len(finer) == len(bounds):
            break
        bounds = finer
        counted = _per_range(keyed, bounds)
    middle = counted["bytes"].cumsum() - counted["bytes"] / 2
    counted["shard"] = np.minimum(shards - 1, (middle * shards // total).astype("int64"))
    counted["before"] = counted.groupby("shard")["rows"].cumsum() - counted["rows"]
    places = records.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in counted[["range", "shard", "before"]].itertuples(index=False)],
        "range int, shard int, before bigint")
    nth = F.row_number().over(Window.partitionBy("range").orderBy("code", "id", "size"))
    return (
        _ranged(keyed, bounds).withColumn("nth", nth).join(F.broadcast(places), "range")
        .select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"),
                F.col("range").alias("fine_range"))
    )


def write_shards(records: DataFrame, id_col: str, assigned: DataFrame, path: str) -> None:
    """Write the records, whose ids must be unique, as one folder per shard, in slot order in
    every file. Files are as large as fine ranges, so no task holds a whole shard."""
    places = assigned.select(F.col("id").alias("_tw_id"), "shard", "slot", F.col("fine_range").alias("_tw_range"))
    kept = records.drop("shard", "slot")
    placed = kept.join(places, kept[id_col].eqNullSafe(F.col("_tw_id"))).drop("_tw_id")
    (placed.repartition("shard", "_tw_range").sortWithinPartitions("shard", "slot").drop("_tw_range")
     .write.partitionBy("shard").parquet(path))
