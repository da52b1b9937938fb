"""Near-duplicate vectors by p-stable hashing, checked by exact cosine.

A table hashes a normalised vector by k random projections (Gaussian, so 2-stable), each shifted
and cut into steps. Vectors that share the hash of any table are compared exactly. k grows with
the logarithm of the number of vectors, so that few unrelated ones meet, and the number of tables
follows from k and the recall asked for at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators.components import connected_components
from twinfold.operators.scratch import materialize
from twinfold.operators.skew import skew_join
from twinfold.sources.package import ship_package

from .groups import gridded, whole_groups

STEP = 2.0
RECALL = 0.995  # expected at the threshold; nearer vectors are found with more certainty
CELL_ROWS = 1500
_SEED = 20_011


def collision(distance: float, step: float = STEP) -> float:
    """Chance that one projection puts two vectors at this distance into one step (Datar et al., 2004)."""
    c = step / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan_tables(rows: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections per table, tables). Unrelated vectors are at a right angle; a table shows a
    vector to about a thousandth of them, less as the rows grow beyond a million."""
    near, far = collision(math.sqrt(2 - 2 * similarity)), collision(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(1000.0, math.sqrt(max(rows, 1)))) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def bucket_numbers(vectors: np.ndarray, k: int, tables: int, step: float = STEP) -> np.ndarray:
    """32-bit bucket of each vector (row) in each table (column)."""
    made = np.random.default_rng(_SEED)
    directions = made.standard_normal((vectors.shape[1], k * tables))
    shifts = made.uniform(0, step, k * tables)
    cells = np.floor((vectors @ directions + shifts) / step).astype(np.int64).astype(np.uint64)
    cells = cells.reshape(len(vectors), tables, k)
    total = np.zeros(cells.shape[:2], dtype=np.uint64)
    for i in range(k):
        total = (total ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return (total >> np.uint64(32)).astype(np.uint32).view(np.int32)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not all zero, no null or non-finite component."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))


def _stack(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _hashed(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """(id, weight, vector, buckets) -> the buckets of all tables as one array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = bucket_numbers(_unit(_stack(batch.column(2))), k, tables)
                offsets = pa.array(np.arange(0, found.size + 1, tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))],
                    ["id", "weight", "vector", "buckets"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("id", "weight", "vector").mapInArrow(
        run, f"id bigint, weight bigint, vector {kind}, buckets array<int>")


def _linked(cells: DataFrame, similarity: float) -> DataFrame:
    """(id, n, root) from rows sorted by cell: n counts the vectors (with copies) linked to id whose
    first common table this is, root is a member of the cell that id reaches by links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["key", "cell_a", "cell_b"]):
            sizes = np.diff(cuts)
            if not (sizes > 1).any():
                continue
            low, high, stripe, number = (table[c].to_numpy() for c in ("cell_a", "cell_b", "stripe", "number"))
            ids, weight = table["id"].to_numpy(), table["weight"].to_numpy()
            column, buckets = table["vector"].chunk(0), table["buckets"].chunk(0)
            out_id, out_n, out_root = [], [], []
            for g in np.flatnonzero(sizes > 1):
                s, e = int(cuts[g]), int(cuts[g + 1])
                unit = _unit(_stack(column.slice(s, e - s)))
                near = np.triu(unit @ unit.T >= similarity - 1e-9, 1)
                i, j = np.nonzero(near)
                if low[s] != high[s]:
                    across = stripe[s + i] != stripe[s + j]
                    i, j = i[across], j[across]
                if not len(i):
                    continue
                # the same sum for a pair wherever it is met, so the threshold falls alike
                exact = np.concatenate([(unit[i[c:c + 65536]] * unit[j[c:c + 65536]]).sum(axis=1)
                                        for c in range(0, len(i), 65536)]) >= similarity
                i, j = i[exact], j[exact]
                own = _numbers(buckets.slice(s, e - s))
                first = np.ones(len(i), dtype=bool)
                for t in range(int(number[s])):
                    first &= own[i, t] != own[j, t]
                i, j = i[first], j[first]
                if not len(i):
                    continue
                counts = np.bincount(i, weight[s + j], e - s) + np.bincount(j, weight[s + i], e - s)
                root = _roots(e - s, i, j)
                told = np.flatnonzero(counts)
                out_id.append(ids[s + told])
                out_n.append(counts[told].astype(np.int64))
                out_root.append(ids[s + root[told]])
            if out_id:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (out_id, out_n, out_root)], ["id", "n", "root"])

    return cells.mapInArrow(run, "id bigint, n bigint, root bigint")


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first member that each reaches by the links (i, j)."""
    root = np.arange(size)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def near_vectors(vectors: DataFrame, id_col: str, vector_col: str, similarity: float,
                 recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept), a row per distinct id: other vectors found with a cosine
    of ``similarity`` or more (none below it), the smallest id reachable by such links, and
    whether that is the vector itself.

    Equal vectors are one class with a weight from the start, however many; large buckets are
    dealt to a grid of cells. A pair that meets in several tables counts in the first. Vectors that are null,
    zero, or hold null or non-finite components link with nothing; a row with a null id
    has no links and a null component; repeated rows are one vector; if an id has several different vectors,
    links of any of them are its links. All vectors have one length. Other columns are ignored.
    """
    ship_package(vectors.sparkSession)
    named = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    valid = materialize(named.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct(), "vectors")
    classes = materialize(valid.groupBy("vector").agg(
        F.min("id").alias("id"), F.count("*").alias("weight")), "vector-classes")
    k, tables = plan_tables(classes.count(), similarity, recall)
    hashed = materialize(_hashed(classes, k, tables), "hashed")
    rows = hashed.select("id", "weight", "vector", "buckets", F.posexplode("buckets").alias("number", "bucket"))
    key = F.shiftleft(F.col("number").cast("bigint"), 32) + F.col("bucket").cast("bigint")
    rows = rows.withColumn("key", key).drop("bucket")
    cells = gridded(rows, "key", "id", CELL_ROWS)
    dealt = cells.repartition("key", "cell_a", "cell_b").sortWithinPartitions("key", "cell_a", "cell_b", "id")
    found = materialize(_linked(dealt, similarity), "vector-links")
    links = found.select("id", F.col("root").alias("other")).where("id != other").distinct()
    counted = found.groupBy("id").agg(F.sum("n").alias("n"))
    named_classes = classes.join(counted, "id", "left")
    if links.isEmpty():
        named_classes = named_classes.withColumn("component", F.col("id"))
    else:
        components = materialize(connected_components(links, "id", "other"), "components")
        named_classes = named_classes.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    told = materialize(named_classes.select(
        "vector", "weight", "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "vector-names")
    by_id = skew_join(valid, told, "vector", "weight").groupBy("id").agg(
        F.sum("n_links").alias("n_links"), F.min("component").alias("component_id"))
    every = named.select("id").distinct()
    return every.join(by_id, "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
