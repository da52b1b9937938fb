"""Nearest neighbours by inner product with a vantage-point tree per shard.

Vectors get one more component that makes all of them as long as the longest, and queries a zero:
then the nearest by distance are those of the largest inner product. A tree splits its vectors by
their distance from a vantage point; a search leaves out a side that the triangle inequality
keeps farther than the k-th nearest so far. With a factor below one the inequality is taken as if
that distance were smaller by the factor: less is searched, and a neighbour may be missed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.operators.scratch import materialize
from twinfold.sources.package import ship_package

from .groups import whole_groups
from .near_vectors import _stack, usable

SHARD_ROWS = 4096
BLOCK_QUERIES = 1024
LEAF = 128
FACTOR = 0.2
_SLACK = 1e-9


@dataclass
class Node:
    vantage: int  # row of the vantage point
    inner: tuple[float, float]  # least and greatest distance of the inner side from it
    outer: tuple[float, float]
    near: Node | np.ndarray  # a leaf is an array of rows
    far: Node | np.ndarray


def build(points: np.ndarray, rows: np.ndarray, seed: int = 1) -> Node | np.ndarray:
    """A tree over the rows of ``points``; the vantage point is the farthest of a few from one of
    them, which spreads the distances. Equal points end up in one leaf, whatever their number."""
    if len(rows) <= LEAF:
        return rows
    made = np.random.default_rng([seed, len(rows), int(rows[0])])
    some = points[made.choice(rows, 16)]
    start = some[0]
    vantage = rows[int(np.argmax(((points[rows] - start) ** 2).sum(axis=1)))]
    away = np.sqrt(((points[rows] - points[vantage]) ** 2).sum(axis=1))
    middle = np.median(away)
    inside = away <= middle
    if inside.all():
        inside = away < middle
        if not inside.any():
            return rows
    return Node(int(vantage), (away[inside].min(), away[inside].max()), (away[~inside].min(), away[~inside].max()),
                build(points, rows[inside], seed + 1), build(points, rows[~inside], seed + 1))


class _Nearest:
    """The k best rows of each query so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, largest: float) -> None:
        self.queries, self.own, self.k = queries, own, k
        self.lengths = (queries**2).sum(axis=1) + largest
        self.score = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def reach(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th nearest so far."""
        return np.sqrt(np.maximum(self.lengths[active] - 2 * self.score[active, -1], 0))

    def offer(self, active: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        found = self.queries[active] @ vectors.T
        found[self.own[active][:, None] == ids[None, :]] = -np.inf
        some = found >= self.score[active, -1][:, None] - _SLACK
        held = some.any(axis=1)
        for q, row, hits in zip(active[held], found[held], some[held], strict=True):
            at = np.flatnonzero(hits & (row > -np.inf))
            if len(at) > 4 * self.k:  # near the best k, so that the exact sums are few
                at = at[row[at] >= np.partition(row[at], -self.k)[-self.k] - _SLACK]
            # the same sum for a pair wherever it is met, so ties are ties
            exact = (vectors[at] * self.queries[q]).sum(axis=1)
            score, ids_q = np.append(self.score[q], exact), np.append(self.ids[q], ids[at])
            best = np.lexsort((ids_q, -score))[: self.k]
            self.score[q], self.ids[q] = score[best], ids_q[best]


def search(tree: Node | np.ndarray, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray,
           k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of the tree for each query, except the row with its own id.
    ``points`` have the added component as their last. Empty places have the score -inf."""
    vectors = points[:, :-1]
    state = _Nearest(queries, own, k, float((points[0] ** 2).sum()))
    added = np.hstack([queries, np.zeros((len(queries), 1))])

    def visit(node: Node | np.ndarray, active: np.ndarray) -> None:
        if not len(active):
            return
        if not isinstance(node, Node):
            state.offer(active, vectors[node], ids[node])
            return
        away = np.sqrt(((added[active] - points[node.vantage]) ** 2).sum(axis=1))
        nearer = away <= (node.inner[1] + node.outer[0]) / 2
        for side, (low, high), own_side in ((node.near, node.inner, nearer), (node.far, node.outer, ~nearer)):
            visit(side, active[own_side])
        for side, (low, high), own_side in ((node.near, node.inner, nearer), (node.far, node.outer, ~nearer)):
            rest, gap = active[~own_side], away[~own_side]
            limit = factor * state.reach(rest) + _SLACK
            visit(side, rest[(gap - limit <= high) & (gap + limit >= low)])

    visit(tree, np.arange(len(queries)))
    return state.ids, state.score


def nearest(vectors: DataFrame, id_col: str, vector_col: str, is_query, k: int = 20, factor: float = FACTOR,
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (a column) holds, the k
    other rows of the largest inner product found, nearest first, ties to the smaller id.

    Every row is in a tree; every block of queries is searched in every tree (a given query set
    against all rows), and the bests of the shards are merged. Null ids and vectors that are null, zero, or hold
    null or non-finite components take no part; repeated rows are one; of an id with several vectors the
    first by value counts; an empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    id_ = F.col(id_col).cast("bigint")
    named = vectors.select(id_.alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    valid = materialize(named.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(
        F.min_by(F.struct("vector", "asks"), "vector").alias("row")).select("id", "row.vector", "row.asks"), "points")
    squares = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    rows, asking, longest = valid.agg(F.count("*"), F.count_if("asks"), F.max(squares)).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not rows or not asking:
        return spark.createDataFrame([], schema)
    shards, blocks = -(-rows // shard_rows), -(-asking // BLOCK_QUERIES)

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["shard"]):
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(int(s), int(e - s))
                points = _stack(part["vector"].combine_chunks())
                rest = np.sqrt(np.maximum(longest - (points * points).sum(axis=1), 0))
                points = np.hstack([points, rest[:, None]])
                tree = build(points, np.arange(len(points)))
                data = pickle.dumps((tree, points, part["id"].to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array([part["shard"][0].as_py()], pa.int32()), pa.array([data], pa.binary())], ["shard", "tree"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["block"]):
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(int(s), int(e - s))
                data = pickle.dumps((_stack(part["vector"].combine_chunks()), part["id"].to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array([part["block"][0].as_py()], pa.int32()), pa.array([data], pa.binary())], ["block", "queries"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, points, ids = pickle.loads(batch.column(0)[i].as_buffer())
                queries, own = pickle.loads(batch.column(1)[i].as_buffer())
                found, scores = search(tree, points, ids, queries, own, k, factor)
                there = scores > -np.inf
                asked = np.broadcast_to(own[:, None], there.shape)[there]
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(found[there]), pa.array(scores[there])], ["query_id", "vec_id", "score"])

    shard = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(blocks)).cast("int")
    trees = valid.select("id", "vector", shard.alias("shard")).repartition("shard").sortWithinPartitions("shard", "id")
    trees = materialize(trees.mapInArrow(planted, "shard int, tree binary"), "trees")
    asked = valid.where("asks").select("id", "vector", block.alias("block")).repartition("block").sortWithinPartitions("block", "id")
    asked = materialize(asked.mapInArrow(packed, "block int, queries binary"), "query-blocks")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # a task gets a few pairs of tree and block; batches of one pair bound its memory
    met = asked.join(trees, "shard").repartition(F.xxhash64("shard", "block")).select("tree", "queries")
    bests = met.mapInArrow(searched, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return bests.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
