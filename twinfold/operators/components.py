"""Connected components by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, materialize
from .skew import HOT_SHARE, MIN_HOT_ROWS

_MAX_ROUNDS = 60


def _with_lowest(links: DataFrame, end: str, lowest: DataFrame, rows: int) -> DataFrame:
    """Left join ``links`` to ``lowest`` (one row per node) on the node at ``end``.

    Late rounds consist of stars, so one node may be the end of a third of all links. Such
    nodes are counted first, are under ``HOT_SHARE``, and get their label by broadcast.
    """
    lowest = lowest.withColumnRenamed("node", end)
    limit = max(MIN_HOT_ROWS, rows // HOT_SHARE)
    if rows <= limit:
        return links.join(lowest, end, "left")
    hot = F.broadcast(links.groupBy(end).count().where(F.col("count") > limit).select(end))
    hot_lowest = F.broadcast(lowest.join(hot, end, "left_semi"))
    at_hot = links.join(hot, end, "left_semi").join(hot_lowest, end, "left")
    usual = links.join(hot, end, "left_anti").join(lowest, end, "left")
    return at_hot.unionByName(usual)


def _lowest_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("far").alias("node")).agg(F.min("near").alias("lowest"))


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Every far end moves on to the lowest neighbour of its near end."""
    jumped = _with_lowest(links, "near", _lowest_neighbour(links), rows)
    return jumped.select("far", F.coalesce("lowest", "near").alias("near")).distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """The near ends of a node all link to the lowest among them."""
    lowest = _lowest_neighbour(links)
    between = (
        _with_lowest(links, "far", lowest, rows).where(F.col("near") != F.col("lowest"))
        .select(F.col("near").alias("far"), F.col("lowest").alias("near"))
    )
    kept = lowest.select(F.col("node").alias("far"), F.col("lowest").alias("near"))
    return between.unionByName(kept).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every end of an edge; a component is named by its lowest id.

    Edges count in both directions. Each round is written to the shared folder, so lineage
    stays one round long, and rounds stop when the table no longer changes.
    """
    far, near = F.greatest(src, dst), F.least(src, dst)
    links = materialize(
        edges.select(far.alias("far"), near.alias("near")).where("far != near").distinct(), "links")
    seen = None
    for _ in range(_MAX_ROUNDS):
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("far", "near"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        large = _large_star(links, state[0])
        # the small star reads its input several times: worth a table once it is large
        between = materialize(large, "links") if state[0] > MIN_HOT_ROWS else None
        following = materialize(_small_star(between or large, state[0]), "links")
        forget(between)
        forget(links)
        links = following
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("near").alias("id")).distinct().withColumn("component", F.col("id"))
    return links.select(F.col("far").alias("id"), F.col("near").alias("component")).unionByName(roots)
