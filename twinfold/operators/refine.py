"""Blocks of bounded size, after the dynamic blocking of Borthwick, Ash, Pang, Qureshi and Jones (2020).

A block of at most ``block_rows`` records is kept whole. Larger ones are crossed: a record that
stands in several large blocks goes on to the blocks of what it has in common with others under two
of their rules, then three, as long as those are too large. Pairs that agree on a rule whose block
is kept meet there; only what large blocks alone would bring is refined.

What remains large at the first level is swept as a sorted neighbourhood (Hernandez and Stolfo,
1995): records of such a block are sorted by their other keys and each meets the next few. So work
grows with the table, not with the square of a frequent value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocking import BlockingRule, tasks_for
from .cells import Bound, compared_members, compared_neighbours
from .compare import Comparison, compared_columns
from .numbering import number_within
from .scratch import forget, materialize
from .skew import not_sent, skew_join

BLOCK_ROWS = 100
NEIGHBOURS = 5


@dataclass
class Refinement:
    """``members``: (key, _blocks), the kept blocks of every record that has any; ``crowded``: (key,
    _block), the large blocks of single rules; ``pairs``: about how many pairs the kept blocks hold."""

    members: DataFrame
    crowded: DataFrame
    pairs: int
    levels: int

    def forget(self) -> None:
        forget(self.members)
        forget(self.crowded)


def _block() -> Column:
    """A block's number: from the rules it crosses, as bits, and the record's keys under them."""
    own = F.expr("filter(transform(_keys, (k, i) -> if((_mask & shiftleft(1L, i)) != 0, k, null)), k -> k is not null)")
    return F.xxhash64("_mask", own)


def _crossings(rules: int, level: int) -> Column:
    """Sets of ``level`` rules, as bits, all of whose smaller sets are among ``_open``."""
    both = F.array_distinct(F.flatten(F.transform(
        "_open", lambda a: F.transform("_open", lambda b: a.bitwiseOR(b)))))
    smaller = F.array(*[F.lit(1 << i).cast("bigint") for i in range(rules)])

    def reached(mask: Column) -> Column:
        return (F.bit_count(mask) == level) & F.forall(smaller, lambda bit: (
            mask.bitwiseAND(bit) == 0) | F.array_contains("_open", mask.bitwiseXOR(bit)))

    return F.filter(both, reached)


def refine_blocks(df: DataFrame, rules: list[BlockingRule], key: str = "unique_id",
                  block_rows: int = BLOCK_ROWS) -> Refinement:
    """The blocks of ``df`` under ``rules`` (63 at most), none with over ``block_rows`` records."""
    if len(rules) > 63:
        raise ValueError("at most 63 rules can be crossed")
    keyed = df.select(key, F.array(*[rule.key() for rule in rules]).alias("_keys"))
    filled = [F.when(F.get("_keys", F.lit(i)).isNotNull(), F.lit(1 << i).cast("bigint")) for i in range(len(rules))]
    level, sets = 1, keyed.withColumn("_sets", F.array_compact(F.array(*filled)))
    found, written = [], None
    while True:
        placed = sets.withColumn("_mask", F.explode("_sets")).select(key, "_mask", _block().alias("_block"))
        sizes = placed.groupBy("_block").agg(F.count("*").alias("_rows")).where("_rows > 1")
        found.append(materialize(skew_join(placed, sizes, "_block", "_rows"), "blocks"))
        forget(written)
        large = found[-1].where(F.col("_rows") > block_rows)
        level += 1
        opened = large.groupBy(key).agg(F.collect_list("_mask").alias("_open")).where(F.size("_open") >= level)
        if level > len(rules) or opened.isEmpty():  # a crossing needs as many large blocks as it has rules
            break
        crossed = keyed.join(not_sent(opened), key).withColumn("_sets", _crossings(len(rules), level)).where(F.size("_sets") > 0)
        sets = written = materialize(crossed.select(key, "_keys", "_sets"), "crossings")
    kept = None
    for part in found:
        part = part.where(F.col("_rows") <= block_rows)
        kept = part if kept is None else kept.unionByName(part)
    members = materialize(kept.groupBy(key).agg(
        F.collect_list("_block").alias("_blocks"), F.sum((F.col("_rows") - 1) / 2).alias("_met")), "members")
    crowded = materialize(found[0].where(F.col("_rows") > block_rows).select(key, "_block"), "crowded")
    pairs = members.agg(F.sum("_met")).first()[0]
    for part in found:
        forget(part)
    return Refinement(members.drop("_met"), crowded, int(pairs or 0), len(found))


def _ends(df: DataFrame, columns: list[str], end: str, *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{end}") for c in columns], F.col("_blocks").alias(f"_blocks_{end}"), *more)


def _in_order(pairs: DataFrame, columns: list[str], first: Column) -> DataFrame:
    """``pairs`` with the ends exchanged where ``first`` does not hold."""
    return pairs.withColumns({
        **{f"{c}_l": F.when(first, F.col(f"{c}_l")).otherwise(F.col(f"{c}_r")) for c in columns},
        **{f"{c}_r": F.when(first, F.col(f"{c}_r")).otherwise(F.col(f"{c}_l")) for c in columns}})


def _placed(df: DataFrame, rules: list[BlockingRule], carried: list[str], key: str, found: Refinement) -> DataFrame:
    """The records with their kept blocks, and the text by which they are sorted."""
    sort_text = F.concat_ws(" ", *[rule.key() for rule in rules])
    return df.select(*carried, sort_text.alias("_sort")).join(not_sent(found.members), key, "left")


def refined_pairs(df: DataFrame, rules: list[BlockingRule], columns: list[str] = (), key: str = "unique_id",
                  block_rows: int = BLOCK_ROWS, neighbours: int = NEIGHBOURS, side: str | None = None,
                  refinement: Refinement | None = None) -> DataFrame:
    """Pairs of records worth comparing, each once, with the ``columns`` of both ends: those of the kept
    blocks, and neighbours in the sorted order of large ones.

    ``<key>_l < <key>_r``; with ``side``, a boolean column, only pairs whose left end is false and
    right end is true there. The compared columns travel with the records, and a pair is formed
    in the first block that its ends share, so nothing is made distinct but the neighbours.
    """
    carried = list(dict.fromkeys([key, *columns, *([side] if side else [])]))
    found = refinement or refine_blocks(df, rules, key, block_rows)
    rows = _placed(df, rules, carried, key, found)

    one_way = F.col(f"{key}_l") < F.col(f"{key}_r")
    spread = rows.drop("_sort").withColumn("_block", F.explode("_blocks"))
    left, right = (spread.where(~F.col(side)), spread.where(F.col(side))) if side else (spread, spread)
    tasks = tasks_for(found.pairs)
    left, right = _ends(left, carried, "l", "_block"), _ends(right, carried, "r", "_block")
    met = left.repartition(tasks, "_block").join(not_sent(right.repartition(tasks, "_block")), "_block")
    met = met.where(F.array_min(F.array_intersect("_blocks_l", "_blocks_r")) == F.col("_block"))
    met = (met if side else met.where(one_way)).select(*[f"{c}_{end}" for end in "lr" for c in carried])
    return met.unionByName(_near_pairs(rows, found, carried, key, neighbours, side))


def compared_refined(df: DataFrame, rules: list[BlockingRule], comparisons: list[Comparison], columns: list[str] = (),
                     key: str = "unique_id", block_rows: int = BLOCK_ROWS, side: str | None = None,
                     refinement: Refinement | None = None, bound: Bound | None = None) -> DataFrame:
    """``refined_pairs`` with the levels of the comparisons and the ``columns`` of both ends, compared where they meet:
    records are shuffled, not pairs with what is compared. Pairs that cannot come to ``bound`` are left out."""
    carried = list(dict.fromkeys([key, *columns, *([side] if side else [])]))
    found = refinement or refine_blocks(df, rules, key, block_rows)
    rows = _placed(df, rules, list(dict.fromkeys([*carried, *compared_columns(comparisons)])), key, found)
    met = compared_members(rows.where("_blocks IS NOT NULL"), comparisons, carried, found.pairs, key, side, bound)
    near = compared_neighbours(_crowd(rows, found, key), comparisons, carried, NEIGHBOURS, key, side, bound)
    return met.unionByName(near.dropDuplicates([f"{key}_l", f"{key}_r"]))


def _crowd(rows: DataFrame, found: Refinement, key: str) -> DataFrame:
    """The records of large blocks with their place in the order of each."""
    return number_within(not_sent(found.crowded).join(rows, key), "_block", ["_sort", key], "_place")


def _near_pairs(rows: DataFrame, found: Refinement, carried: list[str], key: str, neighbours: int, side: str | None) -> DataFrame:
    """Neighbours in the sorted order of large blocks that share no kept block, each pair once."""
    one_way = F.col(f"{key}_l") < F.col(f"{key}_r")
    crowd = _crowd(rows, found, key)
    ahead = F.explode(F.sequence(F.lit(1), F.lit(neighbours))).alias("_step")
    near = (
        _ends(crowd, carried, "l", "_block", "_place", ahead)
        .withColumn("_place", F.col("_place") + F.col("_step")).drop("_step")
        .join(not_sent(_ends(crowd, carried, "r", "_block", "_place")), ["_block", "_place"])
    )
    nothing = F.array().cast("array<bigint>")
    near = near.where(~F.arrays_overlap(F.coalesce("_blocks_l", nothing), F.coalesce("_blocks_r", nothing)))
    if side:
        near = _in_order(near.where(F.col(f"{side}_l") != F.col(f"{side}_r")), carried, ~F.col(f"{side}_l"))
    else:
        near = _in_order(near, carried, one_way)
    near = near.select(*[f"{c}_{end}" for end in "lr" for c in carried])
    return near.dropDuplicates([f"{key}_l", f"{key}_r"])
