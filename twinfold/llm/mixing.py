"""Temperature mixing of sources, realised as budgeted block permutations.

Only DataFrame functions: no Python runs on the executors.

The weight of a source is its token share raised to an exponent and normalised. The exponent is
bisected until the mixture reaches a target entropy, or as near as the repetition limit allows.
A source then gets weight * budget tokens. It is read in passes; a pass is a permutation of its
blocks, and of the documents in a block, by hash. The last pass ends where the budget does: the
document that would pass it and all after it in the permutation are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.operators.scratch import materialize
from twinfold.operators.skew import skew_join

BLOCK_TOKENS = 1_000_000
BLOCKS_PER_SOURCE = 10_000  # blocks grow beyond BLOCK_TOKENS for sources of more tokens than these hold
ROUNDS = 40  # of bisection: the exponent is exact to 2**-40
MOST_BROADCAST = 100_000  # sources (one small row each) that may be broadcast


def source_key(source: Column) -> Column:
    """Null is a source of its own, apart from every text."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def token_count(text: Column) -> Column:
    """Tokens as runs of anything but blank, tab and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def id_text(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit(""))


def _hash(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def _block(id_: Column, n_blocks: Column) -> Column:
    """The block of a document, by eight hexadecimal digits of a hash."""
    return F.pmod(F.conv(F.substring(F.md5(id_), 1, 8), 16, 10).cast("bigint"), n_blocks)


def _weights(totals: DataFrame, exponent: float) -> DataFrame:
    """Entropy of the mixture over its greatest, and the greatest repetition per unit of budget."""
    power = F.pow(F.col("share"), F.lit(exponent))
    sums = totals.agg(F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("zlog"),
                      F.max(power / F.col("tokens")).alias("repeat"), F.count("*").alias("n"))
    return sums.select(
        F.when(F.col("n") > 1, (F.log("z") - F.col("zlog") / F.col("z")) / F.log("n")).otherwise(1.0),
        F.col("repeat") / F.col("z"), "z")


def find_exponent(totals: DataFrame, entropy: float, most_repeats: float, budget: float) -> tuple[float, float]:
    """(exponent, normaliser): the largest exponent in 0..1 whose mixture has at least
    ``entropy`` (share of the greatest possible), or, where that would repeat a source over
    ``most_repeats`` times, the smallest that does not. At exponent 1 the shares stay as they are."""
    def bisect(low_is_enough) -> float:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            mid = (low + high) / 2
            low, high = (mid, high) if low_is_enough(*_weights(totals, mid).first()) else (low, mid)
        return low

    at_one = _weights(totals, 1.0).first()
    exponent = 1.0 if at_one[0] >= entropy else bisect(lambda h, r, z: h >= entropy)
    if _weights(totals, exponent).first()[1] * budget > most_repeats:
        exponent = 1.0 if at_one[1] * budget > most_repeats else min(
            1.0, bisect(lambda h, r, z: r * budget > most_repeats) + 2.0**-ROUNDS)
    return exponent, _weights(totals, exponent).first()[2]


def plan_mixture(documents: DataFrame, id_col: str, source_col: str, text_col: str, entropy: float = 0.95,
                 most_repeats: float = 4.0, budget_ratio: float | None = 1.0) -> DataFrame:
    """One row per source: key, n_docs, tokens, share, weight, quota, n_blocks, whole passes, and
    where the last pass ends (block hash, document hash).

    The budget is ``budget_ratio`` times all tokens; None asks for the smallest budget in which
    every source is read at least once, with the exponent that repeats the smallest source
    ``most_repeats`` times or reaches ``entropy``. Sources without tokens get no quota and no pass.
    """
    light = materialize(documents.select(
        id_text(F.col(id_col)).alias("id"), source_key(F.col(source_col)).alias("key"),
        token_count(F.col(text_col)).alias("n")), "mix-docs")
    all_tokens = light.agg(F.sum("n")).first()[0] or 0
    spread = F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).cast("bigint")
    totals = materialize(light.groupBy("key").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("tokens"),
        F.least(F.greatest(spread, F.lit(1)), F.lit(BLOCKS_PER_SOURCE)).cast("bigint").alias("n_blocks"),
    ).withColumn("share", F.col("tokens") / F.lit(max(all_tokens, 1))).coalesce(1).sortWithinPartitions("key"), "mix-totals")
    filled = totals.where("tokens > 0")
    least_share = filled.agg(F.min("share")).first()[0]
    if least_share is None:
        exponent, normaliser, budget = 1.0, 1.0, 0.0
    elif budget_ratio is None:
        # the largest source is read once, so a source of share p is read (p / largest)^(exponent - 1) times
        largest = filled.agg(F.max("share")).first()[0]
        exponent, normaliser = find_exponent(filled, entropy, float("inf"), 0.0)
        if least_share < largest:
            exponent = max(exponent, 0.0, 1.0 - math.log(most_repeats) / math.log(largest / least_share))
            normaliser = _weights(filled, exponent).first()[2]
        # a few tokens more, so that rounding never cuts the one pass short
        budget = (largest ** (1.0 - exponent)) * normaliser * all_tokens * (1 + 1e-9) + 1
    else:
        budget = float(budget_ratio) * all_tokens
        exponent, normaliser = find_exponent(filled, entropy, most_repeats, budget)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("share"), F.lit(exponent)) / F.lit(normaliser)).otherwise(0.0)
    quota = F.floor(F.col("weight") * F.lit(budget)).cast("bigint")
    planned = totals.withColumn("weight", weight).withColumn("quota", quota)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(0)).cast("bigint")
    planned = planned.withColumn("passes", whole).withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    planned = materialize(planned, "mix-plan")
    return _with_ends(light, planned)


def _with_plan(docs: DataFrame, planned: DataFrame, key: str, rows: str) -> DataFrame:
    if planned.count() <= MOST_BROADCAST:
        return docs.join(F.broadcast(planned), key)
    return skew_join(docs, planned, key, rows)


def _with_ends(light: DataFrame, planned: DataFrame) -> DataFrame:
    """Add the hashes at which the last pass ends: of the first block that does not fit whole,
    and in it of the first document that does not fit."""
    placed = _with_plan(light, planned.select("key", "n_docs", "n_blocks", "passes", "rest"), "key", "n_docs")
    block = _block(F.col("id"), F.col("n_blocks")).cast("string")
    last = F.col("passes").cast("string")
    placed = placed.withColumn("block_hash", _hash(F.col("key"), last, block))
    blocks = placed.groupBy("key", "block_hash").agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    # at most BLOCKS_PER_SOURCE rows in a window
    upto = Window.partitionBy("key").orderBy("block_hash")
    ends = materialize(blocks.withColumn("upto", F.sum("n").over(upto)).where("upto > rest").groupBy("key").agg(
        F.min_by(F.struct("block_hash", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")), "block_hash").alias("end"),
    ).select("key", F.col("end.block_hash").alias("end_block"), F.col("end.left").alias("left")), "mix-ends")
    inside = placed.join(F.broadcast(ends) if ends.count() <= MOST_BROADCAST else ends, "key").where(
        F.col("block_hash") == F.col("end_block")).withColumn("hash", _hash(F.col("key"), last, F.col("id")))
    # one block of a source; equal hashes (repeated rows) are counted together: all fit or none
    within = Window.partitionBy("key").orderBy("hash")
    cut = inside.withColumn("upto", F.sum("n").over(within)).where("upto > left").groupBy("key").agg(
        F.min("hash").alias("end_doc"))
    return materialize(planned.join(ends.drop("left"), "key", "left").join(cut, "key", "left"), "mix-ends")


def mix_sources(documents: DataFrame, id_col: str, source_col: str, planned: DataFrame) -> DataFrame:
    """The documents of the mixture: all columns, and ``_tw_pass`` (from 0), ``_tw_block`` and
    ``_tw_place``, hashes by which a pass is ordered. A document comes once per pass it is in.

    Null sources are a source; repeated rows and null ids share their place and are in or out
    together; empty and null texts weigh nothing and come with every whole pass and up to the
    end of the last; a source without any token is left out, as no weight can be realised with
    it; an empty table gives an empty result. Documents stay where they are: the plan comes to
    them.
    """
    docs = documents.withColumn("_tw_key", source_key(F.col(source_col)))
    plan = F.col("_tw_plan")
    packed = planned.select(
        F.col("key").alias("_tw_key"), F.col("n_docs").alias("_tw_rows"),
        F.struct("n_blocks", "passes", "end_block", "end_doc").alias("_tw_plan"))
    placed = _with_plan(docs, packed, "_tw_key", "_tw_rows").withColumn(
        "_tw_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), plan["passes"])))
    id_, number = id_text(F.col(id_col)), F.col("_tw_pass").cast("string")
    block = _block(id_, plan["n_blocks"]).cast("string")
    placed = placed.withColumn("_tw_block", _hash(F.col("_tw_key"), number, block)).withColumn(
        "_tw_place", _hash(F.col("_tw_key"), number, id_))
    before_end = (F.col("_tw_block") < plan["end_block"]) | (
        (F.col("_tw_block") == plan["end_block"]) & (F.col("_tw_place") < plan["end_doc"]))
    kept = placed.where((F.col("_tw_pass") < plan["passes"]) | before_end)
    return kept.select(*documents.columns, "_tw_pass", "_tw_block", "_tw_place")
