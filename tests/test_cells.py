"""Pairs compared in cells are those of ``block_pairs`` and ``block_links``, with the levels of ``compare_pairs``."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import similarity as sim
from twinfold.operators import blocking, cells, check, compare, model, refine

TOWN, MAIL, NAME = (blocking.BlockingRule(c, (c,)) for c in ("town", "mail", "name"))
RULES = [MAIL, NAME, TOWN]
COMPARISONS = [
    compare.exact("town", True), compare.email_comparison("mail"), compare.name_comparison("name"), compare.levenshtein_at("phone", (2, 4)),
    compare.postcode_comparison("zip"), compare.birth_date_comparison("born"), compare.distance_comparison("place", (1.0, 300.0))]
MODEL = model.Model(
    0.01, COMPARISONS, {c.column: [0.1 / c.top] * c.top + [0.9] for c in COMPARISONS},
    {c.column: [0.9, *[0.1 / c.top] * c.top] for c in COMPARISONS}, rules=RULES)
SCHEMA = "unique_id string, town string, mail string, name string, phone string, zip string, born string, place string, copies int"


def _rows(spark, count=160, seed=5):
    """Few values, near ones, blanks, nulls, texts that are no dates, repeated and missing ids."""
    dice = random.Random(seed)
    some = lambda *values: dice.choice([None, "", *values * 3])
    rows = [(
        None if i % 41 == 7 else f"{i - (i % 13 == 5):05d}", some("rome", "oslo", "rome "), some("anna.1@x.org", "anna.2@x.org", "anna.1@y.org", "b@x.org", "anna"),
        some("garcia", "gracia", "garza", "smith", "müller", "x" * 70, "x" * 69 + "y"), some("912345678", "912345687", "9123", "812-345-678", "5"),
        some("12345", "12346", "1299", "99"), some("2020-01-05", "2020-01-50", "2020-02-04", "2020-10-05", "2021-01-04", "1999-01-01", "ab", "ba"),
        dice.choice([None, "41.9,12.5", "41.905,12.5", "45.5,9.2", "41.9"]), dice.randint(1, 3)) for i in range(count)]
    frequencies = spark.createDataFrame([("rome", 0.3), ("oslo", 0.2), ("", 0.01)], "town string, tf_town double")
    return spark.createDataFrame(rows, SCHEMA).join(frequencies, "town", "left").select(*[c.split()[0] for c in SCHEMA.split(", ")], "tf_town")


def _sorted(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _plain(rows, **more):
    return compare.compare_pairs(blocking.block_pairs(rows, RULES, [*(c.column for c in COMPARISONS), "copies", "tf_town"], **more), COMPARISONS)


@pytest.mark.parametrize("pieces", [{}, {"largest_block": 1000, "piece_pairs": 9}])
def test_pairs_of_cells_have_the_levels_of_blocked_pairs(spark, monkeypatch, pieces):
    monkeypatch.setattr(blocking, "MOST_CELLS", 1 << 40)
    rows = _rows(spark)
    columns = [*(c.column for c in COMPARISONS), "copies", "tf_town"]
    for every_rule in (False, True):
        got = cells.compared_pairs(rows, RULES, COMPARISONS, columns, every_rule=every_rule, **pieces)
        assert _sorted(got) == _sorted(_plain(rows, every_rule=every_rule)) and got.count() > 1000
    gammas = [c.gamma for c in COMPARISONS]
    counted = cells.compared_pairs(rows, RULES, COMPARISONS, every_rule=True, counted="copies", **pieces)
    want = _plain(rows, every_rule=True).groupBy("rule_no", *gammas).agg(F.sum(F.col("copies_l") * F.col("copies_r")).alias("pairs"))
    assert _sorted(counted.groupBy("rule_no", *gammas).agg(F.sum("pairs").alias("pairs"))) == _sorted(want)


def test_steps_of_few_pairs_and_few_patterns_change_nothing(spark):
    rows = _rows(spark)
    work = cells._Work(3, "unique_id", ("unique_id",), tuple(COMPARISONS), (), False, True, None, "copies")
    dealt = cells._in_one_cell(cells._dealt(rows, RULES, work)).repartition(1).sortWithinPartitions(*cells._PLACE, "_side")
    batches = dealt.toArrow().to_batches(max_chunksize=17)
    whole = [sorted(str(row) for batch in work.pairs(iter(batches)) for row in batch.to_pylist())]
    whole.append(sum(sum(batch["pairs"].to_pylist()) for batch in work.patterns(iter(batches))))
    before = cells.STEP_PAIRS, cells.MOST_CODES
    cells.STEP_PAIRS, cells.MOST_CODES = 7, 20
    try:
        few = [sorted(str(row) for batch in work.pairs(iter(batches)) for row in batch.to_pylist())]
        few.append(sum(sum(batch["pairs"].to_pylist()) for batch in work.patterns(iter(batches))))
    finally:
        cells.STEP_PAIRS, cells.MOST_CODES = before
    assert few == whole and len(whole[0]) > 1000


def test_a_bound_leaves_out_no_pair_that_reaches_it(spark):
    """Only pairs that are kept leave the task: no join forms the others."""
    rows = _rows(spark)
    every = model.predict(rows, MODEL, keep_levels=True)
    for threshold in (0.2, 0.9):
        want = every.where(F.col("match_probability") >= threshold)
        some = model.predict(rows, MODEL, threshold, keep_levels=True)
        assert _sorted(some) == _sorted(want) and want.count() > 0
        bounded = cells.compared_pairs(rows, RULES, COMPARISONS, ["tf_town"], bound=model.lower_bound(MODEL, threshold))
        assert want.count() <= bounded.count() < every.count()
    plan = model.predict(rows, MODEL, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "block_key" not in "".join(line for line in plan.splitlines() if "Join Inner" in line)
    near = compare.distance_comparison("place", (1.0, 300.0))
    agreeing = cells.compared_pairs(rows, RULES, [near], bound=cells.agreeing(near))
    assert _sorted(agreeing.select("gamma_place")) == _sorted(every.where("gamma_place > 0").select("gamma_place"))


def test_tables_that_are_not_texts_are_compared_as_before(spark):
    rows = spark.range(30).select(F.col("id").cast("string").alias("unique_id"), (F.col("id") % 3).alias("town"), F.lit(0.1).alias("tf_town"))
    field = model.Model(0.01, [COMPARISONS[0]], {"town": [0.1, 0.9]}, {"town": [0.9, 0.1]}, rules=[TOWN])
    assert not cells.comparable(rows, field.comparisons)
    assert model.predict(rows, field).count() == 3 * 45 and model.training_patterns(rows, [TOWN], [compare.exact("town")]).first()["pairs"] == 135


@pytest.mark.parametrize("piece_rows", [2000, 7])
def test_links_of_cells_are_those_of_blocks(spark, piece_rows):
    base, new = _rows(spark), _rows(spark, 90, 8).drop("tf_town")
    columns = [c.column for c in COMPARISONS]
    want = compare.compare_pairs(blocking.block_links(new, base.drop("tf_town"), RULES, columns), COMPARISONS)
    measure = cells.Measure("ratio", "name", sim.token_set_of)
    got = cells.compared_links(new, base.drop("tf_town"), RULES, COMPARISONS, columns, measures=[measure], piece_rows=piece_rows)
    assert _sorted(got.drop("ratio")) == _sorted(want)
    assert got.where(~F.col("ratio").eqNullSafe(sim.token_set_ratio("name_l", "name_r"))).isEmpty()
    every = check.score_links(new, base, MODEL, ["name"], fuzzy=["name", "town"])
    likely = check.score_links(new, base, MODEL, ["name"], least=0.5, fuzzy=["name", "town"]).where("match_probability >= 0.5")
    assert _sorted(likely) == _sorted(every.where("match_probability >= 0.5")) and 0 < likely.count() < every.count()
    both = check.score_links(new, base, MODEL, ["name", "town"], fuzzy=["name", "town"])
    scores = both.select(check.fuzzy_score(["name", "town"], known=True).alias("a"), check.fuzzy_score(["name", "town"]).alias("b"))
    assert scores.where("a != b OR a IS NULL").isEmpty() and scores.where("a > 0").count() > 0


def test_batches_of_distances_and_word_sets_are_those_of_single_texts():
    dice = random.Random(3)
    for letters, most in (("ab", 8), ("0123456789", 16), ("abcé\U0001f600 \x00", 33), ("abc ", 70)):
        texts = ["", *("".join(dice.choice(letters) for _ in range(dice.randint(0, most))) for _ in range(60))]
        left, right = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
        pairs = [(texts[a], texts[b]) for a, b in zip(left, right)]
        assert sim.levenshtein_of(texts, texts, left, right).tolist() == [sim.edit_distance(*p) for p in pairs]
        assert sim.winkler_of(texts, texts, left, right).tolist() == [sim.jaro_winkler(*p) for p in pairs]
        assert sim.jaro_of(texts, list(texts), left[:9], right[:9]).tolist() == [sim.jaro(*p) for p in pairs[:9]]
    assert [sim.edit_distance(*p) for p in (("kitten", "sitting"), ("", "ab"), ("ab", "ba"), ("x" * 90, "x" * 80 + "y"))] == [3, 2, 2, 10]
    words = ["a", "ab", "hill", "road", "rd,", "12", "é", "x" * 20]
    texts = ["", "  ", "w " * 80, "x" * 64, " ".join(f"w{i}" for i in range(9)), *(
        dice.choice(["", " "]) + dice.choice([" ", "\t", "  "]).join(dice.choice(words) for _ in range(dice.randint(0, 7))) for _ in range(60))]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    want = [sim.token_set_ratio_text(texts[a], texts[b]) for a, b in zip(left, right)]
    assert sim.token_set_of(texts, texts, left, right).tolist() == want


@pytest.mark.parametrize("side", [None, "late"])
def test_refined_pairs_are_compared_where_they_meet(spark, monkeypatch, side):
    """No pair is shuffled with what is compared: the records of a large block are, with the first of the next stretch."""
    monkeypatch.setattr(cells, "ORDERED_ROWS", 7)
    rows = _rows(spark).where("unique_id IS NOT NULL").dropDuplicates(["unique_id"]).withColumn("late", F.col("unique_id") % 3 == 0)
    columns = [*(c.column for c in COMPARISONS), "tf_town"]
    found = refine.refine_blocks(rows, RULES, block_rows=20)
    assert found.crowded.count() > 100
    want = compare.compare_pairs(refine.refined_pairs(rows, RULES, columns, side=side, refinement=found), COMPARISONS)
    got = refine.compared_refined(rows, RULES, COMPARISONS, columns, side=side, refinement=found)
    assert _sorted(got) == _sorted(want) and got.count() > 500
    some = refine.compared_refined(rows, RULES, COMPARISONS, ["tf_town"], side=side, refinement=found, bound=model.lower_bound(MODEL, 0.5))
    likely = model.with_score(some, MODEL).where("match_probability >= 0.5").select("unique_id_l", "unique_id_r")
    every = model.with_score(want, MODEL).where("match_probability >= 0.5").select("unique_id_l", "unique_id_r")
    assert _sorted(likely) == _sorted(every) and likely.count() > 0
