"""Work that must not grow with the square of a block where the result does not."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from twinfold.operators import blocking, check, compare, merge, model, prior, refine, skew

NAME, CITY, MAIL = blocking.BlockingRule("city", ("city",)), compare.exact("city"), compare.email_comparison("mail")
FIELD = model.Model(
    prior=0.01, comparisons=[CITY, compare.levenshtein_at("phone", (2, 4)), MAIL],
    m={"city": [0.2, 0.8], "phone": [0.1, 0.1, 0.2, 0.6], "mail": [0.1, 0.1, 0.1, 0.2, 0.5]},
    u={"city": [0.9, 0.1], "phone": [0.97, 0.02, 0.008, 0.002], "mail": [0.95, 0.03, 0.01, 0.005, 0.005]}, rules=[NAME])


def _rows(spark, count=60):
    key = F.col("id")
    return spark.range(count).select(
        F.lpad(key.cast("string"), 6, "0").alias("unique_id"), F.lit("rome").alias("city"),
        F.when(key % 11 != 0, F.substring(F.sha2((key % 40).cast("string"), 256), 1, 10)).alias("phone"),
        F.concat(F.lit("ann.smith"), (key % 20).cast("string"), F.lit("@example.com")).alias("mail"))


def test_a_threshold_leaves_out_dear_comparisons_and_no_match(spark):
    rows = _rows(spark)
    pairs = blocking.block_pairs(rows, [NAME], ["city", "phone", "mail"])
    every = model.predict(rows, FIELD).where("match_probability >= 0.9")
    some = model.predict(rows, FIELD, 0.9)
    assert every.count() > 0
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))
    kept = model.worth_comparing(pairs, FIELD, 0.9).count()
    assert every.count() <= kept < pairs.count() / 2


def test_best_matches_are_those_of_all_links(spark):
    base = _rows(spark)
    new = base.where("unique_id < '000030'").withColumn("unique_id", F.concat(F.lit("n"), "unique_id"))
    far = new.limit(5).withColumns({"unique_id": F.concat(F.lit("far"), "unique_id"), "phone": F.lit("zz"), "mail": F.lit("x@y.z")})
    nobody = spark.createDataFrame([("alone", "oslo", "1", "a@b.c"), (None, "rome", "1", "a@b.c")],
                                   "unique_id string, city string, phone string, mail string")
    new = new.unionByName(far).unionByName(nobody)
    links = check.score_links(new, base, FIELD).withColumn("score", F.round("match_probability", 6))
    want = sorted(map(str, check.best_links(links, "score").collect()))
    assert sorted(map(str, check.best_matches(new, base, FIELD).collect())) == want
    assert new.count() - check.with_candidates(new, base, FIELD).count() == 1


def test_cells_of_large_blocks_are_bounded_in_number(spark, monkeypatch):
    found = []
    written = blocking._large_blocks
    monkeypatch.setattr(blocking, "_large_blocks", lambda sizes, side: found.append(written(sizes, side)) or found[-1])
    rows = _rows(spark, 1200)
    assert blocking.block_pairs(rows, [NAME], piece_pairs=4).count() == 1200 * 1199 // 2
    assert found[0].agg(F.max("_stripes_l")).first()[0] <= 1.1 * blocking.MOST_CELLS ** 0.5


def test_links_are_cut_into_tasks_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocking, "TASK_PAIRS", 100)
    rows = _rows(spark)
    links = blocking.block_links(rows, rows, [NAME], ["phone"])
    assert links.rdd.getNumPartitions() == 36


def test_levels_of_dates_and_distances_are_unchanged(spark):
    texts = ["2020-01-05", "2020-01-50", "2020-1-005", "2020-10-05", "2020-01-06", "2021-02-29", "2020-01-5T", "+202-01-05",
             "2020-01-5 ", "ab", "ba", "", "20200105", "1975-11-28", "2020-05-01"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    wrong = pairs.where(~compare._iso_date(F.col("a")).eqNullSafe(day(F.col("a"))))
    assert wrong.isEmpty()
    lev = compare.levenshtein_at("p", (1, 2, 4))
    before = F.when(F.col("a") == F.col("b"), lev.top)
    for below, agrees in enumerate(compare._levenshtein_levels(lev, F.col("a"), F.col("b")), start=1):
        before = before.when(agrees, lev.top - below)
    assert pairs.where(compare.gamma(lev, F.col("a"), F.col("b")) != before.otherwise(0)).isEmpty()
    swapped = {tuple(r) for r in pairs.where(compare.one_edit_or_swap(F.col("a"), F.col("b")) & (F.col("a") != F.col("b"))).collect()}
    assert ("ab", "ba") in swapped and ("2020-01-05", "2020-01-50") in swapped and ("2020-01-05", "2020-05-01") not in swapped


def test_keys_of_a_single_file_are_counted_in_small_tasks(spark, monkeypatch):
    rows = _rows(spark, 1000).coalesce(1)
    rules = [NAME, blocking.BlockingRule("phone", ("phone",))]
    sources = [*rules, blocking.BlockingRule("mail", ("mail",))]
    sets = [(0,), (1, 2), (0, 1, 2)]
    results = lambda: (blocking.cost_rules(rows, rules), blocking.matched_pairs(rows, rules),
                       prior.agreeing_pairs(rows, sources, sets), sorted(map(tuple, model.equality_u(rows, FIELD.comparisons).collect())),
                       sorted(map(tuple, blocking.block_pairs(rows, rules).select("unique_id_l", "unique_id_r", "rule_no").collect())))
    whole = results()
    monkeypatch.setattr(skew, "TASK_KEYS", 100)
    assert results() == whole
    assert blocking._side(rows, rules, ["unique_id"], "l").rdd.getNumPartitions() == 20
    plan = blocking.block_sizes(rows, rules)._jdf.queryExecution().executedPlan().toString()
    assert "20), REPARTITION_BY_NUM" in plan


def test_tables_that_grow_with_the_records_are_not_broadcast_to_refine_them(spark):
    rows = _rows(spark, 300)
    rules = [NAME, blocking.BlockingRule("phone", ("phone",)), blocking.BlockingRule("mail", ("mail",))]
    pairs = refine.refined_pairs(rows, rules, block_rows=20)
    assert pairs.count() > 0
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    sent = [line for line in joins if "strategy=broadcast" in line]  # what a range partition starts with
    assert len(sent) == 2 and sum("strategy=merge" in line for line in joins) == len(joins) - len(sent)


def test_band_keys_are_those_of_the_text_made_from_numbers_of_words(spark):
    factors, offsets = (np.array(c, dtype=np.uint64) for c in merge.permutation_constants())
    blanks = "".join(chr(i) for i in range(0x3100) if chr(i).isspace())
    texts = ["", " ", "one", "a b a c", "été \U0001f600 x", "p\x00q ​z", *[f"l{b}r s" for b in blanks],
             " ".join(f"w{i}" for i in range(9000))]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, words string")
    found = rows.select("i", "words", merge.band_keys("words").alias("keys"), merge.word_numbers(F.col("words")).alias("numbers")).collect()
    for row in found:
        assert row["keys"] == (None if row["words"] is None else merge.band_keys_of(row["words"], factors, offsets))
        assert row["words"] is None or sorted(row["numbers"]) == sorted(merge._word_number(w) for w in set(row["words"].split()))


def test_levels_of_a_date_come_from_one_distance(spark):
    texts = ["2020-01-05", "2020-01-50", "2020-1-005", "2020-02-04", "2020-02-05", "2021-01-04", "2021-01-05", "2030-01-04",
             "2030-01-05", "1975-11-28", "", "ab", "ba", None]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for days in ((30, 365, 3652), (0,), (7, 7, 3650), (400_000,), ()):
        date = compare.birth_date_comparison("d", days)
        before = F.when(a.isNull() | b.isNull(), -1).when(a == b, date.top)
        for below, agrees in enumerate(compare._birth_date_levels(date, a, b), start=1):
            before = before.when(agrees, date.top - below)
        assert pairs.where(~compare.gamma(date, a, b).eqNullSafe(before.otherwise(0))).isEmpty()
    plan = pairs.select(compare.gamma(compare.birth_date_comparison("d"), a, b).alias("level"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("datediff(") == 1 and plan.count("levenshtein(") == 1


def test_pairs_are_left_out_by_what_costs_little_before_dates_are_read(spark):
    dates = compare.birth_date_comparison("born")
    field = model.Model(
        prior=0.01, comparisons=[dates, *FIELD.comparisons], rules=[NAME],
        m=FIELD.m | {"born": [0.05, 0.05, 0.05, 0.05, 0.1, 0.7]}, u=FIELD.u | {"born": [0.6, 0.3, 0.08, 0.015, 0.004, 0.001]})
    rows = _rows(spark).withColumn("born", F.date_add(F.lit("1980-01-01").cast("date"), F.col("unique_id").cast("int") * 97 % 60).cast("string"))
    pairs = blocking.block_pairs(rows, [NAME], ["city", "phone", "mail", "born"])
    every = model.predict(rows, field).where("match_probability >= 0.9")
    assert sorted(map(tuple, model.predict(rows, field, 0.9).collect())) == sorted(map(tuple, every.collect()))
    rough = model.highest_weight(field, rough=(*compare.DEAR_KINDS, *compare.LATER_KINDS))
    fine, weight = model.highest_weight(field), model.match_weight(field)
    assert compare.compare_pairs(pairs, field.comparisons).where((rough < fine) | (fine < weight)).isEmpty()
    plan = model.worth_comparing(pairs, field, 0.9)._jdf.queryExecution().analyzed().toString()
    later, sooner = plan.splitlines()[:2]
    assert "Filter" in sooner and "levenshtein(phone" in sooner and "datediff" not in sooner and "datediff" in later
    # unequal users leave an email no level but those of its likeness
    apart = pairs.where(F.substring_index("mail_l", "@", 1) != F.substring_index("mail_r", "@", 1))
    mails = model.Model(0.01, [MAIL], {"mail": FIELD.m["mail"]}, {"mail": FIELD.u["mail"]}, rules=[NAME])
    most = apart.agg(F.max(model.highest_weight(mails))).first()[0]
    assert most < mails.prior_weight + mails.weights(MAIL)[-2] - 1


def test_email_level_takes_one_pair_of_texts_to_python(spark):
    """A pair of emails goes to Python once, for whole texts and users alike, and not at all where either is equal."""
    texts = [None, "", "@", "anna", "anna@x.org", "anna@y.org", "hanna@x.org", "@x.org", "martha.1@x.org", "marhta.1@mail.y.com", "b@x.org",
             "m" * 70 + "@x.org", "m" * 70 + "@y.org"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for email in (compare.email_comparison("e"), compare.Comparison("e", "email", (0.9, 0.7))):
        before = F.when(a.isNull() | b.isNull(), -1).when(a == b, email.top)
        for below, agrees in enumerate(compare._email_levels(email, a, b), start=1):
            before = before.when(agrees, email.top - below)
        assert pairs.where(~compare.gamma(email, a, b).eqNullSafe(before.otherwise(0))).isEmpty()
        plan = pairs.select(compare.gamma(email, a, b).alias("level"))._jdf.queryExecution().optimizedPlan().toString()
        evaluated = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
        assert len(evaluated) == 1 and evaluated[0].count("passed(") == 1


def test_levels_of_names_come_from_python_as_levels(spark):
    texts = [None, "", "garcia", "gracia", "garza", "smith", "smyth", "müller", "muller", "x" * 70, "x" * 69 + "y"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for name in (compare.name_comparison("n"), compare.jaro_winkler_at("n", (0.9,))):
        before = F.when(a.isNull() | b.isNull(), -1).when(a == b, name.top)
        for below, agrees in enumerate(compare._winkler_levels(name, a, b), start=1):
            before = before.when(agrees, name.top - below)
        assert pairs.where(~compare.gamma(name, a, b).eqNullSafe(before.otherwise(0))).isEmpty()
        assert "passed(" in pairs.select(compare.gamma(name, a, b).alias("level"))._jdf.queryExecution().optimizedPlan().toString()
