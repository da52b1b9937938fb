import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.operators import blocking, check, clusters, compare, components, dedupe, merge, model
from twinfold.operators.numbering import dense_number, number_within
from twinfold.operators.profile import profile_columns
from twinfold.operators.roles import infer_roles
from twinfold.operators.skew import skew_join

RULES = [blocking.BlockingRule("a", ("a",)), blocking.BlockingRule("bc", ("b", "c"))]


@pytest.fixture(scope="module")
def records(spark):
    """Key "hot" of column a holds a third of the rows; some keys are null or blank."""
    rows = []
    for i in range(90):
        a = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"a{i % 11}"
        rows.append((f"{i:03d}", a, "" if i % 13 == 0 else f"b{i % 5}", f"c{i % 4}"))
    return spark.createDataFrame(rows, "unique_id string, a string, b string, c string")


def brute_pairs(records, rules=RULES):
    found = {}
    rows = sorted(records.collect())
    for left, right in itertools.combinations(rows, 2):
        for no, rule in enumerate(rules):
            if all(left[c] and left[c] == right[c] for c in rule.columns):
                found.setdefault((left["unique_id"], right["unique_id"]), []).append(no)
    return found


def test_pairs_costs_and_pieces(records):
    expected = brute_pairs(records)
    first = {(*k, v[0]) for k, v in expected.items()}
    plain = blocking.block_pairs(records, RULES).collect()
    pieces = blocking.block_pairs(records, RULES, largest_block=30, piece_pairs=9, pairs=900_000).collect()
    for got in (plain, pieces):
        assert len(got) == len(first)
        assert {(r["unique_id_l"], r["unique_id_r"], r["rule_no"]) for r in got} == first
    every = blocking.block_pairs(records, RULES, every_rule=True).count()
    costs = blocking.cost_rules(records, RULES)
    assert every == sum(c.comparisons for c in costs) == sum(map(len, expected.values()))
    assert blocking.matched_pairs(records, RULES) == len(expected)
    assert costs[0].largest_block == 30


def test_links_to_large_blocks(spark, records):
    new = records.where("unique_id < '030'").withColumn(
        "unique_id", F.concat(F.lit("n"), "unique_id"))
    plain = blocking.block_links(new, records, RULES, [])
    pieces = blocking.block_links(new, records, RULES, [], piece_rows=4)
    rows = lambda df: sorted((r["unique_id_l"], r["unique_id_r"], r["rule_no"]) for r in df.collect())
    assert rows(plain) == rows(pieces)
    expected = {(a["unique_id"], b["unique_id"]) for a in records.collect() for b in new.collect()
                if any(all(a[c] and a[c] == b[c] for c in r.columns) for r in RULES)}
    assert {r[:2] for r in rows(pieces)} == expected and len(rows(pieces)) == len(expected)


def test_minhash_estimates_jaccard():
    """Band agreement follows the likeness of the word sets, not their single lowest word."""
    factors, offsets = (np.array(c, dtype=np.uint64) for c in merge.permutation_constants())
    shared = lambda likeness: np.mean([
        bool(set(merge.band_keys_of(" ".join(f"{t}w{i}" for i in range(200)), factors, offsets))
             & set(merge.band_keys_of(" ".join(
                 f"{t}w{i}" for i in range(200 - likeness, 400 - likeness)), factors, offsets)))
        for t in range(60)])
    # 190 of 210 words in common: 0.905 alike; 100 of 300: 0.33 alike
    assert shared(190) > 0.85 and shared(100) < 0.05


def test_keys_do_not_run_together(spark):
    rows = spark.createDataFrame(
        [("1", "a|", "b"), ("2", "a", "|b"), ("3", "a|,", "b"), ("4", "a", ",b")],
        "unique_id string, a string, b string")
    keys = rows.select(blocking.BlockingRule("x", ("a", "b")).key().alias("k")).distinct()
    assert keys.count() == 4


def test_rule_selection_and_fallbacks():
    cost = lambda name, n: blocking.RuleCost(blocking.BlockingRule(name, (name,)), n, 1, 1)
    chosen, notes = blocking.select_rules([cost("x", 50), cost("y", 0), cost("z", 7)], 1, 60)
    assert [r.name for r in chosen] == ["z"] and [n.reason for n in notes] == [
        "selected", "zero_comparisons", "selected"]
    chosen, notes = blocking.select_rules([cost("x", 99), cost("y", 0), cost("z", 70)], 5, 60)
    assert [r.name for r in chosen] == ["z"] and notes[2].reason == "fallback_min_comparisons"
    chosen, notes = blocking.select_rules([cost("x", 0)], 5, 60)
    assert [r.name for r in chosen] == ["x"] and notes[0].reason == "fallback_first_candidate"


def test_skew_join_with_hot_and_null_keys(spark, records):
    small = records.where("a is not null").groupBy("a").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        plain = records.join(small, ["a"], how)
        split = skew_join(records, small, "a", "n", how, min_hot_rows=10)
        assert sorted(map(str, split.select(plain.columns).collect())) == sorted(
            map(str, plain.collect()))


def test_numbering(spark, records):
    got = number_within(records.where("a is not null"), "a", ["unique_id"], "nth").collect()
    for key, rows in itertools.groupby(sorted(got, key=lambda r: (r["a"], r["unique_id"])),
                                       key=lambda r: r["a"]):
        assert [r["nth"] for r in rows] == list(range(1, 1 + sum(r["a"] == key for r in got)))
    dense = dense_number(records.select("unique_id"), ["unique_id"], "nth").collect()
    assert [r["nth"] for r in sorted(dense)] == list(range(1, 91))


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_components(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(components, "MIN_HOT_ROWS", hot_rows)
    pairs = [(1, 3), (2, 3), (4, 5), *((6, i) for i in range(7, 40)), (39, 40), (50, 40), (41, 50)]
    got = {r["id"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] == 4
    assert {got[i] for i in range(6, 42)} | {got[50]} == {6} and len(got) == 42
    assert components.connected_components(
        spark.createDataFrame([], "src int, dst int")).count() == 0


def test_lone_records_are_clusters(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "unique_id string")
    pairs = spark.createDataFrame(
        [("a", "b", 0.2)], "unique_id_l string, unique_id_r string, match_probability double")
    found = clusters.cluster_pairs(rows, pairs, 0.5)
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("b", "b"), ("c", "c")]
    assert clusters.representatives(found).count() == 3


def test_thresholds():
    assert [clusters.cluster_threshold(n) for n in (999, 1000, 4999, 5000)] == [0.85, 0.9, 0.9, 0.99]
    assert [check.check_threshold(n) for n in (999, 1000, 4999, 5000)] == [0.85, 0.9, 0.9, 0.95]
    assert check.check_threshold(999, 0.8) == 0.8


def test_boost_and_verdicts(spark):
    rows = spark.createDataFrame(
        [(0.8, 85.0), (0.8, 100.0), (0.95, 100.0), (0.8, 10.0)], "p double, s double")
    got = rows.select(F.round(check.boosted(F.col("p"), F.col("s")), 6)).collect()
    assert [r[0] for r in got] == [0.8, 0.9, 1.0, 0.8]
    judged = spark.createDataFrame([(p,) for p in (0.95, 0.949, 0.75, 0.749)], "p double")
    assert [r[0] for r in judged.select(check.verdict(F.col("p"), 0.95)).collect()] == [
        "duplicate", "potential_duplicate", "potential_duplicate", "unique"]
    simple = spark.createDataFrame([(None,), (0.91,), (0.9,)], "p double")
    assert [r[0] for r in simple.select(check.simple_verdict(F.col("p"))).collect()] == [
        "unique", "duplicate", "potential_duplicate"]


def test_profile_of_empty_and_null_tables(spark):
    empty = profile_columns(spark.createDataFrame([], "a string, b int")).collect()
    assert [(r["total_rows"], r["non_null_share"]) for r in empty] == [(0, 0.0)] * 2
    nulls = profile_columns(spark.createDataFrame([(None,), ("x",), ("x",)], "a string")).first()
    assert nulls["cardinality_ratio"] == 2 / 3 and nulls["cardinality_ratio_nonnull"] == 1 / 3


def test_roles_by_distribution(spark):
    rows = [(i, f"free text {i}", "x" if i % 2 else "y", None) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, words string, kind string, gap string")
    assert dict(infer_roles(df)) == {
        "numeric_id": "n", "text_freeform": "words", "category_enum": "kind"}
    assert infer_roles(df.limit(0)) == {}


def test_em_equals_plain_loop(spark):
    comparisons = [compare.exact("x"), compare.levenshtein_at("y", (1,)), compare.exact("z")]
    rules = [blocking.BlockingRule("r", ("x",)), blocking.BlockingRule("s", ("z",))]
    u = {"x": [0.9, 0.1], "y": [0.8, 0.15, 0.05], "z": [0.7, 0.3]}
    rows = [(no, gx, gy, gz, 3 + 7 * gx + 11 * gy * gz + no) for no in (0, 1)
            for gx in (-1, 0, 1) for gy in (-1, 0, 1, 2) for gz in (0, 1)]
    patterns = spark.createDataFrame(
        rows, "rule_no int, gamma_x int, gamma_y int, gamma_z int, pairs bigint")
    got = model.expectation_maximisation(patterns, comparisons, rules, u, 0.01, 1e-9, 12)
    for no, left_out in ((0, "x"), (1, "z")):
        names = [c for c in ("x", "y", "z") if c != left_out]
        m = {c: model.start_m(len(u[c]) - 1) for c in names}
        odds = 0.01 / 0.99 * 0.95 / u[left_out][-1]
        prior = odds / (1 + odds)
        for _ in range(12):
            sums = {c: [0.0] * len(u[c]) for c in names}
            matches = total = 0.0
            for r in rows:
                if r[0] != no:
                    continue
                ratio = prior / (1 - prior)
                gammas = dict(zip("xyz", r[1:4]))
                for c in names:
                    if gammas[c] >= 0:
                        ratio *= m[c][gammas[c]] / u[c][gammas[c]]
                p = ratio / (1 + ratio)
                matches, total = matches + p * r[4], total + r[4]
                for c in names:
                    if gammas[c] >= 0:
                        sums[c][gammas[c]] += p * r[4]
            prior = matches / total
            m = {c: [x / sum(s) for x in s] for c, s in sums.items()}
        assert got.prior[no] == pytest.approx(prior)
        for c in names:
            assert got.m[no][c] == pytest.approx(m[c])
        climbs = got.objective[no]
        assert all(b >= a - 1e-9 for a, b in zip(climbs, climbs[1:]))


def test_random_pairs(spark):
    rows = spark.createDataFrame([(f"{i:02d}",) for i in range(30)], "unique_id string")
    everything = model.random_pairs(rows, [], 30, 1000).collect()
    keys = {frozenset((r["unique_id_l"], r["unique_id_r"])) for r in everything}
    assert len(everything) == len(keys) == 435
    some = model.random_pairs(rows, [], 30, 100).collect()
    assert len(some) == 90 and all(r["unique_id_l"] != r["unique_id_r"] for r in some)


def test_patterns_count_copies(spark, records):
    """Collapsing copies changes no pattern count."""
    doubled = records.unionByName(
        records.withColumn("unique_id", F.concat("unique_id", F.lit("x"))))
    comparisons = [compare.exact("b"), compare.jaro_winkler_at("c", (0.7,))]
    got = model.training_patterns(doubled, RULES, comparisons)
    pairs = compare.compare_pairs(
        blocking.block_pairs(doubled, RULES, ["b", "c"], every_rule=True), comparisons)
    plain = pairs.groupBy("rule_no", "gamma_b", "gamma_c").agg(F.count("*").alias("pairs"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_dedupe_keeps_last(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "unique_id string, v string")
    pairs = spark.createDataFrame([("1", "3"), ("2", "3")], "unique_id_l string, unique_id_r string")
    mapping = dedupe.id_mapping(pairs)
    got = dedupe.dedupe_by_mapping(rows, mapping)
    assert sorted(map(tuple, got.collect())) == [("1", "c"), ("2", "b")]


def test_a_block_is_copied_along_the_grid_only(spark):
    """A block of 10,000 rows in 25 cells: each row of either side is copied five times."""
    rows = spark.range(10_000).selectExpr("lpad(id, 5, '0') AS unique_id", "'k' AS a")
    rules = [blocking.BlockingRule("a", ("a",))]
    sizes = blocking.block_sizes(rows, rules).selectExpr(
        "rule_no", "block_key", "block_rows AS rows_l", "block_rows AS rows_r")
    large = blocking._large_blocks(sizes, 2000)
    side = blocking._in_cells(
        blocking._side(rows, rules, ["unique_id"], "l"), large, "unique_id_l", "l", "r")
    assert side.count() == 50_000
    assert side.select("_cell_l", "_cell_r").distinct().count() == 25


def test_many_arrivals_of_one_key(spark):
    base = spark.range(40).selectExpr("concat('b', id) AS unique_id", "if(id < 30, 'k', 'other') AS a")
    new = spark.range(50).selectExpr("concat('n', id) AS unique_id", "if(id < 45, 'k', null) AS a")
    rules = [blocking.BlockingRule("a", ("a",))]
    links = blocking.block_links(new, base, rules, [], piece_rows=7)
    assert links.count() == links.distinct().count() == 30 * 45


def test_pairs_of_many_rules_are_counted(spark, records):
    many = [blocking.BlockingRule(str(i), c) for i, c in enumerate(
        [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c"), ("b",)])]
    assert blocking.matched_pairs(records, many) == len(brute_pairs(records, many))


def test_similar_edges_keep_only_the_links(spark, tmp_path):
    from pathlib import Path

    from twinfold.operators.scratch import scratch_root

    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    texts = spark.createDataFrame(
        [(1, "a b c"), (2, "c b a"), (3, None), (4, " "), (5, "x")], "id bigint, t string")
    found = merge.similar_edges(texts, "id", "t")
    assert [tuple(r) for r in found.collect()] == [(2, 1)]
    assert [p.name.split("-")[0] for p in set(root.iterdir()) - before] == ["similar"]


def test_training_does_not_hang_on_the_number_of_rows(spark):
    """Disjoint copies of a table leave prior times rows and m about as they were, also where
    only a share of the blocks is compared."""
    def table(copies):
        people = spark.range(400 * copies).selectExpr("id AS e", "hash(id) AS h")
        twice = people.selectExpr("*", "explode(array(0, 1)) AS side")
        return twice.selectExpr(
            "concat(lpad(e, 6, '0'), side) AS unique_id", "concat('m', e) AS mail", "concat('p', e) AS phone",
            "if(side = 1 AND pmod(h, 5) = 0, concat('x', e), concat('n', e)) AS name",
            "concat('c', pmod(h, 7)) AS city")

    comparisons = [compare.exact(c) for c in ("mail", "phone", "name", "city")]
    rules = [blocking.BlockingRule("mail", ("mail",)), blocking.BlockingRule("city", ("city",))]
    found = {}
    for copies, pairs in ((1, 10**9), (8, 10**9), (8, 20_000)):
        df, rows = table(copies).persist(), 800 * copies
        got = model.train(df, model.Settings(comparisons, rules), rows, max_pairs=20_000, training_pairs=pairs)
        assert got.trained == ["mail", "phone", "name", "city"] and got.untrained == []
        found[copies, pairs] = got
        df.unpersist()
    for got in found.values():
        assert got.m["name"][1] == pytest.approx(0.8, abs=0.08)
        assert all(r["pairs"] > 0 and r["converged"] for r in got.runs)
    assert found[8, 20_000].prior == found[8, 10**9].prior
    assert found[8, 20_000].runs[1]["share"] < 0.05 and 10_000 < found[8, 20_000].runs[1]["pairs"] < 40_000
    assert set(found[1, 10**9].u_error["city"]) == {0.0}  # equality is counted, not sampled
    alone = model.train(table(1).drop("city"), model.Settings(comparisons[:1], rules[:1]), 800, max_pairs=1000)
    assert alone.trained == ["mail"] and alone.untrained == []  # the only rule holds it: trained on all pairs
    assert model.Model.from_dict(alone.to_dict()).trained == ["mail"]


def test_the_comparison_limit_grows_with_the_table():
    assert blocking.comparison_limit(10) == 20_000_000
    assert blocking.comparison_limit(10**9) == 500 * 10**9


def test_without_limits_no_rule_with_pairs_is_left_out():
    costs = [blocking.RuleCost(blocking.BlockingRule(str(n), (str(n),)), n, 1, 1) for n in (10**15, *range(9))]
    chosen, notes = blocking.select_rules(costs)
    assert [r.name for r in chosen] == [*map(str, range(1, 9)), str(10**15)]
    assert [n.reason for n in notes if not n.kept] == ["zero_comparisons"]


def test_pairs_of_any_rule_are_the_same_formed_or_not(spark, records, monkeypatch):
    rules = [blocking.BlockingRule("a", ("a",)), blocking.BlockingRule("b", ("b",))]
    doubled = records.unionByName(records)
    counted = blocking.matched_pairs(doubled, rules)
    monkeypatch.setattr(blocking, "MOST_COMBINATIONS", 0)
    assert blocking.matched_pairs(doubled, rules) == counted > 0
