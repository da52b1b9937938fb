"""Refined blocks, the prior, u, EM, sketches, verified links, places and batched distances."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import catalog
from checks.catalog import FIXED_MODEL, PEOPLE_ROLES, RULES, SINGLE, enhanced_people
from checks.people import people
from twinfold import resolve
from twinfold.functions import geo, similarity
from twinfold.operators import blocking, check, merge, model, prior, refine, roles, sketches
from twinfold.operators.blocking import BlockingRule
from twinfold.operators.scratch import materialize

from .conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def base(spark):
    return materialize(enhanced_people(spark, SMALL), "people")


def pairs_of(df, key="unique_id"):
    return Counter((r[f"{key}_l"], r[f"{key}_r"]) for r in df.collect())


# ---------------------------------------------------------------- refined blocks


def expected_refinement(rows, rules, limit, neighbours):
    """Pairs by plain loops over sets of rules, then over the sorted order of large blocks."""
    def block(row, own):
        values = tuple(row[c] for r in own for c in rules[r])
        return None if any(v in (None, "") for v in values) else (own, values)

    ids = sorted(rows)
    open_ = {i: [(r,) for r in range(len(rules)) if block(rows[i], (r,))] for i in ids}
    found, first_large, level = set(), {}, 1
    while any(open_.values()):
        members = defaultdict(list)
        for i in ids:
            for own in open_[i]:
                members[block(rows[i], own)].append(i)
        large = {b for b, m in members.items() if len(m) > limit}
        for b, m in members.items():
            if b not in large:
                found |= set(combinations(m, 2))
        if level == 1:
            first_large = {b: members[b] for b in large}
        level += 1
        crossed = {}
        for i in ids:
            still = {own for own in open_[i] if block(rows[i], own) in large}
            crossed[i] = [own for own in combinations(range(len(rules)), level)
                          if all(tuple(x for x in own if x != r) in still for r in own)]
        open_ = crossed
    for m in first_large.values():
        ordered = sorted(m, key=lambda i: (" ".join(
            rows[i][rule[0]] for rule in rules if rows[i][rule[0]] not in (None, "")).encode(), i))
        for k, a in enumerate(ordered):
            found |= {tuple(sorted((a, b))) for b in ordered[k + 1:k + 1 + neighbours]}
    return found


@pytest.mark.parametrize("limit,neighbours", [(3, 2), (8, 1), (1000, 5)])
def test_refined_pairs_equal_plain_loops(spark, limit, neighbours):
    draw = random.Random(limit)
    rows = {f"r{i:03}": {c: draw.choice([None, "", *"abc"[: n + 1], f"{c}{draw.randint(0, 9 * n)}"])
                         for n, c in enumerate(("p", "q", "s", "t"), start=0)} for i in range(120)}
    df = spark.createDataFrame([(k, *v.values()) for k, v in rows.items()], "unique_id string, p string, q string, s string, t string")
    rules = [("p",), ("q",), ("s",), ("t",)]
    df = materialize(df, "rows")
    got = pairs_of(refine.refined_pairs(df, [BlockingRule(r[0], r) for r in rules], ["q"], "unique_id", limit, neighbours))
    assert max(got.values(), default=1) == 1
    assert set(got) == expected_refinement(rows, rules, limit, neighbours)
    side = df.withColumn("new", F.substring("unique_id", 4, 1).isin(*"02468"))
    links = pairs_of(refine.refined_pairs(
        materialize(side, "sides"), [BlockingRule(r[0], r) for r in rules], [], "unique_id", limit, neighbours, "new"))
    even = {i: i[3] in "02468" for i in rows}
    assert set(links) == {(a, b) if even[b] else (b, a) for a, b in set(got) if even[a] != even[b]}


def test_work_grows_with_the_table_under_a_hot_value(spark):
    """A third of the records shares one value: the pairs formed grow as the records do."""
    counts = []
    for n in (3000, 6000):
        df = spark.range(n).select(
            F.col("id").cast("string").alias("unique_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
                F.concat(F.lit("v"), F.col("id") % (n // 6))).alias("a"), F.concat(F.lit("w"), F.col("id") % (n // 4)).alias("b"))
        rules = [BlockingRule("a", ("a",)), BlockingRule("b", ("b",))]
        counts.append(refine.refined_pairs(materialize(df, "hot"), rules).count())
    assert counts[1] < 2.5 * counts[0] and counts[0] < 3000 * 12


def test_recall_with_a_hot_value_under_refinement(spark):
    """At sf0.01 a third of the records has one zip code, so its block is refined."""
    rows = people(spark, MIDDLE)
    hot = F.pmod(F.xxhash64("unique_id"), F.lit(3)) == 0
    rows = materialize(rows.withColumn("postal_code", F.when(hot, F.lit("12345")).otherwise(F.col("postal_code"))), "hot")
    found = resolve(rows.drop("entity_id"), key="unique_id", random_pairs=50_000)
    both = found.clusters.join(rows.select("unique_id", "entity_id"), "unique_id")

    def pairs(*columns):
        return both.groupBy(*columns).count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]

    right = pairs("cluster_id", "entity_id")
    print("precision", right / pairs("cluster_id"), "recall", right / pairs("entity_id"), "pairs", found.pairs.count())
    assert right / pairs("cluster_id") >= 0.99 and right / pairs("entity_id") >= 0.99


# ---------------------------------------------------------------- prior, u, EM


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_prior_is_near_the_truth(spark, folder):
    rows = materialize(enhanced_people(spark, folder), "people")
    n = rows.count()
    shares = {c: 1.0 for c in rows.columns}
    rules = blocking.propose_rules(rows.columns, PEOPLE_ROLES, shares)
    value = prior.recaptured_prior(rows, blocking.cost_rules(rows, rules), n)
    true = rows.groupBy("entity_id").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] / (n * (n - 1) / 2)
    assert 0.5 < value / true < 2


def test_prior_of_awkward_tables(spark):
    one = spark.createDataFrame([("a", "x")], "unique_id string, email_norm string")
    rule = BlockingRule("email", ("email_norm",))
    assert prior.recaptured_prior(one, blocking.cost_rules(one, [rule]), 1) == 1.0
    two = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "unique_id string, email_norm string")
    assert prior.recaptured_prior(two, blocking.cost_rules(two, [rule]), 3) == pytest.approx(1 / 0.95 / 3)
    assert prior.column_source("last_name_metaphone") == prior.column_source("first_name_norm") == "name"
    assert prior.column_source("geo_cell_3") == prior.column_source("geo_point") and prior.column_source("zip_norm") == "zip"
    costs = blocking.cost_rules(two, [rule, BlockingRule("again", ("email_norm",))])
    assert [c.rule for c in prior.independent_rules(costs)] == [BlockingRule("again", ("email_norm",))]


def test_u_of_equality_is_exact(spark, base):
    rows = [r.asDict() for r in base.collect()]
    got = {r["comparison"]: r for r in model.equality_u(base, FIXED_MODEL.comparisons).collect()}
    for c in FIXED_MODEL.comparisons:
        values = [r[c.column] for r in rows if r[c.column] is not None]
        equal = sum(n * (n - 1) // 2 for n in Counter(values).values())
        assert got[c.column]["filled"] == len(values) and got[c.column]["equal_pairs"] == equal
        assert got[c.column]["u"] == pytest.approx(2 * equal / len(values) / (len(values) - 1))
    u, error = model.train_u(base, FIXED_MODEL.comparisons, len(rows), 20_000)
    for c in FIXED_MODEL.comparisons:
        assert sum(u[c.column]) == pytest.approx(1, abs=1e-4) and u[c.column][-1] == pytest.approx(max(got[c.column]["u"], 1e-6))
        assert error[c.column][-1] == 0


def test_em_on_the_driver_equals_em_by_jobs(spark, base):
    patterns = materialize(model.training_patterns(base, RULES, FIXED_MODEL.comparisons), "patterns")
    both = [model.expectation_maximisation(
        patterns, FIXED_MODEL.comparisons, RULES, FIXED_MODEL.u, 0.001, most_patterns=most) for most in (0, 10**6)]
    for jobs, local in zip(both[0].m, both[1].m, strict=True):
        assert jobs.keys() == local.keys()
        for column in jobs:
            assert jobs[column] == pytest.approx(local[column], abs=1e-9)
    assert both[0].prior == pytest.approx(both[1].prior) and both[0].pairs == both[1].pairs
    assert both[0].converged == both[1].converged
    for a, b in zip(both[0].objective, both[1].objective, strict=True):
        assert a == pytest.approx(b)


def test_a_column_of_the_only_rule_is_trained(spark, base):
    settings = model.Settings(FIXED_MODEL.comparisons, [BlockingRule("date", ("date_norm",))])
    found = model.train(base, settings, base.count(), max_pairs=20_000)
    assert found.untrained == [] and "date_norm" in found.trained
    assert found.m["date_norm"][-1] > 0.9 and sum(found.m["date_norm"]) == pytest.approx(1)  # all true pairs share it


def test_training_prefers_rules_with_few_pairs(base):
    costs = blocking.cost_rules(base, [*RULES, BlockingRule("state", ("state_norm",))])
    chosen = model.training_rules(costs, FIXED_MODEL.comparisons)
    assert "state" not in {c.rule.name for c in chosen}
    for c in FIXED_MODEL.comparisons:
        assert sum(not model._held(c, x.rule) for x in chosen) >= 2


# ---------------------------------------------------------------- sketches and roles


def test_sketches_merge_and_keep_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("some"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"),
                                     F.lit("one").alias("one"), F.lit(None).cast("string").alias("none"))
    parts = [sketches.column_sketches(df.where(F.col("some") % 3 == i)) for i in range(3)]
    found = {r["column_name"]: r for r in sketches.sketched_profile(sketches.merge_sketches(*parts)).collect()}
    for column, exact in (("some", 50_000), ("half", 100_000), ("one", 1), ("none", 0)):
        assert abs(found[column]["distinct_values"] - exact) <= exact * sketches.sketch_error() + 0.5
        assert found[column]["total_rows"] == 200_000
    assert found["half"]["non_null_rows"] == 100_000 and found["half"]["cardinality_ratio_nonnull"] == pytest.approx(0.5, abs=0.02)
    empty = sketches.sketched_profile(sketches.column_sketches(df.where("false"))).collect()
    assert {r["distinct_values"] for r in empty} == {0} and {r["non_null_share"] for r in empty} == {0.0}


def test_roles_next_to_a_limit_are_counted(spark):
    """9,999 and 10,001 values in 100,000 rows are on two sides of a tenth; a sketch cannot tell."""
    for values, role in ((9_999, "category_enum"), (10_001, None)):
        df = spark.range(100_000).select(F.concat(F.lit("kind "), F.col("id") % values).alias("sort_of"))
        assert roles.infer_roles(df).get("category_enum") == ("sort_of" if role else None)


# ---------------------------------------------------------------- verified links


def test_links_are_verified_and_bands_split(spark):
    draw = random.Random(8)
    texts = {}
    for family in range(15):
        words = [f"w{family}_{i}" for i in range(30)]
        for _ in range(draw.choice([1, 2, 12])):
            kept = [w for w in words if draw.random() > draw.choice([0, 0.05, 0.3])]
            texts[len(texts)] = " ".join(kept) or "x"
    texts |= {900: None, 901: "", 902: " \n", 903: texts[0]}
    df = spark.createDataFrame(list(texts.items()), "id bigint, t string")
    sets = {i: frozenset((t or "").split()) for i, t in texts.items()}
    links = {(r.src, r.dst) for r in merge.verified_edges(df, "id", "t").collect()}
    assert links and all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)
    assert (903, 0) in links and not {i for pair in links for i in pair} & {900, 901, 902}
    # within each band the first similar leader, in the order of ids
    factors, offsets = (np.array(c, dtype=np.uint64) for c in merge.permutation_constants())
    bands, first = defaultdict(list), {}
    for i in sorted(sets):
        if sets[i] and first.setdefault(sets[i], i) == i:
            for band in merge.band_keys_of(" ".join(sorted(sets[i])), factors, offsets):
                bands[band].append(i)
    wanted = {(i, first[s]) for i, s in sets.items() if s and first[s] != i}
    for members in bands.values():
        leaders = []
        for i in members:
            lead = next((x for x in leaders if len(sets[x] & sets[i]) >= 0.8 * len(sets[x] | sets[i])), None)
            if lead is None:
                leaders.append(i)
            else:
                wanted.add((i, lead))
    assert links == wanted
    roots = {r.id: r.root for r in merge.merge_verified(df, "id", "t").collect()}
    assert roots.keys() == texts.keys() and roots[903] == roots[0] == 0 and roots[900] == 900


# ---------------------------------------------------------------- places


def haversine(a, b):
    (p, q), (r, s) = [tuple(map(math.radians, x)) for x in (a, b)]
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("near", [0.5, 20.0, 300.0])
def test_near_places_share_a_cell(spark, near):
    """Also at the poles and around the date line."""
    draw = random.Random(int(near))
    rows = []
    for i in range(4000):
        lat = draw.choice([draw.uniform(-90, 90), draw.uniform(86, 90), draw.uniform(-90, -86)])
        lon = draw.choice([draw.uniform(-180, 180), draw.uniform(179, 180), -180 + draw.uniform(0, 1)])
        step = near / geo.DEGREE_KM
        other = min(max(lat + draw.uniform(-step, step), -90.0), 90.0)
        wide = min(step / max(math.cos(math.radians(other)), 1e-9), 180.0)
        turned = (lon + draw.uniform(-wide, wide) + 180) % 360 - 180
        if haversine((lat, lon), (other, turned)) <= near:
            rows.append((i, lat, lon, other, turned))
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double")
    left, right = geo.geo_cells(F.col("a"), F.col("b"), near), geo.geo_cells(F.col("c"), F.col("d"), near)
    alone = df.where(~F.arrays_overlap(F.array(*left), F.array(*right)))
    assert len(rows) > 500 and alone.collect() == []
    km = df.select("i", geo.great_circle_km(*[F.col(c) for c in "abcd"]).alias("km")).collect()
    assert all(r.km == pytest.approx(haversine(rows_[1:3], rows_[3:]), abs=1e-6)
               for r, rows_ in zip(sorted(km), sorted(rows), strict=True))


def test_places_become_roles_rules_and_levels(spark):
    rows = catalog.placed_customers(spark, SMALL).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    found = roles.infer_roles(rows)
    assert found["geo_lat"] == "latitude" and found["geo_lon"] == "longitude"
    from twinfold.plans.configure import auto_configure
    plan = auto_configure(rows.withColumn("email", F.concat("unique_id", F.lit("@x.y"))))
    assert "geo_point" in {c.column for c in plan.settings.comparisons}
    assert any(d.rule.name == "near_0" for d in plan.diagnostics)
    odd = spark.createDataFrame([("91", "0"), ("x", "1"), (None, "1"), ("45.5", "-181"), ("45.5", "7")], "a string, o string")
    points = [r[0] for r in odd.select(geo.geo_point(F.col("a"), F.col("o"))).collect()]
    assert points == [None, None, None, None, "45.5,7.0"]


# ---------------------------------------------------------------- batched distances, check


def test_batched_distances_equal_one_by_one():
    draw = random.Random(2)
    some = lambda: "".join(draw.choices("abcdé日 ", k=draw.randint(1, 64 if draw.random() < 0.1 else 12)))
    left, right = zip(*[(some(), some()) for _ in range(1500)])
    assert similarity.damerau_batch(left, right).tolist() == [similarity.damerau(a, b) for a, b in zip(left, right)]
    assert similarity.common_subsequence_batch(left, right).tolist() == [
        similarity.common_subsequence(a, b) for a, b in zip(left, right)]
    words = [" ".join(draw.choices(["a", "bob", "smith", "x y", "Ann", "é"], k=draw.randint(0, 6))) * draw.choice([1, 1, 12]) for _ in range(800)]
    assert similarity.token_set_batch(words, words[::-1]).tolist() == [
        similarity.token_set_ratio_text(a, b) for a, b in zip(words, words[::-1])]


def test_a_named_threshold_is_kept():
    assert check.check_threshold(10, 0.95) == 0.95 and check.check_threshold(10) == check.BELOW_1000


def test_costs_of_phonetic_rules(spark, base):
    got = {r["rule_name"]: (r["comparisons"], r["largest_block"], r["blocks"]) for r in catalog.metaphone_rule_costs(spark, SMALL).collect()}
    rows = [r.asDict() for r in base.collect()]
    rules = {"metaphone_full_name": ("first_name_metaphone", "last_name_metaphone"),
             "exact_last_name_metaphone": ("last_name_metaphone",), "zip_lastname_meta": ("zip_norm", "last_name_metaphone")}
    for name, columns in rules.items():
        sizes = Counter(tuple(r[c] for c in columns) for r in rows if all(r[c] not in (None, "") for c in columns))
        assert got[name] == (sum(n * (n - 1) // 2 for n in sizes.values()), max(sizes.values()), len(sizes))


def test_fuzzy_rescoring_against_plain_python(spark, base):
    got = catalog.fuzzy_rescore(spark, SMALL).collect()
    plain = {(r["unique_id_l"], r["unique_id_r"]): r["match_probability"] for r in catalog.new_record_matches(spark, SMALL).collect()}
    known = {r["unique_id"]: r.asDict() for r in base.collect()}
    columns = check.fuzzy_columns(base.columns, PEOPLE_ROLES)
    assert len(got) == len(plain) and columns
    for r in got:
        left, right = known[r["unique_id_l"]], known[r["unique_id_r"].removeprefix("new_")]
        total = weight = 0.0
        for c in columns:
            a, b = (left[c] or "").strip(), (right[c] or "").strip()
            if a and b:
                w = 2.0 if any(x in c for x in check.NAME_WORDS) else 1.0
                total += w * similarity.token_set_ratio_text(a, b)
                weight += w
        score = total / weight if weight else 0.0
        assert r["fuzzy_score"] == pytest.approx(score, abs=1e-5)
        boost = max(0.0, (score - 85) / 15 * 0.1)
        assert r["adjusted"] == pytest.approx(min(1.0, plain[r["unique_id_l"], r["unique_id_r"]] + boost), abs=1e-5)
