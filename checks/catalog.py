"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold import Settings, resolve, check_incoming, ship_package
from twinfold.functions import similarity as sim
from twinfold.functions import text as tx
from twinfold.functions.phonetic import double_metaphone_alt
from twinfold.operators import blocking, cells, check, clusters, compare, dedupe, merge, model, prior, refine
from twinfold.operators import profile as prof
from twinfold.functions import geo
from twinfold.operators.components import connected_components
from twinfold.operators.derive import (
    align_to, coerce_to, enhance, name_columns, normalize_strings, place_columns, surname_aliases,
)
from twinfold.operators.numbering import dense_number, number_within
from twinfold.operators.roles import infer_roles, roles_table
from twinfold.operators.scratch import materialize, scratch_root
from twinfold.operators.skew import in_small_tasks
from twinfold.operators.sketches import column_sketches, merge_sketches, sketch_error, sketched_profile
from twinfold.sources.artifacts import load_model, save_model
from twinfold.sources.records import (
    column_types, read_csv, read_parquet, with_unique_id, write_csv, write_parquet,
)

from .people import PLACES, people

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed values shared with the oracle.
PEOPLE_ROLES = {
    "full_name": "full_name", "email": "email", "phone": "phone", "zip": "postal_code",
    "city": "city", "state": "state", "address": "address", "url": "website",
    "date": "date_of_birth",
}
EMAIL, PHONE = blocking.BlockingRule("email", ("email_norm",)), \
    blocking.BlockingRule("phone", ("phone_digits",))
ZIP_DATE = blocking.BlockingRule("zip_date", ("zip_norm", "date_norm"))
NAME_CITY = blocking.BlockingRule("name_city", ("last_name_norm", "city_norm"))
RULES = [EMAIL, PHONE, ZIP_DATE, NAME_CITY]
# Rules of one source each, for the prior; and weak ones whose blocks are large.
SINGLE = [blocking.BlockingRule(n, (c,)) for n, c in (
    ("email", "email_norm"), ("phone", "phone_digits"), ("zip", "zip_norm"), ("date", "date_norm"), ("url", "url_domain"))]
WEAK = [blocking.BlockingRule(n, (c,)) for n, c in (
    ("email", "email_norm"), ("zip", "zip_norm"), ("first_char", "first_name_first_char"), ("city", "city_norm"),
    ("state", "state_norm"))]
FIXED_MODEL = model.Model(
    prior=0.001,
    comparisons=[
        compare.jaro_winkler_at("last_name_norm", (0.7, 0.9)),
        compare.email_comparison("email_norm"),
        compare.levenshtein_at("phone_digits", (2, 4)),
        compare.exact("city_norm", True),
        compare.birth_date_comparison("date_norm"),
    ],
    m={"last_name_norm": [0.05, 0.15, 0.2, 0.6], "email_norm": [0.1, 0.1, 0.1, 0.2, 0.5],
       "phone_digits": [0.1, 0.1, 0.2, 0.6], "city_norm": [0.2, 0.8],
       "date_norm": [0.05, 0.05, 0.05, 0.05, 0.1, 0.7]},
    u={"last_name_norm": [0.85, 0.08, 0.02, 0.05], "email_norm": [0.95, 0.03, 0.01, 0.005, 0.005],
       "phone_digits": [0.97, 0.02, 0.008, 0.002], "city_norm": [0.95, 0.05],
       "date_norm": [0.6, 0.3, 0.08, 0.015, 0.004, 0.001]},
    rules=RULES,
)


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return function


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def enhanced_people(spark: SparkSession, folder: str) -> DataFrame:
    return enhance(people(spark, folder), PEOPLE_ROLES)[0]


def written_people(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(enhanced_people(spark, folder), "people")


# ------------------------------------------------------------------ sources


@query
def url_domain_report(spark, folder):
    """Scan, derive url_domain, block sizes and pairs per domain."""
    pages = table(spark, folder, "pages").select(tx.url_domain(F.col("url")).alias("domain"))
    rows = pages.groupBy("domain").agg(F.count("*").alias("domain_rows"))
    pairs = F.floor(F.col("domain_rows") * (F.col("domain_rows") - 1) / 2)
    counted = F.coalesce(F.col("domain") != "", F.lit(False))
    return rows.withColumn("domain_pairs", F.when(counted, pairs).otherwise(0))


@query
def csv_round_trip(spark, folder):
    """Write a table as CSV with header, read it back with inferred types."""
    path = scratch_path(spark, "csv")
    write_csv(table(spark, folder, "part"), path)
    return read_csv(spark, path)


@query
def parquet_round_trip(spark, folder):
    path = scratch_path(spark, "parquet")
    write_parquet(table(spark, folder, "supplier"), path)
    return read_parquet(spark, path)


@query
def table_columns(spark, folder):
    """Column names and types of a written CSV."""
    path = scratch_path(spark, "columns")
    write_csv(table(spark, folder, "customer"), path)
    return column_types(read_csv(spark, path))


@query
def unique_ids(spark, folder):
    keyed = with_unique_id(table(spark, folder, "customer"), "c_custkey")
    return keyed.select("unique_id", "c_name")


# ------------------------------------------------------------------ profile


@query
def profile_nonnull_cardinality(spark, folder):
    return prof.profile_columns(people(spark, folder))


@query
def profile_lineitem(spark, folder):
    return prof.profile_columns(table(spark, folder, "lineitem"))


@query
def sketched_lineitem(spark, folder):
    """Sketches of two parts of a table, kept apart and merged, next to its exact profile: whether the
    estimate is within the error told."""
    rows = table(spark, folder, "lineitem")
    odd = F.col("l_orderkey") % 2 == 1
    merged = merge_sketches(column_sketches(rows.where(odd)), column_sketches(rows.where(~odd)))
    exact = prof.profile_columns(rows).select("column_name", F.col("distinct_values").alias("exact"))
    apart = F.abs(F.col("distinct_values") - F.col("exact"))
    return sketched_profile(merged).join(exact, "column_name").select(
        "column_name", "total_rows", "non_null_rows", F.col("exact").alias("distinct_values"),
        (apart <= F.col("exact") * sketch_error() + 0.5).alias("within_error"))


@query
def profile_value_distribution(spark, folder):
    return prof.value_distribution(
        table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@query
def profile_count_percentiles(spark, folder):
    return prof.value_count_percentiles(
        table(spark, folder, "events"), ["user_id", "event_type"])


@query
def drop_incomplete_rows(spark, folder):
    return prof.drop_incomplete(people(spark, folder)).select("unique_id", "email", "phone")


@query
def sample_by_hash(spark, folder):
    orders = table(spark, folder, "orders")
    return prof.sample_rows(orders, "o_orderkey", 5000, orders.count()).select(
        "o_orderkey", "o_custkey")


@query
def threshold_filter(spark, folder):
    scored = scored_pairs(spark, folder, 0.9)
    return clusters.matched_edges(scored, 0.9)


# ------------------------------------------------------------------ roles


@query
def infer_roles_wide(spark, folder):
    return roles_table(spark, infer_roles(people(spark, folder).drop("entity_id"), "wide"))


@query
def infer_roles_loose(spark, folder):
    return roles_table(spark, infer_roles(people(spark, folder).drop("entity_id"), "loose"))


@query
def infer_roles_basic(spark, folder):
    return roles_table(spark, infer_roles(people(spark, folder).drop("entity_id"), "basic"))


@query
def infer_roles_by_type(spark, folder):
    """Tables without telling names: by type and distribution."""
    found = None
    for name in ("orders", "part", "events", "documents"):
        roles = roles_table(spark, infer_roles(table(spark, folder, name), "wide"))
        roles = roles.withColumn("table_name", F.lit(name))
        found = roles if found is None else found.unionByName(roles)
    return found


# ------------------------------------------------------------------ derive


@query
def normalize_contact(spark, folder):
    return enhanced_people(spark, folder).select(
        "unique_id", "first_name_norm", "last_name_norm", "first_name_first_char", "email_norm",
        "phone_digits", "zip_norm", "city_norm", "state_norm", "address_norm", "date_norm",
        "url_domain")


@query
def normalize_text(spark, folder):
    docs = normalize_strings(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang_norm", F.md5("text_norm").alias("text_norm_md5"),
                       F.length("text_norm").alias("text_norm_length"))


@query
def fold_accents(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(tx.fold_accents(F.col("text"))).alias("folded_md5"))


@query
def hash_ids(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey", tx.sha256_hex(key).alias("id_hash"), tx.sha256_mod(key).alias("id_hash_mod"),
        tx.mod_key(key - 500).alias("id_mod_1000"))


@query
def hash_texts(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", tx.sha256_hex(F.col("text")).alias("text_hash"))


@query
def parse_mixed_dates(spark, folder):
    rows = people(spark, folder)
    return rows.select(
        "unique_id", tx.date_norm(F.col("date_of_birth")).alias("any_format"),
        tx.date_norm(F.col("date_of_birth"), tx.ISO_ONLY).alias("iso_only"))


@query
def split_names(spark, folder):
    rows = people(spark, folder).withColumnRenamed("full_name", "name")
    first, rest = tx.split_at_first_blank(F.col("name"))
    tokens = name_columns(rows)
    return surname_aliases(tokens).select(
        "unique_id", first.alias("first_word"), rest.alias("rest"), "first_name", "last_name",
        "full_name", "surname")


@query
def phonetic_names(spark, folder):
    rows = enhanced_people(spark, folder)
    return rows.select(
        "unique_id", "first_name_metaphone", "last_name_metaphone",
        double_metaphone_alt(F.col("last_name_norm")).alias("last_name_alternate"))


@query
def coerce_incoming(spark, folder):
    """Order rows as text, read back as the types of the base table."""
    base = table(spark, folder, "orders")
    flagged = base.withColumn("o_open", F.col("o_orderstatus") == "O")
    texts = base.select(
        F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), "o_orderstatus").alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.col("o_totalprice").cast("string"))
        .alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 2 == 0, F.unix_timestamp("o_orderdate").cast("string"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("o_orderdate"),
        F.when(F.col("o_orderstatus") == "O", " Yes").otherwise("f").alias("o_open"))
    ready = align_to(coerce_to(texts, flagged.schema), flagged.schema)
    return ready.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.unix_timestamp("o_orderdate").alias("o_seconds"), "o_open")


# ------------------------------------------------------------------ blocking


@query
def block_pair_counts(spark, folder):
    rows = written_people(spark, folder)
    rules = blocking.propose_rules(rows.columns, PEOPLE_ROLES, prof.non_null_shares(rows))
    rules = [r for r in rules if "metaphone" not in "".join(r.columns)]
    costs = blocking.cost_rules(rows, rules)
    return spark.createDataFrame(
        [(c.rule.name, c.comparisons, c.largest_block, c.blocks) for c in costs],
        "rule_name string, comparisons bigint, largest_block bigint, blocks bigint")


@query
def metaphone_rule_costs(spark, folder):
    """The rules on phonetic codes, which SQL cannot make."""
    rows = written_people(spark, folder)
    rules = blocking.propose_rules(rows.columns, PEOPLE_ROLES, prof.non_null_shares(rows))
    costs = blocking.cost_rules(rows, [r for r in rules if "metaphone" in "".join(r.columns)])
    return spark.createDataFrame(
        [(c.rule.name, c.comparisons, c.largest_block, c.blocks) for c in costs],
        "rule_name string, comparisons bigint, largest_block bigint, blocks bigint")


@query
def block_sizes_skewed(spark, folder):
    """Blocks of one column with few, large values."""
    rules = [blocking.BlockingRule("user", ("user_id",)), blocking.BlockingRule("type", ("event_type",))]
    costs = blocking.cost_rules(table(spark, folder, "events"), rules)
    return spark.createDataFrame(
        [(c.rule.name, c.comparisons, c.largest_block, c.blocks) for c in costs],
        "rule_name string, comparisons bigint, largest_block bigint, blocks bigint")


@query
def select_blocking_rules(spark, folder):
    rows = written_people(spark, folder)
    costs = blocking.cost_rules(rows, [*RULES, blocking.BlockingRule("state", ("state_norm",))])
    chosen, notes = blocking.select_rules(costs, max_rules=3, max_comparisons=100_000)
    names = [r.name for r in chosen]
    return blocking.diagnostics_table(spark, notes).select(
        "name", F.col("comparisons").cast("bigint").alias("comparisons"), "kept", "reason",
        F.array_join("columns", ",").alias("columns"), F.col("name").isin(names).alias("chosen"))


@query
def candidate_pairs(spark, folder):
    rows = written_people(spark, folder)
    return blocking.block_pairs(rows, RULES).select("unique_id_l", "unique_id_r", "rule_no")


@query
def candidate_pairs_in_pieces(spark, folder):
    """The same pairs when every block counts as large."""
    rows = written_people(spark, folder)
    pairs = blocking.block_pairs(rows, RULES, largest_block=1000, piece_pairs=4)
    return pairs.select("unique_id_l", "unique_id_r", "rule_no")


@query
def matched_pair_count(spark, folder):
    rows = written_people(spark, folder)
    return spark.createDataFrame([(blocking.matched_pairs(rows, RULES),)], "pairs bigint")


@query
def refined_candidate_pairs(spark, folder):
    """Pairs of weak rules: small blocks whole, large ones crossed and swept by neighbourhood."""
    rows = written_people(spark, folder)
    return refine.refined_pairs(rows, WEAK).select("unique_id_l", "unique_id_r")


# ------------------------------------------------------------------ compare

COMPARED = {
    "compare_exact": compare.exact("state_norm"),
    "compare_jaro_winkler": compare.jaro_winkler_at("address_norm", (0.7, 0.9)),
    "compare_names": compare.name_comparison("last_name_norm"),
    "compare_levenshtein": compare.levenshtein_at("phone_digits", (2, 4)),
    "compare_email": compare.email_comparison("email_norm"),
    "compare_postcode": compare.postcode_comparison("zip_norm"),
    "compare_birth_date": compare.birth_date_comparison("date_norm"),
}


def _compare_query(name: str, comparison: compare.Comparison) -> None:
    def run(spark, folder):
        rows = written_people(spark, folder)
        pairs = blocking.block_pairs(rows, RULES, [comparison.column])
        return compare.compare_pairs(pairs, [comparison]).select(
            "unique_id_l", "unique_id_r", F.col(comparison.gamma).alias("level"))

    run.__name__ = name
    query(run)


for _name, _comparison in COMPARED.items():
    _compare_query(_name, _comparison)


@query
def string_similarities(spark, folder):
    """All pair functions on candidate pairs of people."""
    rows = written_people(spark, folder)
    rows = rows.withColumn("_address_lower", F.lower("address_norm"))
    pairs = cells.compared_pairs(rows, RULES, measures=[
        cells.Measure("jaro", "last_name_norm", sim.jaro_of), cells.Measure("jaro_winkler", "city_norm", sim.winkler_of),
        cells.Measure("damerau", "address_norm", sim.damerau_of, "int"), cells.Measure("jaccard", "address_norm", sim.jaccard_of),
        cells.Measure("cosine", "_address_lower", sim.cosine_of)])
    return pairs.select(
        "unique_id_l", "unique_id_r", F.round("jaro", 6).alias("jaro"), F.round("jaro_winkler", 6).alias("jaro_winkler"),
        "damerau", F.round("jaccard", 6).alias("jaccard"), F.round("cosine", 6).alias("cosine"))


@query
def text_similarities(spark, folder):
    """Whole texts of successive turns of a conversation."""
    turns = table(spark, folder, "conversations")
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        F.round(sim.cosine_distance(F.col("text"), F.col("next_text")), 6).alias("cosine"))


@query
def qgrams(spark, folder):
    parts = table(spark, folder, "part").groupBy("p_name").agg(F.count("*").alias("parts"))
    grams = None
    for q in (2, 3, 4, 5, 6):
        some = parts.select("p_name", F.lit(q).alias("q"), F.posexplode(
            sim.qgrams(F.col("p_name"), q)).alias("place", "gram"))
        grams = some if grams is None else grams.unionByName(some)
    return grams


@query
def array_pairs(spark, folder):
    """All word pairs of a part name and its type."""
    part = table(spark, folder, "part")
    pairs = sim.array_pairs(F.split("p_name", " "), F.split(F.concat_ws(" ", "p_type", "p_brand"), " "))
    return part.select("p_partkey", F.explode(pairs).alias("_p")).select(
        "p_partkey", F.col("_p")[0].alias("word_l"), F.col("_p")[1].alias("word_r"))


@query
def coordinate_pairs(spark, folder):
    """Pairings of two lists of coordinates, taken from numbers of the part table."""
    place = lambda lat, lon: F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    size, price = F.col("p_size"), F.col("p_retailprice")
    left, right = F.array(place(size, price), place(-size, price)), F.array(place(size + 1, price))
    return table(spark, folder, "part").select(
        "p_partkey", F.inline(sim.coordinate_pairs(left, right)))


NEAR_KM = 5.0


def placed_customers(spark, folder) -> DataFrame:
    """Customers around the capital of their nation."""
    places = spark.createDataFrame(PLACES, "c_nationkey int, lat double, lon double")
    key = F.col("c_custkey")
    customers = in_small_tasks(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), 20)
    return customers.join(F.broadcast(places), "c_nationkey").select(
        key.cast("string").alias("unique_id"),
        (F.col("lat") + (key * 37 % 1000 - 500) / 1000).alias("lat"), (F.col("lon") + (key * 91 % 1000 - 500) / 1000).alias("lon"))


@query
def near_places(spark, folder):
    """Pairs of customers within 5 km, through the cells in which near places meet, and their distance."""
    rows = placed_customers(spark, folder)
    rows = materialize(rows.withColumns(place_columns(F.col("lat"), F.col("lon"), NEAR_KM)), "places")
    rules = [blocking.BlockingRule(f"near_{i}", (f"geo_cell_{i}",)) for i in range(4)]
    pairs = blocking.block_pairs(rows, rules, ["lat", "lon"])
    apart = geo.great_circle_km(*[F.col(c) for c in ("lat_l", "lon_l", "lat_r", "lon_r")])
    return pairs.withColumn("km", apart).where(F.col("km") <= NEAR_KM).select(
        "unique_id_l", "unique_id_r", F.round("km", 6).alias("km"))


@query
def compare_distance(spark, folder):
    """Levels of distance between customers of one block."""
    rows = placed_customers(spark, folder)
    rows = materialize(rows.withColumns(place_columns(F.col("lat"), F.col("lon"), NEAR_KM)), "places")
    comparison = compare.distance_comparison("geo_point", (2.0, 5.0, 10.0))
    near = [blocking.BlockingRule("near", ("geo_cell_0",))]
    return cells.compared_pairs(rows, near, [comparison], bound=cells.agreeing(comparison)).where("gamma_geo_point > 0").select(
        "unique_id_l", "unique_id_r", F.col("gamma_geo_point").alias("level"))


# ------------------------------------------------------------------ model


@query
def estimate_prior(spark, folder):
    rows = written_people(spark, folder)
    value = model.estimate_prior(rows, RULES, 0.95)
    return spark.createDataFrame([(round(value, 12),)], "prior double")


@query
def recaptured_prior(spark, folder):
    """The prior by capture and recapture over rules of one source each."""
    rows = written_people(spark, folder)
    value = prior.recaptured_prior(rows, blocking.cost_rules(rows, SINGLE), rows.count())
    return spark.createDataFrame([(round(value, 12),)], "prior double")


@query
def equality_u(spark, folder):
    """u of equality from the frequencies of all values, without a sample."""
    found = model.equality_u(written_people(spark, folder), FIXED_MODEL.comparisons)
    return found.select("comparison", "filled", F.col("equal_pairs").cast("bigint").alias("equal_pairs"), F.round("u", 12).alias("u"))


@query
def em_round(spark, folder):
    """One round of EM on the pairs of every rule: shares of matches, and m per level."""
    rows = written_people(spark, folder)
    patterns = model.training_patterns(rows, RULES, FIXED_MODEL.comparisons)
    found = model.expectation_maximisation(
        patterns, FIXED_MODEL.comparisons, RULES, FIXED_MODEL.u, FIXED_MODEL.prior, max_rounds=1)
    levels = [
        (no, c, level, round(m, 9), round(found.prior[no], 9))
        for no, run in enumerate(found.m) for c, ms in run.items() for level, m in enumerate(ms)]
    return spark.createDataFrame(levels, "rule_no int, comparison string, level int, m double, share double")


@query
def estimate_u(spark, folder):
    rows = written_people(spark, folder)
    found = model.estimate_u(rows, FIXED_MODEL.comparisons, rows.count())
    return found.select("comparison", "level", "pairs", F.round("u", 9).alias("u"))


@query
def term_frequencies(spark, folder):
    rows = written_people(spark, folder)
    tf = compare.add_term_frequencies(rows, [compare.exact("city_norm", True)])
    return tf.select("unique_id", "city_norm", F.round("tf_city_norm", 9).alias("tf"))


def scored_people(spark, folder, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    rows = materialize(
        compare.add_term_frequencies(written_people(spark, folder), FIXED_MODEL.comparisons),
        "people")
    return rows, model.predict(rows, FIXED_MODEL, threshold, keep_levels=True, keep_values=False)


def scored_pairs(spark, folder, threshold: float | None = None) -> DataFrame:
    return scored_people(spark, folder, threshold)[1]


@query
def score_pairs(spark, folder):
    return scored_pairs(spark, folder).select(
        "unique_id_l", "unique_id_r", *[c.gamma for c in FIXED_MODEL.comparisons],
        F.round("match_weight", 5).alias("match_weight"),
        F.round("match_probability", 6).alias("match_probability"))


@query
def training_patterns(spark, folder):
    rows = written_people(spark, folder)
    return model.training_patterns(rows, RULES, FIXED_MODEL.comparisons)


@query
def train_em(spark, folder):
    """Level probabilities after training, through a saved and loaded model."""
    rows = written_people(spark, folder)
    trained = model.train(rows, Settings(FIXED_MODEL.comparisons, RULES), rows.count())
    path = scratch_path(spark, "model")
    save_model(spark, trained, path)
    kept = load_model(spark, path)
    levels = [(c, i, m, kept.u[c][i]) for c, ms in kept.m.items() for i, m in enumerate(ms)]
    return spark.createDataFrame(levels, "comparison string, level int, m double, u double")


# ------------------------------------------------------------------ clusters


@query
def connected_components_of_pairs(spark, folder):
    rows = written_people(spark, folder)
    pairs = blocking.block_pairs(rows, [EMAIL, PHONE])
    return connected_components(pairs, "unique_id_l", "unique_id_r")


@query
def components_of_copies(spark, folder):
    """Equal texts, linked to the first of them."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("unique_id"), "text")
    copies = dedupe.find_copies(docs, ["text"])
    edges = copies.where("unique_id != rep_id").select(
        F.col("unique_id").alias("src"), F.col("rep_id").alias("dst"))
    return connected_components(edges)


@query
def cluster_at_threshold(spark, folder):
    rows, pairs = scored_people(spark, folder, 0.9)
    return clusters.cluster_pairs(rows, pairs, 0.9)


def clustered_people(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows, pairs = scored_people(spark, folder, 0.9)
    return rows, materialize(clusters.cluster_pairs(rows, pairs, 0.9), "clusters")


@query
def cluster_report(spark, folder):
    rows, found = clustered_people(spark, folder)
    return clusters.cluster_report(rows.select("unique_id", "full_name"), found)


@query
def cluster_numbers(spark, folder):
    found = clustered_people(spark, folder)[1]
    return clusters.number_clusters(found).select("cluster_id", "cluster_rows", "cluster_no")


@query
def number_events(spark, folder):
    """Members of large groups, numbered without one task per group."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    return number_within(events, "event_type", ["event_id"], "nth")


@query
def number_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return dense_number(docs, ["n_chars", "doc_id"], "nth").select("doc_id", "nth")


@query
def labels_by_appearance(spark, folder):
    return clusters.label_by_appearance(clustered_people(spark, folder)[1])


@query
def cluster_representatives(spark, folder):
    return clusters.representatives(clustered_people(spark, folder)[1])


@query
def cluster_texts(spark, folder):
    """Fingerprint columns, fingerprints, and the longest per cluster."""
    rows, found = clustered_people(spark, folder)
    report = rows.join(found, "unique_id")
    columns = merge.fingerprint_columns(report, PEOPLE_ROLES)
    return merge.cluster_texts(report, columns)


@query
def minhash_candidates(spark, folder):
    return merge.similar_edges(table(spark, folder, "documents"), "doc_id", "text")


@query
def merge_similar_documents(spark, folder):
    return merge.merge_similar(table(spark, folder, "documents"), "doc_id", "text")


@query
def verified_documents(spark, folder):
    """Links between documents whose word sets are alike, each checked exactly."""
    return merge.verified_edges(table(spark, folder, "documents"), "doc_id", "text")


@query
def group_labels(spark, folder):
    """Every document as its own cluster; alike ones become one numbered group."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("cluster_id"), F.lit(1).cast("bigint").alias("cluster_rows"),
        F.col("text").alias("rep_text"))
    return merge.group_clusters(docs).select("cluster_id", "root", "group_no")


@query
def group_report(spark, folder):
    """Documents clustered by exact copies, grouped by likeness, sorted."""
    docs = table(spark, folder, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("unique_id"), "text")
    found = dedupe.find_copies(docs, ["text"]).select("unique_id", F.col("rep_id").alias("cluster_id"))
    report = merge.group_report(clusters.with_clusters(docs, found), {})
    return report.select("unique_id", "cluster_id", "partition_group")


# ------------------------------------------------------------------ dedupe


@query
def id_mapping(spark, folder):
    pairs = scored_pairs(spark, folder, 0.9).where("match_probability >= 0.9")
    return dedupe.id_mapping(pairs)


@query
def dedupe_by_mapping(spark, folder):
    rows, pairs = scored_people(spark, folder, 0.9)
    mapping = dedupe.id_mapping(pairs.where("match_probability >= 0.9"))
    return dedupe.dedupe_by_mapping(rows.select("unique_id", "full_name", "phone"), mapping)


@query
def find_copies(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("unique_id"), "lang", "text")
    return dedupe.find_copies(docs, ["lang", "text"])


# ------------------------------------------------------------------ check


def _incoming(spark, folder) -> DataFrame:
    """Altered people as new arrivals: the customers' names and phones, other contacts."""
    return people(spark, folder).select(
        F.concat(F.lit("new_"), "unique_id").alias("unique_id"), "full_name",
        F.lower("email").alias("email"), F.concat(F.lit("0"), "phone").alias("phone"),
        "date_of_birth", "address", "city", "state", "postal_code", "website")


def _new_and_base(spark, folder) -> tuple[DataFrame, DataFrame]:
    base = materialize(
        compare.add_term_frequencies(written_people(spark, folder), FIXED_MODEL.comparisons),
        "people")
    return check.prepare_incoming(_incoming(spark, folder), base, PEOPLE_ROLES), base


@query
def new_record_matches(spark, folder):
    return check.score_links(*_new_and_base(spark, folder), FIXED_MODEL).select(
        "unique_id_l", "unique_id_r", F.round("match_probability", 6).alias("match_probability"))


@query
def best_matches(spark, folder):
    return check.best_matches(*_new_and_base(spark, folder), FIXED_MODEL)


@query
def check_new_records(spark, folder):
    """Verdict, cluster and group of every arriving record, without fuzzy rescoring."""
    rows, found = clustered_people(spark, folder)
    report = found.withColumn("partition_group", F.concat(F.lit("group_of_"), "cluster_id"))
    new = check.prepare_incoming(_incoming(spark, folder), rows, PEOPLE_ROLES)
    judged = check.check_records(
        new, rows, FIXED_MODEL, PEOPLE_ROLES, report, rows.count(), fuzzy=False)
    return judged.withColumn("match_probability", F.round("match_probability", 6)).drop("matched_id")


@query
def fuzzy_rescore(spark, folder):
    rows = materialize(
        compare.add_term_frequencies(written_people(spark, folder), FIXED_MODEL.comparisons),
        "people")
    new = check.prepare_incoming(_incoming(spark, folder), rows, PEOPLE_ROLES)
    columns = check.fuzzy_columns(rows.columns, PEOPLE_ROLES)
    links = check.score_links(new, rows, FIXED_MODEL, fuzzy=columns)
    scored = links.withColumn("fuzzy_score", F.round(check.fuzzy_score(columns, known=True), 6))
    return scored.select(
        "unique_id_l", "unique_id_r", "fuzzy_score",
        F.round(check.boosted(F.col("match_probability"), F.col("fuzzy_score")), 6).alias("adjusted"))


@query
def simple_verdicts(spark, folder):
    """The verdict from the best probability alone, for scored documents' labels."""
    new, base = _new_and_base(spark, folder)
    links = check.score_links(new, base, FIXED_MODEL, least=check.SIMPLE_THRESHOLD)
    best = links.groupBy(F.col("unique_id_r").alias("unique_id")).agg(F.max("match_probability").alias("best"))
    some = check.with_candidates(new, base, FIXED_MODEL).join(best, "unique_id", "left").select(
        "unique_id", F.coalesce("best", F.lit(0.0)).alias("best"))
    return new.select("unique_id").join(some, "unique_id", "left").select(
        "unique_id", check.simple_verdict(F.col("best")).alias("result"))


# ------------------------------------------------------------------ whole run


@query
def resolve_people(spark, folder):
    """Everything from the raw table to the group report."""
    found = resolve(people(spark, folder).drop("entity_id"), key="unique_id")
    return found.report.select("unique_id", "cluster_id", "partition_group")


@query
def resolve_and_check(spark, folder):
    """A run on the people, then verdicts on arriving records with fuzzy rescoring."""
    found = resolve(people(spark, folder).drop("entity_id"), key="unique_id")
    return check_incoming(_incoming(spark, folder), found)
