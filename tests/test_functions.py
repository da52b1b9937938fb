import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import geo
from twinfold.functions import similarity as sim
from twinfold.functions import text as tx
from twinfold.functions.phonetic import double_metaphone, metaphone_codes

random.seed(7)
WORDS = ["".join(random.choice("abcdeü ") for _ in range(random.randint(1, 18))).strip() or "a"
         for _ in range(400)]
PAIRS = list(zip(WORDS, reversed(WORDS)))


@pytest.mark.parametrize("name, codes", [
    ("smith", ("SM0", "XMT")), ("schmidt", ("XMT", "SMT")), ("thompson", ("TMPSN", "TMPSN")),
    ("jose", ("HS", "HS")), ("michael", ("MKL", "MXL")), ("xavier", ("SF", "SFR")),
    ("wright", ("RT", "RT")), ("knight", ("NT", "NT")), ("caesar", ("SSR", "SSR")),
    ("accident", ("AKSTNT", "AKSTNT")), ("judge", ("JJ", "AJ")), ("school", ("SKL", "SKL")),
    ("laugh", ("LF", "LF")), ("gallegos", ("KLKS", "KKS")), ("filipowicz", ("FLPTS", "FLPFX")),
])
def test_metaphone_vectors(name, codes):
    assert metaphone_codes(name) == codes


def test_known_similarities():
    assert round(sim.jaro("martha", "marhta"), 6) == 0.944444
    assert round(sim.jaro_winkler("martha", "marhta"), 6) == 0.961111
    assert sim.jaro("abcd", "axyz") == sim.jaro_winkler("abcd", "axyz") == 0.5
    assert sim.damerau("CA", "ABC") == 2 and sim.damerau("kitten", "sitting") == 3


def test_batch_equals_single():
    left, right = map(list, zip(*PAIRS))
    for bonus, one in ((True, sim.jaro_winkler), (False, sim.jaro)):
        expected = np.array([one(a, b) for a, b in PAIRS])
        assert (sim.winkler_batch(left, right, bonus) == expected).all()


def test_letters_of_any_kind_are_compared_as_in_single_texts():
    random.seed(11)
    texts = ["".join(random.choice("ab\x00\xfe\xff中😀") for _ in range(random.choice([0, 1, 2, 5, 9, 64, 70]))) for _ in range(120)]
    left, right = map(list, zip(*[(a, b) for a in texts for b in texts]))
    for bonus, one in ((True, sim.jaro_winkler), (False, sim.jaro)):
        assert sim.winkler_batch(left, right, bonus).tolist() == [one(a, b) for a, b in zip(left, right)]


def test_shared_letters_leave_out_no_pair_that_reaches_a_threshold():
    at = np.arange(len(PAIRS))
    left, right = map(list, zip(*[*PAIRS[:-3], ("", ""), ("", "a"), ("x" * 70, "x" * 69)]))
    known = np.array([sim.jaro_winkler(a, b) for a, b in zip(left, right)])
    for least in (0.5, 0.7, 0.88):
        told = sim.reaches(left, right, at, at, least)
        assert told[known >= least].all() and not told.all()


def test_character_sets_and_word_counts_of_distinct_pairs(spark):
    texts = [None, "", " ", "a", "ab ba", "Ab  aB ab", "a b c", "a\tb\x0bc a", "x" * 70 + " a", "".join(map(chr, range(200, 400)))]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select("a", "b", sim.jaccard_similarity(a, b).alias("j"), sim.cosine_distance(a, b).alias("c"),
                      sim.lev_damerau_distance(a, b).alias("d"), sim.jaro_similarity(a, b).alias("s")).collect()
    for r in got:
        if r["a"] is None or r["b"] is None:
            assert (r["j"], r["c"], r["d"], r["s"]) == (None,) * 4
            continue
        union = set(r["a"]) | set(r["b"])
        assert r["j"] == (len(set(r["a"]) & set(r["b"])) / len(union) if union else 0.0)
        x, y = Counter(r["a"].lower().split()), Counter(r["b"].lower().split())
        far = 1 - sum(n * y[w] for w, n in x.items()) / math.sqrt(sum(n * n for n in x.values())) \
            / math.sqrt(sum(n * n for n in y.values())) if x and y else 1.0
        assert math.isclose(r["c"], max(far, 0.0), abs_tol=1e-12)
        assert r["d"] == sim.damerau(r["a"], r["b"]) and r["s"] == sim.jaro(r["a"], r["b"])


def test_similarities_of_pairs_are_worked_out_in_one_step_of_python(spark):
    rows = spark.createDataFrame([("a b", "b a")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    plan = lambda *columns: rows.select(*columns)._jdf.queryExecution().optimizedPlan().toString()
    told = plan(sim.jaro_similarity(a, b), sim.lev_damerau_distance(a, b), sim.jaccard_similarity(a, b), sim.cosine_distance(a, b))
    assert told.count("ArrowEvalPython") == 1 and "lambdafunction" not in told


def test_parts_of_a_place_need_no_array_of_them(spark):
    points = [None, "", "1.5", "1.5,2.5", "-3,", "1,1", ",4", "1,2,3"]
    rows = spark.createDataFrame([(p,) for p in points], "p string")
    numbers = [geo.point_part(F.col("p"), part) for part in (0, 1)]
    texts = rows.select(*[F.get(F.split("p", ","), F.lit(part)).try_cast("double") for part in (0, 1)], "p")
    good = texts.where("p LIKE '%_,_%' OR p IS NULL").collect()
    assert [(x, y) for x, y, _ in good] == [tuple(r) for r in rows.where("p LIKE '%_,_%' OR p IS NULL").select(*numbers).collect()]
    assert rows.where("p = '1.5'").select(*numbers).first()[:] == (1.5, None)
    assert "split(" not in rows.select(*numbers)._jdf.queryExecution().analyzed().toString()


def test_similarities_equal_duckdb():
    plain = [(a.replace("ü", "u"), b.replace("ü", "u")) for a, b in PAIRS]
    for a, b in plain:
        jw, ja, dl = duckdb.execute(
            "SELECT jaro_winkler_similarity($1, $2), jaro_similarity($1, $2), "
            "damerau_levenshtein($1, $2)", [a, b]).fetchone()
        assert math.isclose(jw, sim.jaro_winkler(a, b)) and math.isclose(ja, sim.jaro(a, b))
        assert dl == sim.damerau(a, b)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_and_token_set():
    for a, b in PAIRS:
        assert sim.common_subsequence(a, b) == lcs(a, b)
    assert sim.token_set_ratio_text("new york mets", "mets new york city") == 100
    assert sim.token_set_ratio_text("", "a") == 0
    a, b = "fuzzy was a bear", "wuzzy was a cat"
    shared, left, right = "a was", "a was bear fuzzy", "a was cat wuzzy"
    ratio = lambda x, y: 2 * lcs(x, y) / (len(x) + len(y))
    best = max(ratio(shared, left), ratio(shared, right), ratio(left, right))
    assert math.isclose(sim.token_set_ratio_text(a, b), 100 * best)


def test_functions_in_spark(spark):
    rows = spark.createDataFrame(
        [("night", "nacht"), ("", ""), (None, "a"), ("x" * 100, "x" * 99 + "y")], "a string, b string")
    got = rows.select(
        sim.jaccard_similarity(F.col("a"), F.col("b")).alias("j"),
        sim.jaro_winkler_similarity("a", "b").alias("w"), sim.lev_damerau_distance("a", "b").alias("d"),
        sim.qgrams(F.col("a"), 3).alias("q"),
        sim.cosine_distance(F.col("a"), F.col("b")).alias("c")).collect()
    assert round(got[0]["j"], 6) == 0.428571 and got[0]["q"] == ["nig", "igh", "ght"]
    assert got[1]["q"] == [] and got[1]["c"] == 1.0 and got[1]["w"] == 1.0
    assert got[2]["j"] is None and got[2]["w"] is None and got[2]["d"] is None
    assert got[3]["d"] == 1 and math.isclose(got[3]["w"], sim.jaro_winkler("x" * 100, "x" * 99 + "y"))


def test_text_columns(spark):
    shapes = ["2003-09-06", "06/09/2003", "2003.09.06", "2003/09/06", "06-09-2003", "06-9-2003",
              "6-9-2003", "6 Sept 2003", "6 Sep 2003", "6th Sep 2003", "nonsense", None]
    dates = spark.createDataFrame([(s,) for s in shapes], "d string").select(
        tx.date_norm(F.col("d")).alias("d")).collect()
    assert [r["d"] for r in dates] == ["2003-09-06"] * 10 + [None, None]
    names = spark.createDataFrame(
        [("Madonna",), ("José  Groß",), (" ",), (None,)], "n string")
    first, rest = tx.split_at_first_blank(F.col("n"))
    got = names.select(first.alias("f"), rest.alias("r"), tx.fold_lower(F.col("n")).alias("x"),
                       double_metaphone(tx.fold_lower(F.col("n"))).alias("m"),
                       tx.phone_digits(F.lit("n/a")).alias("p")).collect()
    assert [tuple(r)[:3] for r in got] == [
        ("Madonna", None, "madonna"), ("José", "Groß", "jose  gross"), (None, None, None),
        (None, None, None)]
    assert got[0]["m"] == "MTN" and got[3]["m"] is None and got[0]["p"] is None
