"""The same queries as DuckDB SQL over the given tables."""

from __future__ import annotations

from twinfold.operators import merge
from twinfold.operators.compare import EMAIL_LEVEL, NAME_LEVELS

from .catalog import FIXED_MODEL
from .people import PEOPLE_SQL, PLACES

ORACLE: dict[str, str] = {}

PEOPLE = f"WITH people AS ({PEOPLE_SQL})"


def _fold(text: str) -> str:
    out = f"strip_accents({text})"
    for letter, plain in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("Ø", "O"), ("ł", "l"),
                          ("đ", "d"), ("ð", "d"), ("þ", "th"), ("Æ", "AE"), ("Œ", "OE"),
                          ("Þ", "TH"), ("Đ", "D"), ("Ð", "D"), ("Ł", "L"), ("ı", "i")):
        out = f"replace({out}, '{letter}', '{plain}')"
    return out


def _fold_lower(text: str) -> str:
    return f"nullif(lower(trim({_fold(text)})), '')"


DATES = "['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%d/%m/%Y']"
FIRST = "nullif(split_part(trim(full_name), ' ', 1), '')"
REST = "nullif(trim(substr(trim(full_name), length(split_part(trim(full_name), ' ', 1)) + 2)), '')"
ENHANCED = f"""{PEOPLE}, enhanced AS (
  SELECT *, {_fold_lower(FIRST)} AS first_name_norm, {_fold_lower(REST)} AS last_name_norm,
    substr({FIRST}, 1, 1) AS first_name_first_char,
    nullif(lower(trim(email)), '') AS email_norm,
    nullif(regexp_replace(phone, '[^0-9]', '', 'g'), '') AS phone_digits,
    nullif(upper(regexp_replace(postal_code, '\\s', '', 'g')), '') AS zip_norm,
    {_fold_lower('city')} AS city_norm, {_fold_lower('state')} AS state_norm,
    {_fold_lower('address')} AS address_norm,
    strftime(try_strptime(date_of_birth, {DATES}), '%Y-%m-%d') AS date_norm,
    nullif(lower(regexp_extract(website, 'https?://(?:www\\.)?([^/]+)', 1)), '') AS url_domain
  FROM people)"""

RULE_KEYS = [("email_norm",), ("phone_digits",), ("zip_norm", "date_norm"),
             ("last_name_norm", "city_norm")]


def _equal(keys: tuple, left: str = "l", right: str = "r") -> str:
    return " AND ".join(f"{left}.{k} = {right}.{k}" for k in keys)


def _pairs(keep: str = "min(rule_no)", group: bool = True) -> str:
    parts = " UNION ALL ".join(
        f"SELECT l.unique_id AS unique_id_l, r.unique_id AS unique_id_r, {no} AS rule_no "
        f"FROM enhanced l JOIN enhanced r ON {_equal(keys)} AND l.unique_id < r.unique_id"
        for no, keys in enumerate(RULE_KEYS))
    if not group:
        return f"pairs AS ({parts})"
    return ("pairs AS (SELECT unique_id_l, unique_id_r, CAST(min(rule_no) AS INT) AS rule_no "
            f"FROM ({parts}) GROUP BY ALL)").replace("GROUP BY ALL", "GROUP BY 1, 2")


PAIRS = f"{ENHANCED}, {_pairs()}"
BOTH = ("FROM pairs JOIN enhanced l ON l.unique_id = unique_id_l "
        "JOIN enhanced r ON r.unique_id = unique_id_r")


def _level(column: str, tests: list[str], left: str = "l", right: str = "r") -> str:
    a, b = f"{left}.{column}", f"{right}.{column}"
    top = len(tests) + 1
    whens = " ".join(f"WHEN {t.format(a=a, b=b)} THEN {top - i}" for i, t in enumerate(tests, 1))
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN -1 WHEN {a} = {b} THEN {top} {whens} ELSE 0 END"


def _winkler(*limits: float) -> list[str]:
    return [f"jaro_winkler_similarity({{a}}, {{b}}) >= {x}" for x in limits]


_USER = "split_part({{{0}}}, '@', 1)"
EMAIL_TESTS = [
    f"{_USER.format('a')} = {_USER.format('b')}", *_winkler(EMAIL_LEVEL),
    f"jaro_winkler_similarity({_USER.format('a')}, {_USER.format('b')}) >= {EMAIL_LEVEL}"]
DATE_TESTS = ["damerau_levenshtein({a}, {b}) <= 1",
              *[f"abs(date_diff('day', CAST({{a}} AS DATE), CAST({{b}} AS DATE))) <= {d}"
                for d in (30, 365, 3652)]]
LEVELS = {
    "compare_exact": ("state_norm", []),
    "compare_jaro_winkler": ("address_norm", _winkler(0.9, 0.7)),
    "compare_names": ("last_name_norm", _winkler(*NAME_LEVELS)),
    "compare_levenshtein": ("phone_digits", ["levenshtein({a}, {b}) <= 2", "levenshtein({a}, {b}) <= 4"]),
    "compare_email": ("email_norm", EMAIL_TESTS),
    "compare_postcode": ("zip_norm", ["left({a}, 4) = left({b}, 4)", "left({a}, 2) = left({b}, 2)"]),
    "compare_birth_date": ("date_norm", DATE_TESTS),
}
for _name, (_column, _tests) in LEVELS.items():
    ORACLE[_name] = f"{PAIRS} SELECT unique_id_l, unique_id_r, {_level(_column, _tests)} AS level {BOTH}"

MODEL_LEVELS = {
    "last_name_norm": _winkler(0.9, 0.7), "email_norm": EMAIL_TESTS,
    "phone_digits": LEVELS["compare_levenshtein"][1], "city_norm": [], "date_norm": DATE_TESTS,
}
GAMMAS = ", ".join(f"{_level(c, t)} AS gamma_{c}" for c, t in MODEL_LEVELS.items())


def _weight(tf: str) -> str:
    terms = [f"log2({FIXED_MODEL.prior!r} / (1 - {FIXED_MODEL.prior!r}))"]
    for c in FIXED_MODEL.comparisons:
        levels = zip(FIXED_MODEL.m[c.column], FIXED_MODEL.u[c.column])
        whens = " ".join(f"WHEN {i} THEN log2({m!r} / {u!r})" for i, (m, u) in enumerate(levels))
        terms.append(f"CASE gamma_{c.column} WHEN -1 THEN 0 {whens} END")
        if c.term_frequency:
            u = FIXED_MODEL.u[c.column][-1]
            terms.append(f"CASE WHEN gamma_{c.column} = {c.top} THEN log2({u!r} / {tf}) ELSE 0 END")
    return " + ".join(f"CAST({t} AS DOUBLE)" for t in terms)


TF = ("tf AS (SELECT city_norm, count(*) / (SELECT count(city_norm) FROM enhanced) AS tf "
      "FROM enhanced WHERE city_norm IS NOT NULL GROUP BY 1)")
SCORED = f"""{PAIRS}, {TF}, levels AS (
  SELECT unique_id_l, unique_id_r, {GAMMAS}, tf.tf {BOTH} LEFT JOIN tf ON tf.city_norm = l.city_norm
), weighed AS (SELECT *, {_weight('tf')} AS match_weight FROM levels
), scored AS (SELECT *, 1 / (1 + pow(2.0, -match_weight)) AS match_probability FROM weighed)"""


def _components(nodes: str, edges: str) -> str:
    """CTEs: comp(id, component) for edges(src, dst) given as a query."""
    return f"""edges AS ({edges}), both_ways AS (
      SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    reach AS (SELECT id, id AS root FROM ({nodes}) UNION
      SELECT reach.id, dst FROM reach JOIN both_ways ON src = root),
    comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


CLUSTERED = _recursive(f"""{SCORED}, {_components(
    "SELECT unique_id AS id FROM enhanced",
    "SELECT unique_id_l AS src, unique_id_r AS dst FROM scored WHERE match_probability >= 0.9")},
  clusters AS (SELECT id AS unique_id, component AS cluster_id FROM comp)""")

# ------------------------------------------------------------------ sources

ORACLE["url_domain_report"] = r"""
WITH d AS (SELECT nullif(lower(regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1)), '') AS domain
           FROM pages)
SELECT domain, count(*) AS domain_rows,
       CASE WHEN domain IS NULL THEN 0 ELSE count(*) * (count(*) - 1) // 2 END AS domain_pairs
FROM d GROUP BY domain"""
ORACLE["csv_round_trip"] = """SELECT CAST(p_partkey AS INT) AS p_partkey, p_name, p_brand, p_type,
  CAST(p_size AS INT) AS p_size, p_retailprice FROM part"""
ORACLE["parquet_round_trip"] = "SELECT * FROM supplier"
ORACLE["table_columns"] = """SELECT * FROM (VALUES ('c_custkey', 'int'), ('c_name', 'string'),
  ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string'))
  AS t(column_name, data_type)"""
ORACLE["unique_ids"] = "SELECT CAST(c_custkey AS VARCHAR) AS unique_id, c_name FROM customer"

# ------------------------------------------------------------------ profile

PEOPLE_COLUMNS = ["unique_id", "entity_id", "full_name", "email", "phone", "date_of_birth", "address",
                  "city", "state", "postal_code", "website"]
LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                    "l_shipdate"]


def _profile(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(f"""
      SELECT '{c}' AS column_name, count(*) AS total_rows, count({c}) AS non_null_rows,
        count(DISTINCT {c}) AS distinct_values, count({c}) / count(*) AS non_null_share,
        (count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INT)) / count(*) AS cardinality_ratio,
        count(DISTINCT {c}) / count(*) AS cardinality_ratio_nonnull
      FROM {table}""" for c in columns)


ORACLE["profile_nonnull_cardinality"] = f"{PEOPLE} {_profile(PEOPLE_COLUMNS, 'people')}"
ORACLE["profile_lineitem"] = _profile(LINEITEM_COLUMNS, "lineitem")

ORACLE["sketched_lineitem"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_rows, count({c}) AS non_null_rows, "
    f"count(DISTINCT {c}) AS distinct_values, TRUE AS within_error FROM lineitem" for c in LINEITEM_COLUMNS)
_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS value_count "
    f"FROM orders GROUP BY 1, 2" for c in ("o_orderpriority", "o_orderstatus", "o_custkey"))
ORACLE["profile_value_distribution"] = f"""
WITH counts AS ({_COUNTS}), totals AS (
  SELECT column_name, CAST(sum(value_count) AS BIGINT) AS total, count(*) AS distinct_values
  FROM counts GROUP BY 1),
placed AS (
  SELECT 'top' AS list, *, row_number() OVER (PARTITION BY column_name ORDER BY value_count DESC, value) AS place
  FROM counts UNION ALL
  SELECT 'bottom', *, row_number() OVER (PARTITION BY column_name ORDER BY value_count, value) FROM counts)
SELECT column_name, list, CAST(place AS INT) AS place, value, value_count, distinct_values,
  value_count / total AS share,
  sum(value_count) OVER (PARTITION BY column_name, list ORDER BY place) / total AS cumulative_share
FROM placed JOIN totals USING (column_name) WHERE place <= 10"""
ORACLE["profile_count_percentiles"] = """
WITH counts AS (SELECT 'user_id' AS column_name, count(*) AS n FROM events GROUP BY user_id
  UNION ALL SELECT 'event_type', count(*) FROM events GROUP BY event_type)
SELECT column_name, p AS percentile, q AS value_count FROM (
  SELECT column_name, unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) AS p,
    unnest(quantile_disc(n, [0.25, 0.5, 0.75, 1.0])) AS q FROM counts GROUP BY column_name)"""
ORACLE["drop_incomplete_rows"] = f"""{PEOPLE} SELECT unique_id, email, phone FROM people
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in PEOPLE_COLUMNS)}"""


def _share(key: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) / pow(16.0, 13)"


ORACLE["sample_by_hash"] = f"""
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey, o_custkey FROM orders, n WHERE n <= 5000 OR {_share('o_orderkey')} < 5000 / n"""
ORACLE["threshold_filter"] = f"""{SCORED} SELECT unique_id_l AS src, unique_id_r AS dst FROM scored
  WHERE match_probability >= 0.9"""

# ------------------------------------------------------------------ roles


def _golden(rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {values}) AS t(role, column_name, source_pass)"


_NAMED = [("full_name", "full_name", "alias"), ("email", "email", "alias"),
          ("phone", "phone", "alias"), ("zip", "postal_code", "alias"), ("city", "city", "alias"),
          ("state", "state", "alias"), ("address", "address", "alias")]
ORACLE["infer_roles_wide"] = _golden(
    [*_NAMED, ("url", "website", "alias"), ("date", "date_of_birth", "name_pattern")])
ORACLE["infer_roles_loose"] = _golden(
    [*_NAMED, ("url", "website", "alias"), ("date", "date_of_birth", "name_pattern"),
     ("name", "full_name", "name_pattern"), ("geo", "city", "name_pattern")])
# the share of ISO dates is one half or less here, so the date role stays open
ORACLE["infer_roles_basic"] = f"""{PEOPLE}, iso AS (
  SELECT avg(CAST(regexp_matches(date_of_birth, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AS INT)) AS share FROM people)
SELECT * FROM ({_golden(_NAMED)}) UNION ALL
SELECT 'date', 'date_of_birth', 'value_pattern' FROM iso WHERE share >= 0.5"""

def _first_column(table: str, columns: list[str], test: str) -> str:
    whens = " ".join(
        f"WHEN count(DISTINCT {c}) / count(*) {test} THEN '{c}'" for c in columns)
    return f"(SELECT CASE {whens} END FROM {table})"


_TYPED = [("numeric_id", "o_orderkey", "name_pattern", "orders"),
          ("date", "o_orderdate", "name_pattern", "orders"),
          ("numeric_id", "p_partkey", "name_pattern", "part"),
          ("name", "p_name", "name_pattern", "part"),
          ("numeric_id", "user_id", "alias", "events"),
          ("date", "ts", "type", "events"),
          ("numeric_id", "doc_id", "name_pattern", "documents")]
_TEXTS = {"orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_brand", "p_type"],
          "events": ["event_type", "props"], "documents": ["text", "lang", "source"]}
ORACLE["infer_roles_by_type"] = " UNION ALL ".join(
    [f"SELECT '{r}' AS role, '{c}' AS column_name, '{p}' AS source_pass, '{t}' AS table_name"
     for r, c, p, t in _TYPED]
    + [f"SELECT * FROM (SELECT '{role}', {_first_column(t, cs, test)} AS c, 'distribution', '{t}') "
       "WHERE c IS NOT NULL"
       for t, cs in _TEXTS.items() for role, test in (("category_enum", "< 0.1"), ("text_freeform", "> 0.5"))])


# ------------------------------------------------------------------ derive

ORACLE["normalize_contact"] = f"""{ENHANCED} SELECT unique_id, first_name_norm, last_name_norm,
  first_name_first_char, email_norm, phone_digits, zip_norm, city_norm, state_norm, address_norm,
  date_norm, url_domain FROM enhanced"""
ORACLE["normalize_text"] = r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(lang), '\s+', ' ', 'g')) AS lang_norm,
  trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, lang_norm, md5(t) AS text_norm_md5, CAST(length(t) AS INT) AS text_norm_length FROM n"""
ORACLE["fold_accents"] = f"SELECT doc_id, md5({_fold('text')}) AS folded_md5 FROM documents"


def _sha_mod() -> str:
    rest = "CAST(0 AS BIGINT)"
    for start in range(1, 65, 8):
        chunk = f"CAST('0x' || substr(h, {start}, 8) AS BIGINT)"
        rest = f"(({rest} * 4294967296 + {chunk}) % 1000000000)"
    return rest


ORACLE["hash_ids"] = f"""
WITH h AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)
SELECT o_orderkey, h AS id_hash, {_sha_mod()} AS id_hash_mod,
  ((o_orderkey - 500) % 1000 + 1000) % 1000 AS id_mod_1000 FROM h"""
ORACLE["hash_texts"] = "SELECT conv_id, turn, sha256(text) AS text_hash FROM conversations"
ORACLE["parse_mixed_dates"] = f"""{PEOPLE} SELECT unique_id,
  strftime(try_strptime(date_of_birth, {DATES}), '%Y-%m-%d') AS any_format,
  strftime(try_strptime(date_of_birth, '%Y-%m-%d'), '%Y-%m-%d') AS iso_only FROM people"""
ORACLE["split_names"] = f"""{PEOPLE}, t AS (
  SELECT *, regexp_split_to_array(trim(full_name), '\\s+') AS w FROM people)
SELECT unique_id, {FIRST} AS first_word, {REST} AS rest, w[1] AS first_name,
  CASE WHEN len(w) > 1 THEN w[-1] ELSE '' END AS last_name, full_name,
  CASE WHEN len(w) > 1 THEN w[-1] ELSE '' END AS surname FROM t"""
ORACLE["coerce_incoming"] = """SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS o_seconds, o_orderstatus = 'O' AS o_open FROM orders"""

# ------------------------------------------------------------------ blocking


def _costs(rules: list[tuple], table: str) -> str:
    return " UNION ALL ".join(f"""
      SELECT '{name}' AS rule_name, CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS comparisons,
        max(n) AS largest_block, count(*) AS blocks FROM (
        SELECT count(*) AS n FROM {table} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)}
        GROUP BY {', '.join(keys)})""" for name, keys in rules)


ORACLE["block_pair_counts"] = f"{ENHANCED} " + _costs([
    ("exact_email", ["email_norm"]), ("exact_phone", ["phone_digits"]), ("exact_zip", ["zip_norm"]),
    ("exact_date", ["date_norm"]), ("exact_first_last_name", ["first_name_norm", "last_name_norm"]),
    ("city_firstname", ["city_norm", "first_name_norm"]),
    ("first_name_first_char", ["first_name_first_char"]), ("url_domain_exact", ["url_domain"]),
], "enhanced")
ORACLE["block_sizes_skewed"] = _costs([("user", ["user_id"]), ("type", ["event_type"])], "events")
_NAMED_RULES = [("email", ["email_norm"]), ("phone", ["phone_digits"]),
                ("zip_date", ["zip_norm", "date_norm"]), ("name_city", ["last_name_norm", "city_norm"]),
                ("state", ["state_norm"])]
_COLUMNS = " ".join(f"WHEN '{n}' THEN '{','.join(sorted(k))}'" for n, k in _NAMED_RULES)
_ORDER = " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(_NAMED_RULES))
ORACLE["select_blocking_rules"] = f"""{ENHANCED}, costs AS ({_costs(_NAMED_RULES, 'enhanced')}),
noted AS (SELECT rule_name AS name, comparisons, comparisons BETWEEN 1 AND 100000 AS kept,
  CASE WHEN comparisons = 0 THEN 'zero_comparisons' WHEN comparisons > 100000
       THEN 'too_many_comparisons' ELSE 'selected' END AS reason FROM costs)
SELECT *, CASE name {_COLUMNS} END AS columns, kept AND row_number() OVER (
  PARTITION BY kept ORDER BY comparisons, CASE name {_ORDER} END) <= 3 AS chosen FROM noted"""
ORACLE["candidate_pairs"] = f"{PAIRS} SELECT unique_id_l, unique_id_r, rule_no FROM pairs"
ORACLE["candidate_pairs_in_pieces"] = ORACLE["candidate_pairs"]
ORACLE["matched_pair_count"] = f"{PAIRS} SELECT count(*) AS pairs FROM pairs"

_WEAK = ["email_norm", "zip_norm", "first_name_first_char", "city_norm", "state_norm"]
_LARGE = 100
_SIZES = ", ".join(f"count(*) OVER (PARTITION BY {c}) AS n{i}" for i, c in enumerate(_WEAK))
_OPEN = ", ".join(f"{c} IS NOT NULL AND n{i} > {_LARGE} AS o{i}" for i, c in enumerate(_WEAK))


def _crossed(*own: int) -> str:
    """Blocks of records that stand in large blocks under the rules ``own`` without the last, and
    under it; kept where they are small."""
    key = " || '|' || ".join(_WEAK[i] for i in own)
    open_ = f"o{own[0]} IS NOT NULL AND {_WEAK[own[0]]} IS NOT NULL" if len(own) == 1 else " AND ".join(f"o{i}" for i in own)
    return (f"SELECT unique_id, '{own}' || {key} AS block, count(*) OVER (PARTITION BY {key}) AS n, "
            f"{len(own)} AS level FROM opened WHERE {open_}")


_TWO = [(i, j) for i in range(5) for j in range(i + 1, 5)]
_SORT = "concat_ws(' ', " + ", ".join(_WEAK) + ")"
_SWEPT = " UNION ALL ".join(
    f"SELECT unique_id, {i} AS rule, row_number() OVER (PARTITION BY {c} ORDER BY {_SORT}, unique_id) AS place, {c} AS k "
    f"FROM opened WHERE o{i}" for i, c in enumerate(_WEAK))
# a third level is reached where all three crossings of two are large
_THREE = " UNION ALL ".join(
    f"SELECT unique_id, '{(i, j, k)}' || {_WEAK[i]} || '|' || {_WEAK[j]} || '|' || {_WEAK[k]} AS block, "
    f"count(*) OVER (PARTITION BY {_WEAK[i]}, {_WEAK[j]}, {_WEAK[k]}) AS n, 3 AS level FROM opened o "
    f"WHERE (SELECT count(*) FROM second s WHERE s.unique_id = o.unique_id AND s.n > {_LARGE} AND "
    f"(s.block LIKE '({i}, {j})%' OR s.block LIKE '({i}, {k})%' OR s.block LIKE '({j}, {k})%')) = 3"
    for i in range(5) for j in range(i + 1, 5) for k in range(j + 1, 5))
ORACLE["refined_candidate_pairs"] = f"""{ENHANCED}, sized AS (SELECT *, {_SIZES} FROM enhanced),
opened AS (SELECT *, {_OPEN} FROM sized),
first_level AS ({" UNION ALL ".join(_crossed(i) for i in range(5))}),
second AS ({" UNION ALL ".join(_crossed(*own) for own in _TWO)}),
third AS ({_THREE}),
kept AS (SELECT unique_id, block FROM (SELECT * FROM first_level UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third)
  WHERE n <= {_LARGE}),
swept AS ({_SWEPT}),
met AS (SELECT l.unique_id AS a, r.unique_id AS b FROM kept l JOIN kept r ON l.block = r.block AND l.unique_id < r.unique_id
  UNION SELECT least(l.unique_id, r.unique_id), greatest(l.unique_id, r.unique_id) FROM swept l JOIN swept r
  ON l.rule = r.rule AND l.k = r.k AND r.place BETWEEN l.place + 1 AND l.place + 5)
SELECT a AS unique_id_l, b AS unique_id_r FROM met"""

# ------------------------------------------------------------------ functions

_WORDS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"
_A, _B = _WORDS.format("l.address_norm"), _WORDS.format("r.address_norm")
ORACLE["string_similarities"] = f"""{PAIRS}, v AS (
  SELECT unique_id_l, unique_id_r, l.last_name_norm AS la, r.last_name_norm AS lb,
    l.city_norm AS ca, r.city_norm AS cb, l.address_norm AS aa, r.address_norm AS ab,
    {_A} AS wa, {_B} AS wb {BOTH}),
counted AS (SELECT unique_id_l, unique_id_r, sum(na * nb) AS dot, sqrt(sum(na * na)) AS sa,
    sqrt(sum(nb * nb)) AS sb FROM (
    SELECT unique_id_l, unique_id_r, len(list_filter(wa, lambda x: x = w)) AS na,
      len(list_filter(wb, lambda x: x = w)) AS nb
    FROM (SELECT *, unnest(list_distinct(list_concat(wa, wb))) AS w FROM v)) GROUP BY 1, 2)
SELECT unique_id_l, unique_id_r, round(jaro_similarity(la, lb), 6) AS jaro,
  round(jaro_winkler_similarity(ca, cb), 6) AS jaro_winkler,
  CAST(damerau_levenshtein(aa, ab) AS INT) AS damerau, round(jaccard(aa, ab), 6) AS jaccard,
  round(greatest(0.0, 1 - dot / (sa * sb)), 6) AS cosine
FROM v JOIN counted USING (unique_id_l, unique_id_r)"""
ORACLE["text_similarities"] = r"""
WITH w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM conversations),
c AS (SELECT conv_id, turn, w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2, 3),
norm AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS s FROM c GROUP BY 1, 2),
dot AS (SELECT a.conv_id, a.turn, sum(a.n * b.n) AS d FROM c a JOIN c b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.w = b.w GROUP BY 1, 2)
SELECT a.conv_id, a.turn, round(CASE WHEN na.s IS NULL OR nb.s IS NULL THEN 1.0
  ELSE greatest(0.0, 1 - coalesce(d, 0) / (na.s * nb.s)) END, 6) AS cosine
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
LEFT JOIN norm na ON na.conv_id = a.conv_id AND na.turn = a.turn
LEFT JOIN norm nb ON nb.conv_id = b.conv_id AND nb.turn = b.turn
LEFT JOIN dot ON dot.conv_id = a.conv_id AND dot.turn = a.turn"""
ORACLE["qgrams"] = """
WITH names AS (SELECT DISTINCT p_name FROM part), q AS (SELECT unnest([2, 3, 4, 5, 6]) AS q),
g AS (SELECT p_name, q, unnest(range(0, greatest(length(p_name) - q + 1, 0))) AS place FROM names, q)
SELECT p_name, CAST(q AS INT) AS q, CAST(place AS INT) AS place, substr(p_name, place + 1, q) AS gram FROM g"""
ORACLE["array_pairs"] = """
WITH l AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word_l,
  string_split(p_type || ' ' || p_brand, ' ') AS r FROM part)
SELECT p_partkey, word_l, unnest(r) AS word_r FROM l"""
ORACLE["coordinate_pairs"] = """
SELECT p_partkey, CAST(s * p_size AS DOUBLE) AS lat_l, p_retailprice AS lon_l,
  CAST(p_size + 1 AS DOUBLE) AS lat_r, p_retailprice AS lon_r
FROM part, (VALUES (1), (-1)) AS t(s)"""

_NEAR_KM, _EARTH_KM, _DEGREE_KM = 5.0, 6371.0088, 111.195
_PLACED = f"""places(n, lat, lon) AS (VALUES {", ".join(f"({n}, CAST({a} AS DOUBLE), CAST({o} AS DOUBLE))" for n, a, o in PLACES)}),
placed AS (SELECT CAST(c_custkey AS VARCHAR) AS unique_id, lat + (c_custkey * 37 % 1000 - 500) / 1000.0::DOUBLE AS lat,
  lon + (c_custkey * 91 % 1000 - 500) / 1000.0::DOUBLE AS lon FROM customer JOIN places ON n = c_nationkey)"""
_KM = (f"2 * {_EARTH_KM} * asin(least(1.0, sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * "
       f"cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2))))")
ORACLE["near_places"] = f"""WITH {_PLACED}, pairs AS (
  SELECT l.unique_id AS unique_id_l, r.unique_id AS unique_id_r, {_KM} AS km
  FROM placed l JOIN placed r ON l.unique_id < r.unique_id AND abs(l.lat - r.lat) < 1)
SELECT unique_id_l, unique_id_r, round(km, 6) AS km FROM pairs WHERE km <= {_NEAR_KM}"""
_HIGH = repr(2 * _NEAR_KM / _DEGREE_KM)
ORACLE["compare_distance"] = f"""WITH {_PLACED}, rows AS (SELECT *, floor(lat / {_HIGH}) AS row FROM placed),
counted AS (SELECT *, floor(360 / 1.05 * cos(radians(greatest(abs(row * {_HIGH}), abs((row + 1) * {_HIGH})))) / {_HIGH}) AS n FROM rows),
celled AS (SELECT *, floor((lon + 180.0) / 360.0 * n) AS col FROM counted),
pairs AS (SELECT l.unique_id AS unique_id_l, r.unique_id AS unique_id_r, {_KM} AS km, l.lat = r.lat AND l.lon = r.lon AS same
  FROM celled l JOIN celled r ON l.unique_id < r.unique_id AND l.row = r.row AND l.col = r.col)
SELECT unique_id_l, unique_id_r, CASE WHEN same THEN 4 WHEN km <= 2 THEN 3 WHEN km <= 5 THEN 2 ELSE 1 END AS level
FROM pairs WHERE km <= 10"""

# ------------------------------------------------------------------ model

ORACLE["estimate_prior"] = f"""{PAIRS}, n AS (SELECT count(*) AS n FROM enhanced)
SELECT round((SELECT count(*) FROM pairs) / 0.95 / (n * (n - 1) / 2), 12) AS prior FROM n"""
_SOURCES = ["email_norm", "phone_digits", "zip_norm", "date_norm", "url_domain"]
_SETS = [(i,) for i in range(5)] + _TWO + [(i, j, k) for i, j in _TWO for k in range(j + 1, 5)]
_AGREE = " UNION ALL ".join(
    f"SELECT '{own}' AS own, coalesce(sum(n * (n - 1) / 2), 0) AS pairs FROM (SELECT count(*) AS n FROM enhanced WHERE "
    + " AND ".join(f"{_SOURCES[i]} IS NOT NULL" for i in own)
    + " GROUP BY " + ", ".join(_SOURCES[i] for i in own) + ")" for own in _SETS)


def _beyond(*own: int) -> str:
    """Pairs that agree on all of these, less what chance gives."""
    alone = " * ".join(f"(SELECT pairs FROM agree WHERE own = '{(i,)}') / possible" for i in own)
    return f"greatest((SELECT pairs FROM agree WHERE own = '{own}') - possible * {alone}, 0)"


_ESTIMATES = " UNION ALL ".join(
    f"SELECT {_beyond(i, j)} * {_beyond(i, k)} * {_beyond(j, k)} / pow({_beyond(i, j, k)}, 2) AS matches FROM n "
    f"WHERE {_beyond(i, j, k)} > 0" for i, j in _TWO for k in range(j + 1, 5))
ORACLE["recaptured_prior"] = f"""{ENHANCED}, n AS (SELECT count(*) * (count(*) - 1) / 2 AS possible FROM enhanced),
agree AS ({_AGREE}), estimates AS ({_ESTIMATES})
SELECT round(CAST((SELECT median(matches) FROM estimates WHERE matches > 0) / possible AS DOUBLE), 12) AS prior FROM n"""
_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS comparison, {c} AS v, count(*) AS n FROM enhanced WHERE {c} IS NOT NULL GROUP BY {c}" for c in MODEL_LEVELS)
ORACLE["equality_u"] = f"""{ENHANCED}, v AS ({_VALUES})
SELECT comparison, CAST(sum(n) AS BIGINT) AS filled, CAST(sum(n * (n - 1)) / 2 AS BIGINT) AS equal_pairs,
  round(CAST(sum(n * (n - 1)) / (CAST(sum(n) AS DOUBLE) * (sum(n) - 1)) AS DOUBLE), 12) AS u FROM v GROUP BY comparison"""
_START = 0.95


def _start_odds(no: int) -> str:
    """Share of matches among the pairs of a rule at the start."""
    odds = f"{FIXED_MODEL.prior!r} / (1 - {FIXED_MODEL.prior!r})"
    for c in MODEL_LEVELS:
        if c in RULE_KEYS[no]:
            odds += f" * {_START} / {FIXED_MODEL.u[c][-1]!r}"
    return f"least(greatest(({odds}) / (1 + ({odds})), 1e-6), 0.999)"


def _step_odds(no: int) -> str:
    share = _start_odds(no)
    terms = [f"ln({share} / (1 - {share}))"]
    for c, tests in MODEL_LEVELS.items():
        top = len(tests) + 1
        if c not in RULE_KEYS[no]:
            whens = " ".join(f"WHEN {i} THEN ln({_START if i == top else (1 - _START) / top!r} / {u!r})"
                             for i, u in enumerate(FIXED_MODEL.u[c]))
            terms.append(f"CASE gamma_{c} WHEN -1 THEN 0 {whens} END")
    return " + ".join(f"CAST({t} AS DOUBLE)" for t in terms)


_STEP = " ".join(f"WHEN {no} THEN {_step_odds(no)}" for no in range(len(RULE_KEYS)))
_STEP_LEVELS = " UNION ALL ".join(
    f"SELECT rule_no, '{c}' AS comparison, {i} AS level, sum(CASE WHEN gamma_{c} = {i} THEN p ELSE 0 END) "
    f"/ sum(CASE WHEN gamma_{c} >= 0 THEN p ELSE 0 END) AS m, least(greatest(sum(p) / count(*), 1e-6), 1 - 1e-6) AS share FROM step "
    f"WHERE rule_no NOT IN ({', '.join(str(no) for no, keys in enumerate(RULE_KEYS) if c in keys) or -1}) GROUP BY rule_no"
    for c, tests in MODEL_LEVELS.items() for i in range(len(tests) + 2))
ORACLE["em_round"] = f"""{ENHANCED}, {_pairs(group=False)}, levels AS (SELECT rule_no, {GAMMAS} {BOTH}),
step AS (SELECT *, 1 / (1 + exp(-(CASE rule_no {_STEP} END))) AS p FROM levels)
SELECT CAST(rule_no AS INT) AS rule_no, comparison, level, round(m, 9) AS m, round(share, 9) AS share FROM ({_STEP_LEVELS})"""
_LEVEL_ROWS = ", ".join(
    f"('{c}', {i})" for c, t in MODEL_LEVELS.items() for i in range(len(t) + 2))
_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{c}' AS comparison, gamma_{c} AS level FROM levels" for c in MODEL_LEVELS)
ORACLE["estimate_u"] = f"""{ENHANCED}, ring AS (
  SELECT *, row_number() OVER (ORDER BY substr(md5(unique_id), 1, 13), unique_id) AS place,
    count(*) OVER () AS n FROM enhanced),
steps AS (SELECT unique_id AS a, place, n, unnest(range(1, CASE WHEN n * (n - 1) // 2 <= 2000000
  THEN n - place + 1 ELSE greatest(2000000 // n, 1) + 1 END)) AS step FROM ring),
met AS (SELECT a, ring.unique_id AS b FROM steps JOIN ring ON ring.place = (steps.place - 1 + step) % steps.n + 1),
levels AS (SELECT {GAMMAS} FROM met JOIN enhanced l ON l.unique_id = a JOIN enhanced r ON r.unique_id = b),
counts AS (SELECT comparison, level, count(*) AS pairs FROM ({_UNPIVOT}) WHERE level >= 0 GROUP BY 1, 2),
totals AS (SELECT comparison, sum(pairs) AS total FROM counts GROUP BY 1)
SELECT t.comparison, t.level, coalesce(pairs, 0) AS pairs,
  round(CAST(coalesce(pairs, 0) / total AS DOUBLE), 9) AS u
FROM (VALUES {_LEVEL_ROWS}) AS t(comparison, level)
LEFT JOIN counts ON counts.comparison = t.comparison AND counts.level = t.level
LEFT JOIN totals ON totals.comparison = t.comparison"""
ORACLE["term_frequencies"] = f"""{ENHANCED}, {TF}
SELECT unique_id, enhanced.city_norm, round(tf, 9) AS tf
FROM enhanced LEFT JOIN tf ON tf.city_norm = enhanced.city_norm"""
ORACLE["score_pairs"] = f"""{SCORED} SELECT unique_id_l, unique_id_r,
  {', '.join(f'gamma_{c}' for c in MODEL_LEVELS)}, round(match_weight, 5) AS match_weight,
  round(match_probability, 6) AS match_probability FROM scored"""
ORACLE["training_patterns"] = f"""{ENHANCED}, {_pairs(group=False)}, levels AS (
  SELECT rule_no, {GAMMAS} {BOTH})
SELECT CAST(rule_no AS INT) AS rule_no, {', '.join(f'gamma_{c}' for c in MODEL_LEVELS)},
  count(*) AS pairs FROM levels GROUP BY ALL"""

# ------------------------------------------------------------------ clusters

ORACLE["connected_components_of_pairs"] = _recursive(f"""{ENHANCED}, {_components(
    "SELECT src AS id FROM edges UNION SELECT dst FROM edges",
    f"SELECT l.unique_id AS src, r.unique_id AS dst FROM enhanced l JOIN enhanced r ON "
    f"l.email_norm = r.email_norm AND l.unique_id < r.unique_id UNION "
    f"SELECT l.unique_id, r.unique_id FROM enhanced l JOIN enhanced r ON "
    f"l.phone_digits = r.phone_digits AND l.unique_id < r.unique_id")}
SELECT id, component FROM comp""")
ORACLE["components_of_copies"] = """
SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS component FROM documents
QUALIFY count(*) OVER (PARTITION BY text) > 1"""
ORACLE["cluster_at_threshold"] = f"{CLUSTERED} SELECT unique_id, cluster_id FROM clusters"
ORACLE["cluster_report"] = f"""{CLUSTERED}
SELECT e.unique_id, full_name, dense_rank() OVER (ORDER BY cluster_id) AS cluster_id,
  row_number() OVER (PARTITION BY cluster_id ORDER BY e.unique_id) AS partition_group
FROM enhanced e JOIN clusters ON clusters.unique_id = e.unique_id"""
ORACLE["cluster_numbers"] = f"""{CLUSTERED}
SELECT cluster_id, count(*) AS cluster_rows, row_number() OVER (ORDER BY cluster_id) AS cluster_no
FROM clusters GROUP BY cluster_id"""
ORACLE["number_events"] = """SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events"""
ORACLE["number_documents"] = """SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS nth
  FROM documents"""
ORACLE["labels_by_appearance"] = f"""{CLUSTERED}
SELECT cluster_id, 'group_' || row_number() OVER (ORDER BY min(unique_id)) AS partition_group
FROM clusters GROUP BY cluster_id"""
ORACLE["cluster_representatives"] = f"""{CLUSTERED}
SELECT cluster_id, min(unique_id) AS rep_id FROM clusters GROUP BY cluster_id"""
_FINGERPRINT = " || ' ' || ".join(f"coalesce({c}, '')" for c in (
    "full_name", "first_name_norm", "last_name_norm", "address_norm", "address", "city_norm", "city",
    "state_norm", "state", "zip_norm", "postal_code", "email_norm", "email", "phone_digits", "phone"))
ORACLE["cluster_texts"] = f"""{CLUSTERED}, f AS (
  SELECT cluster_id, e.unique_id, {_FINGERPRINT} AS t
  FROM enhanced e JOIN clusters ON clusters.unique_id = e.unique_id)
SELECT cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_rows, t AS rep_text FROM f
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY length(t) DESC, unique_id) = 1"""

_FACTORS, _OFFSETS = merge.permutation_constants()
_PERMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(_FACTORS, _OFFSETS)))
SIMILAR = rf"""WITH w AS (
  SELECT doc_id AS id, list_sort(list_distinct(list_filter(
    regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS words FROM documents),
marked AS (SELECT *, min(id) OVER (PARTITION BY words) AS first_id FROM w WHERE len(words) > 0),
hashes AS (SELECT DISTINCT id, CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) AS h
  FROM (SELECT id, unnest(words) AS x FROM marked WHERE id = first_id)),
perms(i, a, b) AS (VALUES {_PERMS}),
lowest AS (SELECT id, i, min((a * h + b) % {merge.PRIME}) AS v FROM hashes, perms GROUP BY 1, 2),
bands AS (SELECT id, md5((i // {merge.BAND_ROWS}) || ':' || string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS band
  FROM lowest GROUP BY id, i // {merge.BAND_ROWS}),
shared AS (SELECT id, min(id) OVER (PARTITION BY band) AS low FROM bands),
alike AS (SELECT id AS src, first_id AS dst FROM marked WHERE id <> first_id
  UNION SELECT id, low FROM shared WHERE id <> low)"""
ORACLE["minhash_candidates"] = f"{SIMILAR} SELECT src, dst FROM alike"
_SHARED_WORDS = ("len(list_intersect(a.words, b.words)) / CAST(len(list_distinct(list_concat(a.words, b.words))) AS DOUBLE)")
ORACLE["verified_documents"] = _recursive(f"""{SIMILAR}, distinct_sets AS (SELECT id, words FROM marked WHERE id = first_id),
met(band, id, lead, turn) AS (
  SELECT band, id, min(id) OVER (PARTITION BY band), 0 FROM bands
  UNION ALL
  SELECT band, id, min(id) OVER (PARTITION BY band), turn + 1 FROM (
    SELECT m.band, m.id, m.turn FROM met m JOIN distinct_sets a ON a.id = m.id JOIN distinct_sets b ON b.id = m.lead
    WHERE m.id <> m.lead AND {_SHARED_WORDS} < 0.8))
SELECT id AS src, first_id AS dst FROM marked WHERE id <> first_id
UNION SELECT m.id, m.lead FROM met m JOIN distinct_sets a ON a.id = m.id JOIN distinct_sets b ON b.id = m.lead
WHERE m.id <> m.lead AND {_SHARED_WORDS} >= 0.8""")
MERGED = _recursive(f"""{SIMILAR}, {_components(
    'SELECT doc_id AS id FROM documents', 'SELECT src, dst FROM alike')}""")
ORACLE["merge_similar_documents"] = f"{MERGED} SELECT id AS doc_id, component AS root FROM comp"
_GROUPS = """, roots AS (SELECT d.doc_id AS root, row_number() OVER (ORDER BY text, d.doc_id) AS group_no
  FROM documents d WHERE d.doc_id IN (SELECT component FROM comp))"""
ORACLE["group_labels"] = f"""{MERGED}{_GROUPS}
SELECT id AS cluster_id, root, group_no FROM comp JOIN roots ON root = component"""
ORACLE["group_report"] = f"""{MERGED}{_GROUPS}, first_ones AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents)
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS unique_id,
  lpad(CAST(first_id AS VARCHAR), 12, '0') AS cluster_id, 'group_' || group_no AS partition_group
FROM first_ones JOIN comp ON comp.id = first_id JOIN roots ON root = component"""

# ------------------------------------------------------------------ dedupe

_MAP = """map AS (SELECT unique_id_r AS id, min(unique_id_l) AS mapped_id FROM scored
  WHERE match_probability >= 0.9 GROUP BY 1)"""
ORACLE["id_mapping"] = f"{SCORED}, {_MAP} SELECT id, mapped_id FROM map"
ORACLE["dedupe_by_mapping"] = f"""{SCORED}, {_MAP}
SELECT coalesce(mapped_id, unique_id) AS unique_id, full_name, phone
FROM enhanced LEFT JOIN map ON id = unique_id
QUALIFY row_number() OVER (PARTITION BY coalesce(mapped_id, unique_id) ORDER BY enhanced.unique_id DESC) = 1"""
ORACLE["find_copies"] = """SELECT doc_id AS unique_id, min(doc_id) OVER w AS rep_id,
  count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY lang, text)"""

# ------------------------------------------------------------------ check

_NEW_LEVELS = ", ".join(f"{_level(c, t, 'b', 'n')} AS gamma_{c}" for c, t in MODEL_LEVELS.items())
_LINK_JOINS = " UNION ".join(
    f"SELECT b.unique_id AS unique_id_l, n.unique_id AS unique_id_r FROM enhanced b JOIN incoming n "
    f"ON {_equal(k, 'b', 'n')}" for k in RULE_KEYS)
LINKS = f"""{ENHANCED}, {TF}, incoming AS (
  SELECT * REPLACE ('new_' || unique_id AS unique_id,
    nullif(regexp_replace('0' || phone, '[^0-9]', '', 'g'), '') AS phone_digits) FROM enhanced),
linked AS ({_LINK_JOINS}),
levels AS (SELECT unique_id_l, unique_id_r, {_NEW_LEVELS}, tf.tf FROM linked
  JOIN enhanced b ON b.unique_id = unique_id_l JOIN incoming n ON n.unique_id = unique_id_r
  LEFT JOIN tf ON tf.city_norm = b.city_norm),
weighed AS (SELECT *, {_weight('tf')} AS match_weight FROM levels),
links AS (SELECT *, 1 / (1 + pow(2.0, -match_weight)) AS match_probability FROM weighed)"""
ORACLE["new_record_matches"] = f"""{LINKS} SELECT unique_id_l, unique_id_r,
  round(match_probability, 6) AS match_probability FROM links"""
ORACLE["best_matches"] = f"""{LINKS}
SELECT unique_id_r AS unique_id, unique_id_l AS matched_id, round(match_probability, 6) AS match_probability
FROM links QUALIFY row_number() OVER (PARTITION BY unique_id_r
  ORDER BY round(match_probability, 6) DESC, unique_id_l) = 1"""
_LINKS_TAIL = LINKS[LINKS.index("incoming AS ("):]
for _old, _new in (("levels", "new_levels"), ("weighed", "new_weighed")):
    _LINKS_TAIL = _LINKS_TAIL.replace(f"{_old} AS (", f"{_new} AS (").replace(f"FROM {_old}", f"FROM {_new}")
ORACLE["check_new_records"] = f"""{CLUSTERED}, {_LINKS_TAIL}, best AS (
  SELECT unique_id_r, unique_id_l, match_probability AS p FROM links
  QUALIFY row_number() OVER (PARTITION BY unique_id_r ORDER BY match_probability DESC, unique_id_l) = 1),
judged AS (SELECT n.unique_id, unique_id_l, p, CASE WHEN p >= (SELECT CASE WHEN count(*) < 1000 THEN 0.85
    WHEN count(*) < 5000 THEN 0.9 ELSE 0.95 END FROM enhanced) THEN 'duplicate'
  WHEN p >= 0.75 THEN 'potential_duplicate' ELSE 'unique' END AS result
  FROM incoming n LEFT JOIN best ON unique_id_r = n.unique_id)
SELECT judged.unique_id, result,
  CASE WHEN result <> 'unique' THEN coalesce(cluster_id, 'N/A') END AS cluster_id,
  CASE WHEN result <> 'unique' THEN coalesce('group_of_' || cluster_id, 'N/A') END AS partition_group,
  CASE WHEN result <> 'unique' THEN round(p, 6) END AS match_probability
FROM judged LEFT JOIN clusters ON clusters.unique_id = unique_id_l"""
ORACLE["simple_verdicts"] = f"""{LINKS}, best AS (
  SELECT unique_id_r, max(match_probability) AS p FROM links GROUP BY 1)
SELECT incoming.unique_id, CASE WHEN p IS NULL THEN 'unique' WHEN p > 0.9 THEN 'duplicate'
  ELSE 'potential_duplicate' END AS result
FROM incoming LEFT JOIN best ON unique_id_r = incoming.unique_id"""
