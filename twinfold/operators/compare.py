"""Comparing the two records of a pair, column by column.

A comparison gives a level: -1 when a side is missing, 0 when nothing agrees, and higher
the stronger the agreement; the top level is equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import point_distance_km
from ..functions.similarity import first_passed, jaro_winkler_similarity
from .profile import non_null_counts
from .skew import skew_join

# Kinds whose similarity is worked out in Arrow batches, by far the dearest.
DEAR_KINDS = ("jaro_winkler", "email")
# Kinds that stay in Spark, but cost several times an edit distance.
LATER_KINDS = ("birth_date", "distance")
# Fixed value: a column is compared when more than this share of it is filled.
COMPARE_ABOVE = 0.2
# Thresholds inside the named comparisons, strongest first.
NAME_LEVELS = (0.92, 0.88, 0.7)
EMAIL_LEVEL = 0.88
POSTCODE_PREFIXES = (4, 2)
BIRTH_DAYS = (30, 365, 3652)
# Up to this many days apart the levels of a date are looked up in an array of all of them.
MOST_DAYS = 10_000
DISTANCES_KM = (0.1, 1.0, 10.0)


@dataclass(frozen=True)
class Comparison:
    column: str
    kind: str
    thresholds: tuple[float, ...] = ()
    term_frequency: bool = False

    @property
    def gamma(self) -> str:
        return f"gamma_{self.column}"

    @property
    def top(self) -> int:
        """The level of equality; there are ``top + 1`` levels besides missing."""
        return 1 + _weaker_levels(self)

    def to_dict(self) -> dict:
        return asdict(self) | {"thresholds": list(self.thresholds)}

    @staticmethod
    def from_dict(fields: dict) -> Comparison:
        return Comparison(**(fields | {"thresholds": tuple(fields["thresholds"])}))


def exact(column: str, term_frequency: bool = False) -> Comparison:
    return Comparison(column, "exact", (), term_frequency)


def jaro_winkler_at(column: str, thresholds: Iterable[float],
                    term_frequency: bool = False) -> Comparison:
    return Comparison(column, "jaro_winkler", tuple(sorted(thresholds, reverse=True)),
                      term_frequency)


def levenshtein_at(column: str, thresholds: Iterable[int] = (1, 2)) -> Comparison:
    return Comparison(column, "levenshtein", tuple(sorted(thresholds)))


def name_comparison(column: str) -> Comparison:
    return Comparison(column, "jaro_winkler", NAME_LEVELS)


def email_comparison(column: str) -> Comparison:
    return Comparison(column, "email", (EMAIL_LEVEL,))


def postcode_comparison(column: str, prefixes: Iterable[int] = POSTCODE_PREFIXES) -> Comparison:
    return Comparison(column, "postcode", tuple(sorted(prefixes, reverse=True)))


def birth_date_comparison(column: str, days: Iterable[int] = BIRTH_DAYS) -> Comparison:
    return Comparison(column, "birth_date", tuple(sorted(days)))


def distance_comparison(column: str, kilometres: Iterable[float] = DISTANCES_KM) -> Comparison:
    """Places as texts ``lat,lon``: equal, then within so many kilometres."""
    return Comparison(column, "distance", tuple(sorted(kilometres)))


def email_user(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def one_edit_or_swap(left: Column, right: Column) -> Column:
    """Damerau distance of at most 1, without leaving Spark: one edit, or two neighbouring
    letters exchanged, which are two edits. The letters are gone through only where that can be."""
    size = F.length(left)
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
        lambda i: F.concat(
            F.substring(left, F.lit(1), i - 1), F.substring(left, i + 1, F.lit(1)),
            F.substring(left, i, F.lit(1)), F.substring(left, i + 2, size)) == right,
    )
    # by the distance plus 1: over 2, 0, 1; of 2 nothing is known yet
    known = F.get(F.array(F.lit(False), F.lit(True), F.lit(True)), F.levenshtein(left, right, 2) + 1)
    return F.coalesce(known, (size == F.length(right)) & (size > 1) & swap)


def _iso_date(text: Column) -> Column:
    """``try_to_date(text, "yyyy-MM-dd")`` by a cast, which needs no formatter: of texts of that form both
    read the same."""
    end = F.substring(text, 10, 1)
    shaped = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    return F.when(shaped & (end >= "0") & (end <= "9"), text.try_cast("date"))


def _exact_levels(c: Comparison, left: Column, right: Column) -> list[Column]:
    return []


def _winkler_levels(c: Comparison, left: Column, right: Column) -> list[Column]:
    similarity = jaro_winkler_similarity(left, right)
    return [similarity >= t for t in c.thresholds]


def _levenshtein_levels(c: Comparison, left: Column, right: Column) -> list[Column]:
    return [F.levenshtein(left, right, int(t)) >= 0 for t in c.thresholds]


def _levenshtein_level(c: Comparison, left: Column, right: Column) -> Column:
    """What ``_levenshtein_levels`` come to, from one distance: the level of each, none (-1) first."""
    most = [int(t) for t in c.thresholds]
    levels = [0, *(c.top - 1 - sum(t < edits for t in most) for edits in range(most[-1] + 1))]
    return F.get(F.array(*map(F.lit, levels)), F.levenshtein(left, right, most[-1]) + 1)


def _email_levels(c: Comparison, left: Column, right: Column) -> list[Column]:
    user_l, user_r = email_user(left), email_user(right)
    return [user_l == user_r,
            *[jaro_winkler_similarity(left, right) >= t for t in c.thresholds],
            *[jaro_winkler_similarity(user_l, user_r) >= t for t in c.thresholds]]


def _winkler_level(c: Comparison, left: Column, right: Column) -> Column:
    """What ``_winkler_levels`` come to for unequal texts: those alone go to Python, which returns the level."""
    unequal = left != right
    passed = first_passed(c.thresholds)(F.when(unequal, left), F.when(unequal, right))
    return F.coalesce(c.top - passed, F.lit(0))


def _email_level(c: Comparison, left: Column, right: Column) -> Column:
    """What ``_email_levels`` come to for unequal texts: whole texts and users go to Python once, as one pair of texts."""
    same_user = email_user(left) == email_user(right)
    unequal = (left != right) & ~same_user
    passed = first_passed(c.thresholds, "@")(F.when(unequal, left), F.when(unequal, right))
    return F.when(same_user, c.top - 1).otherwise(F.coalesce(c.top - 1 - passed, F.lit(0)))


def _postcode_levels(c: Comparison, left: Column, right: Column) -> list[Column]:
    return [F.left(left, F.lit(int(n))) == F.left(right, F.lit(int(n))) for n in c.thresholds]


def _birth_date_levels(c: Comparison, left: Column, right: Column) -> list[Column]:
    apart = F.abs(F.datediff(_iso_date(left), _iso_date(right)))
    return [one_edit_or_swap(left, right), *[apart <= int(d) for d in c.thresholds]]


def _birth_date_level(c: Comparison, left: Column, right: Column) -> Column:
    """What ``_birth_date_levels`` come to: the levels of all days apart are one constant array, so that
    the dates are read and subtracted once, not once per threshold."""
    most = [int(d) for d in c.thresholds]
    apart = F.abs(F.datediff(_iso_date(left), _iso_date(right)))
    levels = [F.array_repeat(F.lit(c.top - 2 - i), upto - below) for i, (below, upto) in enumerate(zip([-1, *most], most))]
    return F.when(one_edit_or_swap(left, right), c.top - 1).otherwise(F.coalesce(F.get(F.concat(*levels), apart), F.lit(0)))


def _distance_levels(c: Comparison, left: Column, right: Column) -> list[Column]:
    apart = point_distance_km(left, right)
    return [apart <= float(km) for km in c.thresholds]


_KINDS: dict[str, Callable[[Comparison, Column, Column], list[Column]]] = {
    "exact": _exact_levels,
    "jaro_winkler": _winkler_levels,
    "levenshtein": _levenshtein_levels,
    "email": _email_levels,
    "postcode": _postcode_levels,
    "birth_date": _birth_date_levels,
    "distance": _distance_levels,
}


def _weaker_levels(c: Comparison) -> int:
    extra = {"exact": 0, "email": 2, "birth_date": 1}.get(c.kind, 0)
    return extra + (len(c.thresholds) if c.kind != "exact" else 0)


def gamma(c: Comparison, left: Column, right: Column) -> Column:
    """The level of one comparison."""
    level = F.when(left.isNull() | right.isNull(), -1).when(left == right, c.top)
    if c.kind == "levenshtein" and c.thresholds:
        return level.otherwise(_levenshtein_level(c, left, right))
    if c.kind == "jaro_winkler" and c.thresholds:
        return level.otherwise(_winkler_level(c, left, right))
    if c.kind == "email" and c.thresholds:
        return level.otherwise(_email_level(c, left, right))
    if c.kind == "birth_date" and c.thresholds and 0 <= c.thresholds[0] and c.thresholds[-1] <= MOST_DAYS:
        return level.otherwise(_birth_date_level(c, left, right))
    for below, agrees in enumerate(_KINDS[c.kind](c, left, right), start=1):
        level = level.when(agrees, c.top - below)
    return level.otherwise(0)


def compare_pairs(pairs: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """Add ``gamma_<column>`` for every comparison to pairs with ``<column>_l`` / ``_r``."""
    return pairs.withColumns({
        c.gamma: gamma(c, F.col(f"{c.column}_l"), F.col(f"{c.column}_r")) for c in comparisons
    })


def self_levels(df: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """The levels of a record compared with its own copy."""
    return df.withColumns({
        c.gamma: F.when(F.col(c.column).isNull(), -1).otherwise(c.top) for c in comparisons
    })


def compared_columns(comparisons: list[Comparison]) -> list[str]:
    """Columns that must travel with a record."""
    return [c.column for c in comparisons] + [
        f"tf_{c.column}" for c in comparisons if c.term_frequency]


def propose_comparisons(columns: Iterable[str], roles: dict, shares: dict[str, float] | None,
                        rules: str = "wide") -> list[Comparison]:
    """Comparisons of the roles found. ``shares`` gates them (wide rules); an error when
    nothing can be compared."""
    have = set(columns)
    if rules == "basic":
        wanted = [
            name_comparison("first_name_norm"), name_comparison("last_name_norm"),
            levenshtein_at("date_norm"), exact("city_norm", True), email_comparison("email_norm"),
        ]
        return _existing(wanted, have, None)
    wide = rules == "wide"
    raw = lambda role: f"{role}_norm" if wide else roles[role]
    by_role = {
        "first_name": lambda: [jaro_winkler_at(raw("first_name"), (0.7, 0.9)),
                               exact("first_name_metaphone", wide)],
        "last_name": lambda: [jaro_winkler_at(raw("last_name"), (0.7, 0.9)),
                              exact("last_name_metaphone", wide)],
        "email": lambda: [email_comparison("email_norm")],
        "phone": lambda: [levenshtein_at("phone_digits", (2, 4))],
        "address": lambda: [jaro_winkler_at("address_norm", (0.7, 0.9))],
        "city": lambda: [jaro_winkler_at("city_norm", (0.8, 0.95), wide)],
        "state": lambda: [exact("state_norm", wide)],
        "zip": lambda: [postcode_comparison("zip_norm")],
        "date": lambda: [birth_date_comparison("date_norm")],
        "full_name": lambda: [jaro_winkler_at(roles["full_name"], (0.8, 0.95))],
        "text_freeform": lambda: [jaro_winkler_at(roles["text_freeform"], (0.8, 0.95))],
        "url": lambda: [exact("url_domain", True)] if wide else [],
        "geo_lat": lambda: [distance_comparison("geo_point")],
    }
    wanted = [c for role, make in by_role.items() if role in roles for c in make()]
    gates = shares if wide else None
    found = _existing(wanted, have, gates)
    if not found and "numeric_id" in roles:
        found = _existing([exact(f"{roles['numeric_id']}_hash")], have, gates)
    if not found:
        raise ValueError(f"no column to compare; roles found: {sorted(roles)}")
    return found


def _existing(wanted: list[Comparison], have: set, shares: dict | None) -> list[Comparison]:
    return [c for c in wanted if c.column in have
            and (shares is None or shares.get(c.column, 0.0) > COMPARE_ABOVE)]


def term_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(column, tf, rows): the share of every value among the filled rows."""
    _, counts = non_null_counts(df, {column: F.col(column)})
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count("*").alias("value_rows"))
            .withColumn(f"tf_{column}", F.col("value_rows") / F.lit(float(counts[column] or 1))))


def add_term_frequencies(df: DataFrame, comparisons: list[Comparison],
                         values: DataFrame | None = None) -> DataFrame:
    """Give every record the frequency of its value, where a comparison asks for it, so
    that pairs need no further join. ``values`` is the table to count in."""
    for c in comparisons:
        if c.term_frequency:
            counted = term_frequencies(df if values is None else values, c.column)
            df = skew_join(df, counted, c.column, "value_rows", "left").drop("value_rows")
    return df
