"""What do the columns of a record table mean?

Three rule sets share the passes: ``basic`` (names, then value patterns), ``wide``
(names, name patterns, then type and distribution) and ``loose`` (as wide, but name
patterns may reuse a column and sparse columns are not skipped).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import profile_columns
from .sketches import column_sketches, sketch_error, sketched_profile

# Column names that stand for a role, best first.
BASIC_ALIASES = {
    "first_name": ["first_name", "fname", "given_name", "forename"],
    "last_name": ["last_name", "surname", "lname", "family_name"],
    "full_name": ["full_name", "name", "customer_name"],
    "email": ["email", "email_address"],
    "phone": ["phone", "mobile", "phone_number", "contact_no"],
    "zip": ["zip", "zipcode", "postal_code", "pincode"],
    "city": ["city", "town"],
    "state": ["state", "province", "region"],
    "address": ["address", "street", "street_address"],
    "date": ["dob", "date", "birth_date"],
    "numeric_id": ["id", "customer_id", "user_id", "person_id"],
}
WIDE_ALIASES = {
    "first_name": ["first_name", "firstname", "given_name", "fname", "forename"],
    "last_name": ["last_name", "lastname", "surname", "lname", "family_name"],
    "full_name": ["full_name", "customer_name", "name", "person_name", "complete_name"],
    "email": ["email", "email_address", "e_mail", "contact_email"],
    "phone": ["phone", "mobile", "contact_no", "phone_number", "telephone"],
    "zip": ["zip", "zipcode", "postal_code", "pincode", "postcode"],
    "city": ["city", "town", "municipality"],
    "state": ["state", "province", "region", "county"],
    "address": ["address", "street", "street_address", "addr", "location"],
    "date": ["date", "dob", "birth_date", "order_date", "timestamp", "created_at"],
    "url": ["url", "website", "web_address"],
    "geo_lat": ["lat", "latitude", "geo_lat"],
    "geo_lon": ["lon", "long", "longitude", "geo_lon"],
    "currency": ["price", "amount", "cost", "revenue", "salary"],
    "numeric_id": ["id", "key", "account_number", "record_id", "customer_id", "user_id",
                   "person_id", "orderkey"],
}
# What the text of a column looks like (basic rules), in order of precedence.
VALUE_PATTERNS = {
    "email": r".*@.*",
    "phone": r"^\+?\d{6,15}$",
    "zip": r"^\d{4,10}$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
}
# What the name of a column looks like (wide and loose rules).
_NAME_PATTERNS = {
    "email": [r".*mail.*", r".*@.*"],
    "phone": [r".*(phone|mobile|tel|contact).*"],
    "zip": [r".*(zip|postal|pin).*code.*"],
    "date": [r".*date.*", r".*_at$", r".*timestamp.*", r"^\d{4}[/-]\d{2}[/-]\d{2}"],
    "url": [r".*(url|website|http|www).*"],
    "geo_lat": [r".*lat(itude)?.*"],
    "geo_lon": [r".*lon(gitude)?.*"],
    "numeric_id": [r".*(id|key|number|no)$"],
    "name": [r".*name.*"],
    "address": [r".*(addr|address|street).*"],
    "geo": [r".*(city|state|province).*"],
}
# Limits of the type and distribution pass.
SKIP_BELOW, ID_CARDINALITY, ID_SHARE = 0.1, 0.85, 0.9
ENUM_BELOW, TEXT_ABOVE, TEXT_SHARE = 0.1, 0.5, 0.2
VALUE_SHARE = 0.5

_NUMBERS = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
RULE_SETS = ("basic", "wide", "loose")


class Roles(dict):
    """role -> column, remembering in ``found_by`` which pass assigned each role."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.found_by: dict[str, str] = {}

    def assign(self, role: str, column: str, found_by: str) -> None:
        self[role] = column
        self.found_by[role] = found_by


def _by_alias(columns: dict[str, str], rules: str, roles: Roles) -> None:
    for role, aliases in (BASIC_ALIASES if rules == "basic" else WIDE_ALIASES).items():
        for alias in aliases:
            column = columns.get(alias)
            taken = rules == "wide" and column in roles.values()
            if column and not taken and (rules == "basic" or "unique_id" not in alias):
                roles.assign(role, column, "alias")
                break


def _by_name(columns: dict[str, str], rules: str, roles: Roles) -> None:
    for role, patterns in _NAME_PATTERNS.items():
        if role in roles:
            continue
        free = (
            (column for pattern in patterns for lowered, column in columns.items()
             if "unique_id" not in lowered
             and re.search(pattern, lowered, re.IGNORECASE)
             and (rules == "loose" or column not in roles.values()))
        )
        column = next(free, None)
        if column:
            roles.assign(role, column, "name_pattern")


def _by_value(sample: DataFrame, roles: Roles) -> None:
    """Give a column the first free role whose pattern fits most of its sampled values."""
    open_columns = [c for c in sample.columns if c not in roles.values() and c != "unique_id"]
    if not open_columns:
        return
    tests = [
        F.avg(F.col(c).cast("string").rlike(p).cast("double")).alias(f"{i}:{role}")
        for i, c in enumerate(open_columns) for role, p in VALUE_PATTERNS.items()
    ]
    shares = sample.agg(*tests).first().asDict()
    for i, column in enumerate(open_columns):
        for role in VALUE_PATTERNS:
            if role not in roles and (shares[f"{i}:{role}"] or 0.0) >= VALUE_SHARE:
                roles.assign(role, column, "value_pattern")
                break


def _by_distribution(df: DataFrame, profile: dict, rules: str, roles: Roles) -> None:
    gated = rules == "wide"
    for field in df.schema.fields:
        column = field.name
        if column in roles.values() or "unique_id" in column.lower() or column not in profile:
            continue
        share, ratio = profile[column]
        if gated and share < SKIP_BELOW:
            continue
        if isinstance(field.dataType, _NUMBERS) and "numeric_id" not in roles:
            if ratio >= ID_CARDINALITY and share >= ID_SHARE:
                roles.assign("numeric_id", column, "distribution")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)) \
                and "date" not in roles:
            roles.assign("date", column, "type")
        elif isinstance(field.dataType, T.StringType) and (not gated or share > TEXT_SHARE):
            if 0 < ratio < ENUM_BELOW and "category_enum" not in roles:
                roles.assign("category_enum", column, "distribution")
            elif ratio > TEXT_ABOVE and "text_freeform" not in roles:
                roles.assign("text_freeform", column, "distribution")


def _near_a_limit(ratio: float) -> bool:
    """Whether the error of a sketch may put a ratio on the other side of a limit."""
    return any(abs(ratio - limit) <= limit * 2 * sketch_error() for limit in (ENUM_BELOW, TEXT_ABOVE, ID_CARDINALITY))


def infer_roles(df: DataFrame, rules: str = "wide") -> Roles:
    """Roles of the columns of ``df``, from one pass over the whole table: distinct values over
    rows of a sample are not those of the table. Distinct values are estimated by sketches, and
    counted for columns so near to a limit that the estimate does not decide."""
    if rules not in RULE_SETS:
        raise ValueError(f"rules must be one of {RULE_SETS}")
    roles = Roles()
    if df.isEmpty():
        return roles
    columns = {c.lower(): c for c in df.columns}
    _by_alias(columns, rules, roles)
    if rules == "basic":
        _by_value(df, roles)
        return roles
    _by_name(columns, rules, roles)
    # columns that can still get a role: bounded by the schema, so collecting is safe
    left = [c for c in df.columns if c not in roles.values() and "unique_id" not in c.lower()]
    if left:
        ratio = "cardinality_ratio" if rules == "wide" else "cardinality_ratio_nonnull"
        profile = {
            r["column_name"]: (r["non_null_share"], r[ratio])
            for r in sketched_profile(column_sketches(df, left)).collect()
        }
        unsure = [c for c, (_, estimate) in profile.items() if _near_a_limit(estimate)]
        if unsure:
            profile |= {r["column_name"]: (r["non_null_share"], r[ratio]) for r in profile_columns(df, unsure).collect()}
        _by_distribution(df, profile, rules, roles)
    return roles


def roles_table(spark: SparkSession, roles: Roles) -> DataFrame:
    rows = [(r, c, getattr(roles, "found_by", {}).get(r)) for r, c in roles.items()]
    return spark.createDataFrame(rows, "role string, column_name string, source_pass string")
