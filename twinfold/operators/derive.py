"""Normalised, phonetic and hashed columns beside the input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions import text as tx
from ..functions.phonetic import double_metaphone
from .profile import non_null_shares
from .roles import Roles

# Fixed value: a column is derived when more than this share of its source is filled.
DERIVE_ABOVE = 0.2
# Places within this distance are sure to meet in a block.
NEAR_KM = 1.0
# Words read as booleans in incoming records.
TRUE_WORDS = ("true", "1", "t", "yes", "y")
FALSE_WORDS = ("false", "0", "f", "no", "n")

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def normalize_strings(df: DataFrame) -> DataFrame:
    """``<column>_norm`` for every text column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({f"{c}_norm": tx.squeeze_lower(F.col(c)) for c in texts})


def name_columns(df: DataFrame) -> DataFrame:
    """first_name, last_name and full_name from ``name``, where they are missing."""
    if "name" not in df.columns:
        return df
    name = F.coalesce(F.col("name").cast("string"), F.lit(""))
    first, last = tx.first_and_last_token(name)
    new = {"first_name": first, "last_name": last, "full_name": name}
    return df.withColumns({c: e for c, e in new.items() if c not in df.columns})


def surname_aliases(df: DataFrame) -> DataFrame:
    """Offer every surname column under both of its usual names."""
    new = {}
    for ending in ("", "_norm", "_metaphone"):
        for have, want in (("last_name", "surname"), ("surname", "last_name")):
            if have + ending in df.columns and want + ending not in df.columns:
                new[want + ending] = F.col(have + ending)
    return df.withColumns(new) if new else df


def _split_names(roles: dict, rules: str) -> dict[str, Column]:
    """Columns split off the full name, for the name roles that nothing else fills."""
    if "full_name" not in roles:
        return {}
    ending = "" if rules == "basic" else "_derived"
    parts = zip(("first_name", "last_name"), tx.split_at_first_blank(F.col(roles["full_name"])))
    return {f"{role}{ending}": (role, part) for role, part in parts if role not in roles}


def _role_columns(role: str, column: str, dtype: T.DataType, rules: str) -> dict[str, Column]:
    """The derived columns of one role."""
    c = F.col(column)
    dates = tx.ISO_ONLY if rules == "basic" else tx.DATE_FORMATS
    if role in ("first_name", "last_name"):
        derived = {f"{role}_norm": tx.fold_lower(c)}
        if role == "first_name" and rules != "basic":
            derived["first_name_first_char"] = tx.first_char(c, upper=rules == "loose")
        return derived
    if role in ("city", "state", "address"):
        return {f"{role}_norm": tx.fold_lower(c)}
    if role == "numeric_id":
        hashed = tx.sha256_mod(c) if rules == "loose" else tx.sha256_hex(c)
        derived = {f"{column}_hash": hashed}
        if isinstance(dtype, _INTEGERS):
            derived[f"{column}_mod_1000"] = tx.mod_key(c)
        return derived
    return {
        "email": lambda: {"email_norm": tx.email_norm(c)},
        "phone": lambda: {"phone_digits": tx.phone_digits(c)},
        "zip": lambda: {"zip_norm": tx.zip_norm(c)},
        "date": lambda: {"date_norm": tx.date_norm(
            c.cast("date") if isinstance(dtype, (T.TimestampType, T.DateType)) else c, dates)},
        "url": lambda: {"url_domain": tx.url_domain(c)},
        "text_freeform": lambda: {f"{column}_hash": tx.sha256_hex(c)},
    }.get(role, dict)()


def place_columns(lat: Column, lon: Column, near_km: float = NEAR_KM) -> dict[str, Column]:
    """The place as text, and the cells in which places within ``near_km`` meet."""
    point = geo.geo_point(lat, lon)
    cells = geo.geo_cells(geo.point_part(point, 0), geo.point_part(point, 1), near_km)
    return {"geo_point": point, **{f"geo_cell_{i}": cell for i, cell in enumerate(cells)}}


def enhance(df: DataFrame, roles: dict, rules: str = "wide", gate: bool = True) \
        -> tuple[DataFrame, Roles]:
    """``df`` with the derived columns of its roles, and the roles with the name parts
    added. ``gate=False`` derives from sparse columns too (incoming records)."""
    found = Roles(roles)
    found.found_by = dict(getattr(roles, "found_by", {}))
    split = _split_names(found, rules)
    for column, (role, _) in split.items():
        found.assign(role, column, "split")
    df = df.withColumns({c: part for c, (_, part) in split.items()}) if split else df

    used = {c: F.col(c) for c in set(found.values()) if c in df.columns}
    shares = non_null_shares(df, used) if gate and used else dict.fromkeys(used, 1.0)
    derived: dict[str, Column] = {}
    for role, column in found.items():
        if column in used and shares[column] > DERIVE_ABOVE:
            derived |= _role_columns(role, column, df.schema[column].dataType, rules)
    if rules != "basic" and all(r in found and shares.get(found[r], 0.0) > DERIVE_ABOVE for r in ("geo_lat", "geo_lon")):
        derived |= place_columns(F.col(found["geo_lat"]), F.col(found["geo_lon"]))
    if derived:
        df = df.withColumns(derived)
    codes = {f"{r}_metaphone": double_metaphone(F.col(f"{r}_norm"))
             for r in ("first_name", "last_name") if f"{r}_norm" in derived}
    return (df.withColumns(codes) if codes else df), found


def align_to(df: DataFrame, base: T.StructType) -> DataFrame:
    """Add the columns of ``base`` that ``df`` lacks, as typed nulls."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in base if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def coerce_value(value: Column, dtype: T.DataType) -> Column:
    """An incoming value as ``dtype``; what cannot be read becomes null."""
    text = F.trim(value.cast("string"))
    if isinstance(dtype, T.NumericType):
        return text.try_cast(dtype)
    if isinstance(dtype, T.BooleanType):
        word = F.lower(text)
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        seconds = F.timestamp_seconds(text.try_cast("double"))
        return F.coalesce(seconds, F.try_to_timestamp(text)).cast(dtype)
    return text if isinstance(dtype, T.StringType) else value


def coerce_to(df: DataFrame, base: T.StructType) -> DataFrame:
    """Read the values of incoming records as the types of the base table."""
    have = {f.name: coerce_value(F.col(f.name), f.dataType) for f in base if f.name in df.columns}
    return df.withColumns(have) if have else df
