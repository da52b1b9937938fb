"""Normalising column expressions. All of them run inside Spark's own code."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose plain form is not a single base letter plus marks.
SPECIAL_LETTERS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH",
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
    "ł": "l", "Ł": "L", "ı": "i",
}

# Date shapes tried in order; day-first before month-first.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy",
    "d MMM yyyy", "M/d/yyyy",
)
ISO_ONLY = ("yyyy-MM-dd",)

URL_HOST = r"https?://(?:www\.)?([^/]+)"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks with a one-letter plain form, and those forms."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        folded = SPECIAL_LETTERS.get(letter) or "".join(
            part for part in unicodedata.normalize("NFKD", letter)
            if not unicodedata.combining(part)
        )
        if folded != letter and len(folded) == 1 and folded.isascii():
            accented.append(letter)
            plain.append(folded)
    return "".join(accented), "".join(plain)


def fold_accents(text: Column) -> Column:
    """Drop accents: ``José`` -> ``Jose``, ``Groß`` -> ``Gross``."""
    folded = F.translate(text, *_accent_table())
    for letter, plain in SPECIAL_LETTERS.items():
        if len(plain) > 1:
            folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.regexp_replace(folded, r"\p{M}+", "")


def blank_to_null(text: Column) -> Column:
    # nullif, not when: Spark then computes a nested expression once instead of twice
    return F.nullif(text, F.lit(""))


def squeeze_lower(text: Column) -> Column:
    """Lower-case, one blank between words, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fold_lower(text: Column) -> Column:
    return blank_to_null(F.lower(F.trim(fold_accents(text.cast("string")))))


def email_norm(text: Column) -> Column:
    return blank_to_null(F.lower(F.trim(text.cast("string"))))


def phone_digits(text: Column) -> Column:
    return blank_to_null(F.regexp_replace(text.cast("string"), r"\D", ""))


def zip_norm(text: Column) -> Column:
    return blank_to_null(F.upper(F.regexp_replace(text.cast("string"), r"\s", "")))


def url_domain(text: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(text.cast("string"), URL_HOST, 1)))


def date_norm(value: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """``yyyy-MM-dd`` text from any of ``formats``; null when none fits."""
    text = F.trim(value.cast("string"))
    # ordinals and the four-letter month are not understood by the date parser
    text = F.regexp_replace(text, r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    text = F.regexp_replace(text, r"(?i)\bsept\b", "Sep")
    parsed = F.coalesce(*[F.try_to_date(text, f) for f in formats])
    return F.date_format(parsed, "yyyy-MM-dd")


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def sha256_mod(value: Column, modulus: int = 10**9) -> Column:
    """SHA-256 as a number modulo ``modulus``, folded eight hex digits at a time."""
    digest = sha256_hex(value)
    rest = F.lit(0).cast("bigint")
    for start in range(1, 65, 8):
        chunk = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = F.pmod(rest * F.lit(2**32) + chunk, F.lit(modulus))
    return rest


def first_char(text: Column, upper: bool = False) -> Column:
    char = blank_to_null(F.substring(text.cast("string"), 1, 1))
    return F.upper(char) if upper else char


def mod_key(value: Column, modulus: int = 1000) -> Column:
    return F.pmod(value, F.lit(modulus))


def split_at_first_blank(text: Column) -> tuple[Column, Column]:
    """(first word, rest); the rest of a one-word name is null."""
    parts = F.split(F.trim(text.cast("string")), " ", 2)
    return blank_to_null(F.get(parts, 0)), blank_to_null(F.trim(F.get(parts, 1)))


def first_and_last_token(text: Column) -> tuple[Column, Column]:
    """(first token, last token); the last token of a one-word name is empty."""
    words = F.split(F.trim(F.coalesce(text.cast("string"), F.lit(""))), r"\s+")
    last = F.when(F.size(words) > 1, F.try_element_at(words, F.lit(-1))).otherwise("")
    return F.get(words, 0), last


def hash_share(key: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for a key, the same on any layout."""
    head = F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10)
    return head.cast("double") / F.lit(float(16**13))
