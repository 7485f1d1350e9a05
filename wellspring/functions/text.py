"""Names, identifiers, phone numbers, free-text depths and places."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.numeric import half_even

# Words that carry no location, city keywords, units of depth.
FILLER_WORDS = (
    "taluka", "tehsil", "tal", "dist", "district", "village", "gaon",
    "chs", "society", "housing", "coop", "co-op", "cooperative", "co-operative",
)
CITY_KEYWORDS = {
    "mumbai": ("MUM_ALL", "Mumbai — all 7 lakes"),
    "bombay": ("MUM_ALL", "Mumbai — all 7 lakes"),
    "thane": ("MUM_ALL", "Mumbai — all 7 lakes"),
    "pune": ("PUN_KHW", "Pune — Khadakwasla chain"),
    "pimpri": ("PUN_ALL", "Pune — all 5 dams"),
    "chinchwad": ("PUN_ALL", "Pune — all 5 dams"),
    "kothrud": ("PUN_KHW", "Pune — Khadakwasla chain"),
}
DEPTH_UNITS = ("m", "mtr", "mtrs", "meter", "meters", "metre", "metres", "मीटर", "मी")

_DEPTH = r"(?iU)^\s*(?:depth\s*[:=]?\s*)?(\d+(?:[.,]\d+)?)\s*(?:" + "|".join(DEPTH_UNITS) + r")?\s*$"
_FILLER = r"\b(?:" + "|".join(sorted(FILLER_WORDS, key=len, reverse=True)) + r")\b"


def station_id(lat: Column, lon: Column, name: Column, prefix: str) -> Column:
    """Prefix plus ten hex digits of md5 over 4-decimal position and plain name."""
    key = F.concat_ws(
        "|",
        half_even(lat, 4).cast("string"),
        half_even(lon, 4).cast("string"),
        F.lower(F.trim(name)),
    )
    return F.concat(F.lit(prefix), F.substring(F.md5(key), 1, 10))


@cache
def _decimal_digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and the ASCII digits they stand for."""
    given = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(given), "".join(str(unicodedata.decimal(c)) for c in given)


def ascii_digits(col: Column) -> Column:
    """Decimal digits of all scripts as ASCII ones, which number casts understand."""
    return F.translate(col, *_decimal_digits())


def plain(col: Column) -> Column:
    return F.lower(F.trim(col))


def clean_name(col: Column) -> Column:
    """Collapse spaces and title-case; ``nan``, ``-`` and blanks become NULL.

    Title case restarts after every uncased character (``o'neil`` to
    ``O'Neil``), which ``initcap`` does not do.
    """
    squeezed = F.regexp_replace(F.trim(col), r"(?U)\s+", " ")
    runs = F.regexp_extract_all(F.lower(squeezed), F.lit(r"([\p{Lu}\p{Ll}]+|[^\p{Lu}\p{Ll}]+)"), 1)
    titled = F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))),
        "",
    )
    return F.when(~titled.isin("Nan", "-", ""), titled)


def phone_e164(raw: Column) -> Column:
    """Indian mobile to E.164, the country code removed by length; else NULL."""
    digits = F.regexp_replace(raw, r"\D", "")
    size = F.length(digits)
    local = (
        F.when((size == 13) & digits.startswith("091"), F.substring(digits, 4, 10))
        .when((size == 12) & digits.startswith("91"), F.substring(digits, 3, 10))
        .when((size == 11) & digits.startswith("0"), F.substring(digits, 2, 10))
        .otherwise(digits)
    )
    return F.when(local.rlike(r"^[6-9]\d{9}$"), F.concat(F.lit("+91"), local))


def mask_phone(phone: Column) -> Column:
    tail = F.right(phone, F.lit(4))
    return (
        F.when(phone.isNull() | (phone == ""), F.lit("—"))
        .when(phone.startswith("+91"), F.concat(F.substring(phone, 1, 3), F.lit(" XXXXX "), tail))
        .otherwise(F.concat(F.lit("…"), tail))
    )


def pretty_phone(phone: Column) -> Column:
    grouped = F.concat_ws(
        " ", F.substring(phone, 1, 3), F.substring(phone, 4, 5), F.substring(phone, 9, 5)
    )
    return F.when(phone.startswith("+91") & (F.length(phone) == 13), grouped).otherwise(phone)


def parse_depth(text: Column) -> Column:
    """A message that is only a number, maybe with prefix and unit; else NULL."""
    number = ascii_digits(F.regexp_extract(text, _DEPTH, 1))
    return F.nullif(F.regexp_replace(number, ",", "."), F.lit("")).try_cast("double")


@F.pandas_udf(T.StringType())
def fold_accents(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks; the JVM has no built-in for it."""
    decomposed = texts.str.normalize("NFKD")
    return decomposed.map(
        lambda s: "".join(c for c in s if not unicodedata.combining(c)), na_action="ignore"
    )


def place_key(text: Column) -> Column:
    """Accent-free lower-case tokens without the words everyone types."""
    folded = F.lower(fold_accents(F.coalesce(text, F.lit(""))))
    bare = F.regexp_replace(folded, _FILLER, " ")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def age_words(days: Column) -> Column:
    """How stale a row is, in words."""
    months = F.rint(days / F.lit(30.4)).cast("int").cast("string")
    years = F.format_string("%.1f", days / F.lit(365.25))
    return (
        F.when(days.isNull(), F.lit(""))
        .when(days <= 1, F.lit("today"))
        .when(days < 60, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 730, F.concat(months, F.lit(" months ago")))
        .otherwise(F.concat(years, F.lit(" years ago")))
    )


def to_ist(utc: Column) -> Column:
    """Indian local time of a UTC instant held without a zone."""
    return utc + F.expr("INTERVAL '05:30' HOUR TO MINUTE")
