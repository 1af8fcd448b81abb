"""Scalar expressions: parsing, unit conversion, geography, label maps."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import fixed


# ---- text and ids ----
def normalize_id(c: Column) -> Column:
    """Trimmed id text without the trailing zeros a float round trip leaves."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "")


def matching_id(c: Column) -> Column:
    """Id for matching two systems: normalised, no leading zeros, empty or 'nan' as null."""
    text = F.regexp_replace(normalize_id(c), "^0+", "")
    return F.when(text.isin("", "nan"), F.lit(None)).otherwise(text)


def contains_any(c: Column, words: Sequence[str], ignore_case: bool = False) -> Column:
    """Whether any of the words occurs as a substring."""
    pattern = "|".join(re.escape(w) for w in words)
    return c.rlike(("(?i)" if ignore_case else "") + pattern)


def code_matches(c: Column, *patterns: str) -> Column:
    """LIKE patterns with ``%`` and ``[...]`` classes, anchored at both ends."""
    def to_regex(p: str) -> str:
        parts = re.split(r"(\[[^\]]*\]|%|_)", p)
        return "".join({"%": "(?s).*", "_": "."}.get(x, x if x.startswith("[") else re.escape(x)) for x in parts)
    return c.rlike("|".join(f"^(?:{to_regex(p)})$" for p in patterns))


def try_code_in(c: Column, codes: Sequence[int]) -> Column:
    """Numeric code held as text: anything that is not a number is no member."""
    return F.coalesce(c.try_cast("bigint").isin(*codes), F.lit(False))


def yn(c: Column, vocab: str = "flag") -> Column:
    """0/1 from a yes/no text. ``flag``: Y, 1, TRUE, YES; ``yes``: yes, true, 1; ``not_negative``: unless a no-token."""
    text = F.trim(c.cast("string"))
    if vocab == "flag":
        hit = F.upper(text).isin("Y", "1", "TRUE", "YES")
    elif vocab == "yes":
        hit = F.lower(text).isin("yes", "true", "1")
    elif vocab == "insulin":
        hit = F.lower(text).isin("yes", "true", "1", "insulin", "non-insulin")
    elif vocab == "not_negative":
        hit = ~F.lower(text).isin("no", "0", "nan", "none", "", "0.0")
    else:
        raise ValueError(f"unknown vocabulary {vocab!r}")
    return F.coalesce(hit, F.lit(False)).cast("int")


def number(c: Column, kind: str = "double") -> Column:
    """Number or null, never an error (also with ANSI mode on)."""
    return c.cast("string").try_cast(kind)


def signature(*columns: Column) -> Column:
    """Values joined by '|', missing ones as 'nan'."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns])


def token(*columns: Column, width: int = 8, missing: str = "Unk") -> Column:
    """Token composed of the first characters of each column."""
    return F.concat_ws(":", *[F.coalesce(F.left(c, F.lit(width)), F.lit(missing)) for c in columns])


def mapped(c: Column, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Label map; unmatched values take the default, or keep their value when none is given."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.create_map(*pairs)[c]
    other = c if default is None else (default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(found, other)


# ---- units ----
def inches_to_cm(c: Column) -> Column:
    return F.round(number(c, "decimal(6,2)").cast("double") * 2.54, 1)


def ounces_to_kg(c: Column) -> Column:
    return F.round(number(c, "decimal(7,2)").cast("double") * 0.0283495, 1)


def pounds_to_kg(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit).startswith("lb"), value * 0.453592).otherwise(value)


def bmi(height_inches: Column, weight_ounces: Column) -> Column:
    """Body mass index from inches and ounces; null unless the height is positive."""
    h = number(height_inches, "decimal(6,2)").cast("double")
    w = number(weight_ounces, "decimal(7,2)").cast("double")
    return F.when(h > 0, w * 0.0283495 / F.pow(h * 2.54 / 100.0, F.lit(2.0)))


# ---- geography ----
def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = math.pi / 180.0
    a = (F.pow(F.sin((lat2 - lat1) * rad / 2), F.lit(2.0))
         + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.pow(F.sin((lon2 - lon1) * rad / 2), F.lit(2.0)))
    return F.asin(F.sqrt(a)) * (2 * fixed.EARTH_RADIUS_MILES)


def nearest_miles(lat: Column, lon: Column, sites: Mapping[str, tuple[float, float]] | None = None) -> Column:
    distances = [haversine_miles(lat, lon, F.lit(a), F.lit(b)) for a, b in (sites or fixed.ANCHOR_SITES).values()]
    return distances[0] if len(distances) == 1 else F.least(*distances)


def distance_flags(miles: Column) -> tuple[Column, Column]:
    """(farther than 5 miles, between 5 and 25 miles) as 0/1; unknown distance gives null."""
    far = (miles > fixed.FAR_MILES).cast("int")
    return far, ((miles > fixed.FAR_MILES) & (miles <= fixed.BAND_MILES)).cast("int")


def zip5(c: Column) -> Column:
    """Leading five digits, null when there are none."""
    found = F.regexp_extract(c.cast("string"), r"^(\d{5})", 1)
    return F.when(found != "", found)


def zip_features(c: Column) -> dict[str, Column]:
    """Area flags and income band (1 high, -1 low, 0 other) from the digits of a postal code."""
    digits = F.substring(F.regexp_replace(c.cast("string"), "[^0-9]", ""), 1, 5)
    code = F.when(F.length(digits) == 5, digits).otherwise("00000")
    area = F.substring(code, 1, 3)
    income = (F.when(code.isin(*fixed.LOW_INCOME_ZIPS), -1).when(code.isin(*fixed.HIGH_INCOME_ZIPS), 1).otherwise(0))
    return {"zip5": code, "is_nyc": area.isin(*fixed.NYC_ZIP3).cast("int"),
            "is_manhattan": area.isin(*fixed.MANHATTAN_ZIP3).cast("int"), "zip_inc_band": income}


def distance_bin(miles: Column) -> Column:
    """0..4 by the edges 2, 5, 10 and 25 miles (an edge belongs to the upper bin)."""
    result = F.lit(0)
    for edge in fixed.DISTANCE_BIN_EDGES:
        result = result + (miles >= edge).cast("int")
    return result


# ---- clinical labels ----
def asa_class(c: Column) -> Column:
    return mapped(F.regexp_extract(c.cast("string"), r"ASA\s+(VI|IV|V|III|II|I)\b", 1), fixed.ROMAN,
                  F.lit(None).cast("string"))


def disposition_bucket(c: Column) -> Column:
    """Five groups by substring, tested in this order."""
    s = F.lower(F.coalesce(c.cast("string"), F.lit("nan")))
    return (F.when(s.rlike("ama|against medical"), "AMA").when(s.contains("expired"), "Expired")
            .when(s.rlike("home|self care|hospice/home"), "Home")
            .when(s.rlike("facility|hospital|nursing|rehab|custodial|skilled"), "Facility").otherwise("Other"))


def disposition_group(c: Column) -> Column:
    return mapped(c, fixed.DISPOSITION_GROUPS, "other")


def is_home(c: Column) -> Column:
    return F.coalesce(c.isin(*fixed.HOME_DISPOSITIONS), F.lit(False)).cast("int")


def order_category(group: Column) -> Column:
    """med / lab / imaging / consult / care from 'SOURCE:Group'."""
    body = F.regexp_replace(group, "^[^:]*:", "")
    return (F.when(group.startswith("MED:"), "med").when(contains_any(body, fixed.LAB_WORDS, True), "lab")
            .when(contains_any(body, fixed.IMAGING_WORDS, True), "imaging")
            .when(contains_any(body, fixed.CONSULT_WORDS, True), "consult").otherwise("care"))


def provider_role(c: Column) -> Column:
    return mapped(c, fixed.PROVIDER_ROLES, "other")


def unit_bucket(c: Column) -> Column:
    return mapped(c, fixed.UNIT_BUCKETS, "Other")


# ---- derived features ----
def missing_flags(df: DataFrame, columns: Sequence[str], count_as: str = "lab_count") -> DataFrame:
    """``<c>__present`` per column and the number present; text that is no number counts as missing."""
    flags = {c: number(F.col(f"`{c}`")).isNotNull().cast("int") for c in columns}
    total = sum(flags.values(), F.lit(0))
    return df.select("*", *[f.alias(f"{c}__present") for c, f in flags.items()], total.alias(count_as))


def utilisation_features(ed: Column, admits: Column, age: Column) -> dict[str, Column]:
    """Log, threshold and interaction features of prior visits; unknown age counts as 60."""
    return {"log_ed180": F.log1p(ed), "log_admits365": F.log1p(admits), "ed180_ge2": (ed >= 2).cast("int"),
            "admits365_ge2": (admits >= 2).cast("int"),
            "elderly_x_admits": ((F.coalesce(age, F.lit(60.0)) > 75) & (admits >= 2)).cast("int")}
