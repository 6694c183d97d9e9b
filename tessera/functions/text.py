"""Cleaning of raw string cells. NULL is 'not stated'; MISSING is its printed form."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "[MISSING]"

# Answers that state nothing.
UNSTATED = ("", "missing", "pnts", "ptns", "prefernottosay", "nan", "none")
# Released age-band codes after normalise_code.
AGE_BANDS = {
    "018": "00-19", "019": "00-19", "1619": "00-19", "1819": "00-19", "unter20": "00-19",
    "2029": "20-29", "3029": "30-39", "3039": "30-39", "4049": "40-49", "5059": "50-59",
    "6069": "60-69", "7079": "70-79", "8089": "80-89", "90": "90+", "90+": "90+",
}


def canonical(c: Column) -> Column:
    """Trimmed text, NULL when blank or the printed missing marker."""
    text = F.trim(c.cast("string"))
    return F.when((text == "") | (F.lower(text) == "nan") | (text == MISSING), F.lit(None)).otherwise(text)


def or_missing(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def is_unsafe(c: Column) -> Column:
    """True for blank identifiers and for text that would break the rendered record."""
    return canonical(c).isNull() | c.rlike(r"[\[\]\n\r\x00]")


def normalise_code(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9+]", "")


def literal_map(values: Mapping[str, str]) -> Column:
    flat = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*flat)


def mapped(c: Column, values: Mapping[str, str]) -> Column:
    """Case-insensitive lookup; NULL means the value is not in the vocabulary."""
    folded = {k.strip().lower(): v for k, v in values.items()}
    return F.try_element_at(literal_map(folded), F.lower(F.trim(c)))


def age_decade(number: Column) -> Column:
    low = (F.floor(number / 10) * 10).cast("int")
    return F.when(number.isNotNull(), F.format_string("%02d-%02d", low, low + 9))


def age_band(c: Column) -> Column:
    """Released band code, else an exact age put into its band; NULL when neither. A NULL input is missing."""
    code = normalise_code(c)
    years = F.floor(F.trim(c).try_cast("double"))
    exact = (
        F.when(years.between(0, 19), F.lit("00-19"))
        .when(years.between(20, 89), age_decade(years))
        .when(years.between(90, 120), F.lit("90+"))
    )
    return F.when(c.isNull() | code.isin(*UNSTATED), F.lit(MISSING)).otherwise(
        F.coalesce(F.try_element_at(literal_map(AGE_BANDS), code), exact)
    )


def tri_boolean(c: Column, yes: Iterable[str], no: Iterable[str]) -> Column:
    """YES / NO / NULL. Blank stays NULL: a missing answer is not a negative one."""
    text = F.lower(F.trim(c))
    return F.when(text.isin(*[v.lower() for v in yes]), F.lit("YES")).when(
        text.isin(*[v.lower() for v in no]), F.lit("NO")
    )


def checkbox_union(cols: Iterable[Column], yes: Iterable[str]) -> Column:
    """Check-box group: any ticked box is YES, and an empty group is NO."""
    ticked = [F.coalesce(F.lower(F.trim(c)).isin(*yes), F.lit(False)) for c in cols]
    any_ticked = ticked[0]
    for t in ticked[1:]:
        any_ticked = any_ticked | t
    return F.when(any_ticked, F.lit("YES")).otherwise(F.lit("NO"))


def label_map(c: Column, positive: Iterable[str], negative: Iterable[str]) -> Column:
    """1 / 0, NULL for every other value (the row is then excluded with a reason)."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*[v.lower() for v in positive]), F.lit(1)).when(
        text.isin(*[v.lower() for v in negative]), F.lit(0)
    )


def platform_from_id(uid: Column) -> Column:
    return (
        F.when(uid.contains("202"), F.lit("WEB"))
        .when(F.length(uid) == 10, F.lit("ANDROID"))
        .when(F.length(uid) == 12, F.lit("IOS"))
        .otherwise(F.lit(MISSING))
    )


def platform_from_path(path: Column) -> Column:
    text = F.lower(path)
    return (
        F.when(text.contains("android"), F.lit("ANDROID"))
        .when(text.contains("ios"), F.lit("IOS"))
        .when(text.contains("web"), F.lit("WEB"))
        .otherwise(F.lit(MISSING))
    )


def half_year(c: Column) -> Column:
    """``2021-H1`` from a ``YYYY-MM-DD`` string or a date; NULL when it does not parse."""
    day = F.try_to_date(c.cast("string").substr(1, 10))
    return F.when(
        day.isNotNull(),
        F.concat(F.year(day).cast("string"), F.when(F.month(day) <= 6, F.lit("-H1")).otherwise(F.lit("-H2"))),
    )
