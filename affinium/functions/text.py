"""Scalar column functions: cleaning, parsing and labelling of catalog text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinium import fixed


def na_to_null(value: Column) -> Column:
    """Missing-value tokens become null; the match is exact, so ` N/A` stays."""
    return F.when(~value.isin(fixed.NA_TOKENS), value)


def strip(value: Column) -> Column:
    """Remove Unicode white space at both ends (plain `trim` only knows spaces)."""
    return F.btrim(value, F.lit(fixed.WHITESPACE))


def year_of(value: Column) -> Column:
    """First run of exactly four ASCII digits that is a plausible year."""
    runs = F.regexp_extract_all(value, F.lit("([0-9]+)"), F.lit(1))
    plausible = F.filter(
        runs,
        lambda run: (F.length(run) == 4) & run.between(fixed.YEAR_LOW, fixed.YEAR_HIGH),
    )
    return F.get(plausible, F.lit(0)).cast("double")


def split_list(value: Column) -> Column:
    """Comma list to array: stripped, without blanks and `N/A`; null gives []."""
    items = F.transform(F.split(value, ","), strip)
    kept = F.filter(items, lambda item: (item != "") & (F.upper(item) != fixed.NOT_AVAILABLE))
    return F.coalesce(kept, F.array().cast("array<string>"))


def join_list(values: Column) -> Column:
    return F.array_join(values, ",")


def text_or_missing(value: Column) -> Column:
    return F.coalesce(value, F.lit(fixed.MISSING))


def number_of(value: Column) -> Column:
    """Plain decimal text to double; bad text and overflow become null."""
    trimmed = strip(value)
    number = F.when(trimmed.rlike(fixed.NUMBER_PATTERN), trimmed.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def finite(value: Column) -> Column:
    """Double without NaN and infinities, which count as missing."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def duration_of(value: Column) -> Column:
    """First run of digits: `142 min` gives 142, `1 h 30 m` gives 1."""
    digits = F.regexp_extract(value, "([0-9]+)", 1)
    return finite(F.nullif(digits, F.lit("")).try_cast("double"))


def primary_category(categories: Column) -> Column:
    first = strip(F.get(categories, F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit(fixed.UNKNOWN_CATEGORY))


def display_label(title: Column, year: Column) -> Column:
    return F.when(
        year.isNotNull(), F.concat(title, F.lit(" ("), year.cast("long").cast("string"), F.lit(")"))
    ).otherwise(title)


def shorten(value: Column, limit: int = fixed.DESCRIPTION_LIMIT) -> Column:
    return F.when(
        F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))
    ).otherwise(value)


def page_name(title: Column) -> Column:
    return F.replace(title, F.lit(fixed.FILM_SUFFIX), F.lit(""))


def page_url(title: Column) -> Column:
    """Percent-encode everything but unreserved characters and `/`."""
    encoded = F.url_encode(title)
    for shown, wanted in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(shown), F.lit(wanted))
    return F.concat(F.lit(fixed.PAGE_URL_PREFIX), encoded)


def claim_year(time_text: Column) -> Column:
    """Year of a `+1999-03-31T00:00:00Z` claim; absent gives `N/A`."""
    year = F.regexp_extract(time_text, r"^\+?([0-9]{4})", 1)
    return F.coalesce(F.nullif(year, F.lit("")), F.lit(fixed.NOT_AVAILABLE))


def text_key(model: str, text: Column) -> Column:
    """Content address of one encoded text."""
    return F.md5(F.concat(F.lit(model + "\x00"), text))


def marker_size(score: Column) -> Column:
    return F.lit(8.0) + F.lit(20.0) * score


def marker_alpha(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.05)), F.lit(1.0))


def line_alpha(score: Column) -> Column:
    return F.least(F.greatest(score * F.lit(0.7), F.lit(0.05)), F.lit(1.0))
