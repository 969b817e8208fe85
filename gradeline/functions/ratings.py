"""Column functions on codes and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column, default: str | None = None) -> Column:
    """Trimmed text, null if nothing is left; the default instead where one is given."""
    found = F.nullif(F.trim(c), F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def strict_digit(c: Column) -> Column:
    """0 to 9 if the trimmed text is exactly one digit, else null."""
    return F.when(F.trim(c).rlike("^[0-9]$"), F.trim(c).cast("tinyint"))


def lowest(*ratings: Column) -> Column:
    """The least rating, nulls left aside."""
    return F.least(*ratings)


def condition_class(rating: Column) -> Column:
    return F.when(rating.isNull(), "Unknown").when(rating >= 7, "Good").when(rating >= 5, "Fair").otherwise("Poor")


def guarded_pad(c: Column, width: int) -> Column:
    """Zero-padded on the left if shorter than width; longer text stays whole; blank is null."""
    text = blank_to_null(c)
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def composite_key(parts: list[tuple[Column, int]]) -> Column:
    """The padded parts joined; null if one is blank or longer than its width."""
    padded = [guarded_pad(c, n) for c, n in parts]
    fits = [F.length(p) <= n for p, (_, n) in zip(padded, parts, strict=True)]
    good = fits[0]
    for f in fits[1:]:
        good = good & f
    return F.when(good, F.concat(*padded))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent, half to even; null if the whole is 0."""
    return F.bround(F.try_divide(F.lit(100.0).cast("double") * part, whole), digits)


def decode_dms(lat: Column, lon: Column) -> dict[str, Column]:
    """`lat`, `lon` in degrees and `fault` from DDMMSSss and DDDMMSSss text; longitude is published west-positive.

    Dots go; blank text, text with other characters or of more than 64 bits is missing_or_zero, then too long is malformed,
    then all zero is missing_or_zero; minutes or seconds of 60 or more, or whole degrees beyond 90 or 180, are out_of_range.
    The latitude's fault comes first.
    """

    def one(c: Column, width: int, limit: int) -> tuple[Column, Column]:
        raw = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("."), F.lit(""))
        number = F.when(raw.rlike("^[0-9]+$"), F.regexp_replace(raw, "^0+(?=.)", "").try_cast("decimal(38,0)"))
        digits = F.lpad(raw, width, "0")
        deg = F.substring(digits, 1, width - 6).try_cast("int")
        minutes, seconds = F.substring(digits, width - 5, 2).try_cast("int"), F.substring(digits, width - 3, 4).try_cast("int") / F.lit(100.0)
        value = deg + minutes / F.lit(60.0) + seconds / F.lit(3600.0)
        absent = F.coalesce(number > F.lit("18446744073709551615").cast("decimal(38,0)"), F.lit(True))
        fault = F.when(absent, "missing_or_zero").when(F.length(raw) > width, "malformed").when(number == 0, "missing_or_zero").when((minutes >= 60) | (seconds >= 60) | (deg > limit), "out_of_range")
        return value, fault

    a, fa = one(lat, 8, 90)
    b, fb = one(lon, 9, 180)
    fault = F.coalesce(fa, fb)
    return {"lat": F.when(fault.isNull(), a), "lon": F.when(fault.isNull(), -b), "fault": fault}


def series_wellformed(c: Column, span: Column) -> Column:
    """Rated or unrated at both ends, of the span's length, of the alphabet only."""
    return c.rlike("^[0-9U]([0-9U.]*[0-9U])?$") & (F.length(c) == span)


def observed_years(c: Column) -> Column:
    return F.length(F.replace(c, F.lit("."), F.lit("")))
