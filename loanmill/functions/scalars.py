"""Scalar functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain numbers, infinities and NaN; keeps out Java suffixes such as '1d'.
_NUMBER = r"(?i)\A\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*\z"


def trimmed_lower(x: Column) -> Column:
    """Lower case without surrounding spaces; tabs stay."""
    return F.lower(F.trim(x))


def number_or_null(x: Column) -> Column:
    text = x.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number_or_error(x: Column) -> Column:
    number = number_or_null(x)
    unreadable = F.raise_error(F.concat(F.lit("not a number: "), x.cast("string")))
    return F.when(x.isNotNull() & number.isNull(), unreadable.cast("double")).otherwise(number)


def dti_bucket(ratio: Column) -> Column:
    # Fixed values. Null and NaN fall through to the last class.
    return (
        F.when(ratio <= 0.2, "Low Leverage")
        .when(ratio <= 0.35, "Moderate Leverage")
        .when(ratio <= 0.43, "Medium Risk")
        .when(ratio <= 0.5, "High Risk")
        .otherwise("Very High Risk")
    )


def default_flag(status: Column) -> Column:
    return F.when(status == 1, 1).otherwise(0)


def yes_no(flag: Column) -> Column:
    return F.when(flag == 1, "Yes").otherwise("No")


def whole_years(months: Column) -> Column:
    return F.floor(months / 12).cast("int")


def _whole(x: Column) -> Column:
    return x.try_cast("bigint")


def age_bucket(age: Column) -> Column:
    # Fixed values. Below 18 and unreadable ages fall through to the last class.
    years = _whole(age)
    return (
        F.when(years.between(18, 30), "YOUNG")
        .when(years.between(31, 50), "MIDDLE-AGE")
        .when(years.between(51, 80), "OLD")
        .otherwise("VERY-OLD")
    )


def experience_bucket(months: Column) -> Column:
    # Fixed values. Unreadable values fall through to the last class.
    n = _whole(months)
    return (
        F.when(n <= 24, "FRESH")
        .when(n <= 48, "LOW")
        .when(n <= 96, "MEDIUM")
        .otherwise("HIGH")
    )


def gender_code(x: Column) -> Column:
    word = F.lower(F.regexp_replace(x.cast("string"), r"\A\s+|\s+\z", ""))
    return F.when(word.isin("male", "m"), "M").when(word.isin("female", "f"), "F").otherwise("U")


def decision(prediction: Column) -> Column:
    return F.when(prediction == 0, "Approved").otherwise("Denied")


def round_half_even(x: Column, places: int) -> Column:
    scale = 10.0**places
    return F.rint(x * scale) / scale


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent, two places; null when there is no whole."""
    return round_half_even(F.try_divide(part, whole) * 100, 2)
