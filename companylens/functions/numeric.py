"""Numeric expressions with null as the only missing value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient, or null when a side is missing or the denominator is zero."""
    return F.try_divide(numerator, denominator)


def is_true(condition: Column) -> Column:
    """Condition with missing treated as false."""
    return F.coalesce(condition, F.lit(False))


def total(column: Column) -> Column:
    """Sum that is zero, not null, when every value is missing."""
    return F.coalesce(F.sum(column), F.lit(0))


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit values to a range. Missing stays missing (``greatest`` would not)."""
    result = F.when(column.isNull(), column)
    if low is not None:
        result = result.when(column < low, F.lit(low))
    if high is not None:
        result = result.when(column > high, F.lit(high))
    return result.otherwise(column)


def non_zero(column: Column, message: str) -> Column:
    """Counter that must not be zero; raised while the query runs."""
    return F.when(column == 0, F.raise_error(F.lit(message)).cast("long")).otherwise(column)


def count_true(flags: list[str]) -> Column:
    """Number of set flags in a row."""
    return reduce(lambda a, b: a + b, [F.col(f).cast("long") for f in flags])


def nan_to_null(column: Column) -> Column:
    """NaN and null are the same missing value in the company model."""
    return F.nanvl(column, F.lit(None).cast("double"))


def ten_digits(column: Column) -> Column:
    """Decimal text with up to ten significant digits, rounded half up.

    Plain if the rounded value has an exponent from -4 to 9, else with an exponent of two
    digits or more. Infinities are ``inf`` and ``-inf``; NaN is missing.
    """
    scientific = F.format_string("%.9e", column)
    exponent = F.substring_index(scientific, "e", -1).try_cast("int")
    plain = F.rtrim(scientific.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    return (
        F.when(column.isNull() | F.isnan(column), F.lit(None).cast("string"))
        .when(column == float("inf"), "inf")
        .when(column == float("-inf"), "-inf")
        .when(column == 0, "0")
        .when((exponent < -4) | (exponent > 9), F.regexp_replace(scientific, r"\.?0*e", "e"))
        .otherwise(F.rtrim(plain, F.lit(".")))
    )
