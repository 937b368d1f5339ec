"""Financial layer: growth, margins, productivity and sign flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companylens.functions.numeric import is_true, safe_divide
from companylens.schema import (
    EBITDA,
    EBITDA_PREVIOUS,
    EMPLOYEES,
    MONEY_COLUMNS,
    REVENUE,
    REVENUE_PREVIOUS,
)
from companylens.sources.contracts import require_columns


def revenue_growth() -> Column:
    return safe_divide(F.col(REVENUE), F.col(REVENUE_PREVIOUS)) - 1


def ebitda_margin() -> Column:
    return safe_divide(F.col(EBITDA), F.col(REVENUE))


def revenue_per_employee() -> Column:
    return safe_divide(F.col(REVENUE), F.col(EMPLOYEES))


def ebitda_per_employee() -> Column:
    return safe_divide(F.col(EBITDA), F.col(EMPLOYEES))


def add_financial_features(df: DataFrame) -> DataFrame:
    """Clean layer (16 columns) to financial layer (28 columns)."""
    require_columns(df, MONEY_COLUMNS + [EMPLOYEES], "financial features")
    ratios = df.select(
        "*",
        revenue_growth().alias("revenue_growth"),
        (F.col(REVENUE) - F.col(REVENUE_PREVIOUS)).alias("revenue_change_k_eur"),
        ebitda_margin().alias("ebitda_margin"),
        (F.col(EBITDA) - F.col(EBITDA_PREVIOUS)).alias("ebitda_change_k_eur"),
        revenue_per_employee().alias("revenue_per_employee_k_eur"),
        ebitda_per_employee().alias("ebitda_per_employee_k_eur"),
    )
    missing_money = F.lit(False)
    for column in MONEY_COLUMNS:
        missing_money = missing_money | F.col(column).isNull()
    return ratios.select(
        "*",
        is_true(F.col(REVENUE) < 0).alias("has_negative_latest_revenue"),
        is_true(F.col(REVENUE) == 0).alias("has_zero_latest_revenue"),
        is_true(F.col(EBITDA) < 0).alias("has_negative_latest_ebitda"),
        is_true(F.col("revenue_growth") < 0).alias("has_revenue_decline"),
        is_true(F.abs("ebitda_margin") > 1).alias("has_extreme_ebitda_margin"),
        missing_money.alias("has_incomplete_financial_data"),
    )
