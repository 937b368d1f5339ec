"""Scopes, faceted filters, projections and look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companylens.functions.numeric import is_true
from companylens.schema import ANALYTICS_COLUMNS, EMPLOYEES, EXPLORER_COLUMNS, REVENUE
from companylens.sources.contracts import ContractError, require_columns

SCOPES = ["all", "eligible", "no_adverse_eligible", "no_adverse_marker"]
RISK_FILTERS = ["All", "Risk Signals Only", "No Risk Signals"]


def scope_condition(scope: str) -> Column:
    """Membership of a record in an analytical scope."""
    if scope not in SCOPES:
        raise ContractError(f"Unknown scope {scope!r}; known are {SCOPES}")
    no_marker = ~is_true(F.col("has_adverse_legal_status"))
    eligible = is_true(F.col("analytical_eligibility") == "eligible")
    return {
        "all": F.lit(True),
        "no_adverse_marker": no_marker,
        "eligible": eligible,
        "no_adverse_eligible": no_marker & eligible,
    }[scope]


def filter_analytical_scope(df: DataFrame, scope: str = "all") -> DataFrame:
    """Records of one analytical scope."""
    condition = scope_condition(scope)
    require_columns(df, ANALYTICS_COLUMNS, "analytics")
    return df if scope == "all" else df.where(condition)


def filter_companies(
    df: DataFrame,
    scope: str = "all",
    municipalities: Sequence[str] | None = None,
    min_revenue: float | None = None,
    max_revenue: float | None = None,
    min_employees: int | None = None,
    max_employees: int | None = None,
    quality_statuses: Sequence[str] | None = None,
    risk_filter: str = "All",
) -> DataFrame:
    """Faceted filter. Ranges keep records without a value; empty lists do not filter."""
    if risk_filter not in RISK_FILTERS:
        raise ContractError(f"Unknown risk filter {risk_filter!r}; known are {RISK_FILTERS}")
    filtered = filter_analytical_scope(df, scope)
    if municipalities:
        filtered = filtered.where(F.col("municipality").isin(list(municipalities)))
    for column, low, high in (
        (REVENUE, min_revenue, max_revenue),
        (EMPLOYEES, min_employees, max_employees),
    ):
        if low is not None:
            filtered = filtered.where(F.col(column).isNull() | (F.col(column) >= low))
        if high is not None:
            filtered = filtered.where(F.col(column).isNull() | (F.col(column) <= high))
    if quality_statuses:
        filtered = filtered.where(F.col("data_quality_status").isin(list(quality_statuses)))
    if risk_filter == "Risk Signals Only":
        filtered = filtered.where(F.col("has_business_risk_signal"))
    elif risk_filter == "No Risk Signals":
        filtered = filtered.where(~F.col("has_business_risk_signal"))
    return filtered


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, without the missing one."""
    return df.select(column).dropna().distinct().orderBy(column)


def project_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the requested columns that exist, in the requested order."""
    return df.select([c for c in columns if c in df.columns])


def explorer_view(df: DataFrame) -> DataFrame:
    """Columns of the company explorer."""
    return project_present(df, EXPLORER_COLUMNS)


def find_company(df: DataFrame, name: str) -> DataFrame:
    """First record, in source order, with the given company name."""
    return df.where(F.col("company_name") == name).orderBy("record_order").limit(1)
