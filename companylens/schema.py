"""Column names, layer schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

EMPLOYEES = "employees_latest"
REVENUE = "operating_revenue_latest_k_eur"
REVENUE_PREVIOUS = "operating_revenue_previous_k_eur"
EBITDA = "ebitda_latest_k_eur"
EBITDA_PREVIOUS = "ebitda_previous_k_eur"

SOURCE_SCHEMA = T.StructType(
    [
        T.StructField("record_order", T.LongType(), False),
        T.StructField("company_name", T.StringType(), False),
        T.StructField("website", T.StringType()),
        T.StructField("municipality", T.StringType()),
        T.StructField(EMPLOYEES, T.LongType()),
        T.StructField(REVENUE, T.DoubleType()),
        T.StructField(REVENUE_PREVIOUS, T.DoubleType()),
        T.StructField(EBITDA, T.DoubleType()),
        T.StructField(EBITDA_PREVIOUS, T.DoubleType()),
        T.StructField("shareholder_name", T.StringType()),
    ]
)

SOURCE_COLUMNS = SOURCE_SCHEMA.fieldNames()
TEXT_COLUMNS = ["company_name", "website", "municipality", "shareholder_name"]
INTEGER_COLUMNS = ["record_order", EMPLOYEES]
MONEY_COLUMNS = [REVENUE, REVENUE_PREVIOUS, EBITDA, EBITDA_PREVIOUS]

CLEAN_COLUMNS = [
    "company_name_normalized",
    "legal_status",
    "has_adverse_legal_status",
    "company_match_key",
    "potential_duplicate",
    "potential_duplicate_count",
]

FINANCIAL_COLUMNS = [
    "revenue_growth",
    "revenue_change_k_eur",
    "ebitda_margin",
    "ebitda_change_k_eur",
    "revenue_per_employee_k_eur",
    "ebitda_per_employee_k_eur",
    "has_negative_latest_revenue",
    "has_zero_latest_revenue",
    "has_negative_latest_ebitda",
    "has_revenue_decline",
    "has_extreme_ebitda_margin",
    "has_incomplete_financial_data",
]

QUALITY_COLUMNS = [
    "data_quality_issue_count",
    "business_risk_signal_count",
    "has_data_quality_issue",
    "has_business_risk_signal",
    "data_quality_status",
    "analytical_eligibility",
    "data_quality_reasons",
    "business_risk_reasons",
]

# Flag column -> reason label, in reporting order.
QUALITY_REASONS = {
    "has_incomplete_financial_data": "incomplete_financial_data",
    "has_negative_latest_revenue": "negative_latest_revenue",
    "has_zero_latest_revenue": "zero_latest_revenue",
    "has_extreme_ebitda_margin": "extreme_ebitda_margin",
    "potential_duplicate": "potential_duplicate",
}
RISK_REASONS = {
    "has_adverse_legal_status": "adverse_legal_status",
    "has_negative_latest_ebitda": "negative_latest_ebitda",
    "has_revenue_decline": "revenue_decline",
}

# Legal status markers found in company names.
ADVERSE_STATUSES = ["extinct", "in_liquidation", "in_dissolution"]

# Fixed value: the register's sentence for "no shareholder on file".
NO_SHAREHOLDER_SENTENCE = "There is no shareholders information for this company"

# Default report parameters.
CONCENTRATION_LEVELS = [1, 2, 5, 10, 20, 50, 100]
REVENUE_PERCENTILES = [0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
DEFAULT_RANKING_SIZE = 20
COVERAGE_COLUMNS = [EMPLOYEES, REVENUE, EBITDA, "revenue_growth", "ebitda_margin"]

ANALYTICS_COLUMNS = [
    "company_name",
    "municipality",
    EMPLOYEES,
    REVENUE,
    EBITDA,
    "revenue_growth",
    "ebitda_margin",
    "has_adverse_legal_status",
    "has_negative_latest_ebitda",
    "has_revenue_decline",
    "analytical_eligibility",
]

RANKING_COLUMNS = [
    "company_name",
    "municipality",
    EMPLOYEES,
    REVENUE,
    EBITDA,
    "revenue_growth",
    "ebitda_margin",
    "legal_status",
    "analytical_eligibility",
]

EXPLORER_COLUMNS = [
    "record_order",
    "company_name",
    "municipality",
    EMPLOYEES,
    REVENUE,
    EBITDA,
    "revenue_growth",
    "ebitda_margin",
    "data_quality_status",
    "analytical_eligibility",
    "has_business_risk_signal",
    "data_quality_reasons",
    "business_risk_reasons",
]

MAPPING_COLUMNS = [
    "municipality_original",
    "municipality_match_key",
    "municipality_canonical",
    "review_status",
    "normalization_rule",
    "notes",
]
REVIEW_STATUSES = ["pending", "reviewed", "not_applicable"]

STAGE_NAMES = ("source", "clean", "financial", "quality")
TABLE_NAMES = (
    "scope_comparison",
    "coverage",
    "quality_summary",
    "revenue_concentration",
    "revenue_percentiles",
    "company_ranking",
    "municipality_summary",
)
