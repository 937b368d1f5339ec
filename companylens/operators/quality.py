"""Quality layer: issue and risk counts, status, eligibility and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companylens.functions.numeric import count_true, non_zero
from companylens.schema import QUALITY_REASONS, RISK_REASONS
from companylens.sources.contracts import require_columns

SUMMARY_FLAGS = [
    *QUALITY_REASONS,
    *RISK_REASONS,
    "has_data_quality_issue",
    "has_business_risk_signal",
]


def data_quality_status(issue_count: Column) -> Column:
    return (
        F.when(issue_count >= 2, "high_priority_review")
        .when(issue_count == 1, "review")
        .otherwise("clean")
    )


def analytical_eligibility() -> Column:
    """Blocking issues first; negative revenue and duplicates only ask for review."""
    blocking = (
        F.col("has_incomplete_financial_data")
        | F.col("has_zero_latest_revenue")
        | F.col("has_extreme_ebitda_margin")
    )
    review = F.col("has_negative_latest_revenue") | F.col("potential_duplicate")
    return (
        F.when(blocking, "not_eligible")
        .when(review, "eligible_with_review")
        .otherwise("eligible")
    )


def combine_reasons(labels: dict[str, str]) -> Column:
    """Labels of set flags joined by ``|``; empty text if none is set."""
    return F.concat_ws("|", *[F.when(F.col(flag), label) for flag, label in labels.items()])


def add_quality_controls(df: DataFrame) -> DataFrame:
    """Financial layer (28 columns) to quality layer (36 columns)."""
    flags = [*QUALITY_REASONS, *RISK_REASONS]
    require_columns(df, flags, "quality control")
    typed = df.withColumns({flag: F.col(flag).cast("boolean") for flag in flags})
    counted = typed.select(
        "*",
        count_true(list(QUALITY_REASONS)).alias("data_quality_issue_count"),
        count_true(list(RISK_REASONS)).alias("business_risk_signal_count"),
    )
    return counted.select(
        "*",
        (F.col("data_quality_issue_count") > 0).alias("has_data_quality_issue"),
        (F.col("business_risk_signal_count") > 0).alias("has_business_risk_signal"),
        data_quality_status(F.col("data_quality_issue_count")).alias("data_quality_status"),
        analytical_eligibility().alias("analytical_eligibility"),
        combine_reasons(QUALITY_REASONS).alias("data_quality_reasons"),
        combine_reasons(RISK_REASONS).alias("business_risk_reasons"),
    )


def create_quality_summary(df: DataFrame) -> DataFrame:
    """Count and share of records per quality or risk indicator, in one pass."""
    require_columns(df, SUMMARY_FLAGS, "quality summary")
    counts = df.agg(
        F.count(F.lit(1)).alias("__total"),
        *[F.count_if(F.col(flag)).alias(flag) for flag in SUMMARY_FLAGS],
    )
    return counts.unpivot("__total", SUMMARY_FLAGS, "indicator", "record_count").select(
        "indicator",
        "record_count",
        (
            F.col("record_count")
            / non_zero(F.col("__total"), "Cannot summarize quality without records.")
        ).alias("record_percentage"),
    )


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Record counts of several category columns, in one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("variable", "category")
        .agg(F.count(F.lit(1)).alias("record_count"))
        .orderBy("variable", F.desc("record_count"), F.asc_nulls_last("category"))
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Record count per category, most frequent first. Missing is a category."""
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("record_count"))
        .orderBy(F.desc("record_count"), F.asc_nulls_last(column))
    )
