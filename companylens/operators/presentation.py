"""Datasets behind the charts, and the written briefing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companylens.functions.numeric import clip, is_true, safe_divide
from companylens.functions.text import percent_label, percentile_label, thousands_label
from companylens.operators.distributed import merge_single_rows
from companylens.operators.summaries import compute_kpi_metrics, leading_municipality
from companylens.schema import EBITDA, EMPLOYEES, REVENUE

# One line each; %s are filled in order. Title and the word "Takeaways" are fixed values.
BRIEFING_LINES = [
    "### 🏛️ Executive Intelligence Briefing",
    "",
    "The selection holds **%s** companies. Together they report **%s** of revenue and **%s** of EBITDA, with **%s** employees.",
    "",
    "#### Size and profitability",
    "- Half of the companies with a figure have revenue of **%s** or more.",
    "- The median EBITDA margin is **%s**.",
    "- **%s** of **%s** companies (**%s**) are eligible for analysis without a review.",
    "",
    "#### Data quality and risk",
    "- **%s** of the records have a data-quality issue: missing figures, zero revenue, implausible margins or possible duplicates.",
    "- **%s** carry a business-risk signal: negative EBITDA, falling revenue or an adverse legal marker.",
    "- Most companies of one place are in **%s**: **%s** of all.",
    "",
    "#### Takeaways",
    "> Look at records marked high_priority_review or not_eligible first, before any figure is used. Eligible companies that grow are the starting point for a closer analysis.",
]
EMPTY_BRIEFING = "The filters leave no company, so there is nothing to report."


def concentration_curve(concentration: DataFrame) -> DataFrame:
    """Cumulative share per level, with the two points of the equal-share line."""
    curve = concentration.select(
        F.lit("cumulative_share").alias("series"),
        F.col("top_n"),
        (F.col("concentration_rate") * 100).alias("share_pct"),
    )
    largest = concentration.agg(F.max("top_n").alias("largest"))
    baseline = largest.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("equal_share").alias("series"),
                    F.lit(1).cast("long").alias("top_n"),
                    (F.lit(1) / F.col("largest") * 100).alias("share_pct"),
                ),
                F.struct(
                    F.lit("equal_share").alias("series"),
                    F.col("largest").alias("top_n"),
                    F.lit(100.0).alias("share_pct"),
                ),
            )
        )
    )
    return curve.unionByName(baseline)


def positioning(df: DataFrame) -> DataFrame:
    """Revenue against margin, with display margin, marker size and cohort."""
    cohort = (
        F.when(is_true(F.col("has_business_risk_signal")), "Business Risk Signal")
        .when(is_true(F.col("has_data_quality_issue")), "Data Quality Review")
        .otherwise("Prime Eligible")
    )
    return df.dropna(subset=[REVENUE, "ebitda_margin"]).select(
        "record_order",
        "company_name",
        "municipality",
        REVENUE,
        EBITDA,
        "ebitda_margin",
        EMPLOYEES,
        (clip(F.col("ebitda_margin"), -0.5, 0.5) * 100).alias("display_margin"),
        clip(F.coalesce(EMPLOYEES, F.lit(10)), 5, 500).cast("long").alias("size_scaled"),
        cohort.alias("cohort"),
    )


def treemap(df: DataFrame) -> DataFrame:
    """Municipality and company areas; colour is the area-weighted margin."""
    valid = df.dropna(subset=["municipality", "company_name", REVENUE]).select(
        "municipality",
        "company_name",
        clip(F.col(REVENUE), low=1.0).alias("area"),
        clip(F.coalesce("ebitda_margin", F.lit(0.0)) * 100, -20.0, 40.0).alias("margin_pct"),
    )
    place, company = F.col("municipality"), F.col("company_name")
    return valid.groupingSets([[place, company], [place]], place, company).agg(
        F.when(F.grouping(company) == 1, "municipality").otherwise("company").alias("level"),
        F.sum("area").alias("area_k_eur"),
        safe_divide(F.sum(F.col("area") * F.col("margin_pct")), F.sum("area")).alias(
            "ebitda_margin_pct"
        ),
    )


def percentile_chart(percentiles: DataFrame) -> DataFrame:
    """Percentile table with display labels, in percentile order."""
    return percentiles.select(
        percentile_label(F.col("percentile")).alias("label"), "percentile", "revenue_k_eur"
    ).orderBy("percentile")


def coverage_chart(coverage: DataFrame) -> DataFrame:
    """Coverage table, least covered variable first."""
    return coverage.orderBy("coverage_rate", "variable")


def executive_briefing(df: DataFrame) -> DataFrame:
    """Headline measures, leading municipality and the rendered briefing; one row."""
    row = merge_single_rows(compute_kpi_metrics(df), leading_municipality(df))

    def count(name: str):
        return F.format_string("%,d", F.col(name))

    eligible_share = F.coalesce(
        safe_divide(F.col("eligible_companies"), F.col("total_companies")), F.lit(0.0)
    )
    filled = [
        count("total_companies"),
        thousands_label(F.col("total_revenue_k_eur")),
        thousands_label(F.col("total_ebitda_k_eur")),
        count("total_employees"),
        thousands_label(F.col("median_revenue_k_eur")),
        percent_label(F.col("median_ebitda_margin")),
        F.col("eligible_companies").cast("string"),
        F.col("total_companies").cast("string"),
        percent_label(eligible_share),
        percent_label(F.col("data_quality_issue_rate")),
        percent_label(F.col("business_risk_signal_rate")),
        F.col("leading_municipality"),
        percent_label(F.col("leading_share")),
    ]
    briefing = F.when(F.col("total_companies") == 0, EMPTY_BRIEFING).otherwise(
        F.format_string("\n".join(BRIEFING_LINES), *filled)
    )
    return row.withColumn("briefing", briefing)
