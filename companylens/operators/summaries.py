"""Aggregated tables: overview, coverage, concentration, percentiles, places, KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from companylens.functions.numeric import non_zero, safe_divide, total
from companylens.operators.distributed import merge_single_rows
from companylens.operators.filters import SCOPES, filter_analytical_scope, scope_condition
from companylens.operators.quantiles import exact_medians, exact_quantiles
from companylens.schema import (
    ANALYTICS_COLUMNS,
    CONCENTRATION_LEVELS,
    EBITDA,
    EMPLOYEES,
    REVENUE,
    REVENUE_PERCENTILES,
)
from companylens.sources.contracts import positive_int, probability, require_columns

OVERVIEW_MEDIANS = {
    "median_employees": EMPLOYEES,
    "median_revenue_k_eur": REVENUE,
    "median_ebitda_k_eur": EBITDA,
    "median_revenue_growth": "revenue_growth",
    "median_ebitda_margin": "ebitda_margin",
}


def _overview(df: DataFrame, scopes: list[str]) -> DataFrame:
    """Overview rows for several overlapping scopes.

    Records are summed up and counted by the set of scopes they belong to; only these sums
    are folded into the scopes. One marker row keeps an empty scope visible, so that it
    fails instead of going missing.
    """
    require_columns(df, ANALYTICS_COLUMNS, "analytics")
    values = sorted(set(OVERVIEW_MEDIANS.values()))
    flags = ["has_negative_latest_ebitda", "has_revenue_decline"]
    member_of = F.array_compact(F.array(*[F.when(scope_condition(s), F.lit(s)) for s in scopes]))
    scoped = df.select(member_of.alias("scopes"), *values, *flags)
    sums = scoped.groupBy("scopes").agg(
        F.count(F.lit(1)).alias("company_count"),
        F.sum(EMPLOYEES).alias("employee_count"),
        F.count(REVENUE).alias("revenue_available_count"),
        F.count(EBITDA).alias("ebitda_available_count"),
        F.sum(REVENUE).alias("revenue_total_k_eur"),
        F.sum(EBITDA).alias("ebitda_total_k_eur"),
        F.count_if(F.col(flags[0])).alias("negative_ebitda_count"),
        F.count_if(F.col(flags[1])).alias("revenue_decline_count"),
    )
    marker = df.sparkSession.range(1).select(F.array(*[F.lit(s) for s in scopes]).alias("scopes"))
    measures = [c for c in sums.columns if c != "scopes"]
    totals = {c: F.sum(c) for c in measures}
    for c in measures:
        if c.endswith("_count"):
            totals[c] = F.coalesce(totals[c], F.lit(0))
    counts = (
        sums.unionByName(marker, allowMissingColumns=True)
        .select(F.explode("scopes").alias("scope"), *measures)
        .groupBy("scope")
        .agg(*[column.alias(c) for c, column in totals.items()])
    )
    medians = exact_medians(scoped, OVERVIEW_MEDIANS, ["scope"], few_groups=True, members="scopes")
    checked = F.when(
        F.col("company_count") == 0,
        F.raise_error(F.concat(F.lit("Analytical scope without records: "), F.col("scope"))),
    ).otherwise(F.col("company_count"))
    # At most one row per scope on both sides.
    return (
        counts.join(F.broadcast(medians), "scope", "left")
        .select(
            "scope",
            checked.cast("long").alias("company_count"),
            "employee_count",
            "revenue_available_count",
            "ebitda_available_count",
            "revenue_total_k_eur",
            "ebitda_total_k_eur",
            *OVERVIEW_MEDIANS,
            "negative_ebitda_count",
            "revenue_decline_count",
        )
        .orderBy("scope")
    )


def create_overview_summary(df: DataFrame, scope: str = "all") -> DataFrame:
    """One-row financial overview of a scope; an empty scope is an error."""
    scope_condition(scope)
    return _overview(df, [scope])


def create_scope_comparison(df: DataFrame) -> DataFrame:
    """Overview of all four overlapping scopes, alphabetically."""
    return _overview(df, SCOPES)


def calculate_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Available and missing values per column, in one pass and the given order."""
    require_columns(df, columns, "coverage")
    counts = df.agg(
        F.count(F.lit(1)).alias("__total"),
        *[F.count(F.col(c)).alias(c) for c in dict.fromkeys(columns)],
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).alias("available")) for c in columns]
    )
    total_rows = non_zero(F.col("__total"), "Cannot calculate coverage without records.")
    return counts.select(total_rows.alias("__total"), F.inline(rows)).select(
        "variable",
        F.col("available").alias("available_records"),
        (F.col("__total") - F.col("available")).alias("missing_records"),
        (F.col("available") / F.col("__total")).alias("coverage_rate"),
    )


def calculate_revenue_concentration(
    df: DataFrame,
    top_levels: Sequence[int] = CONCENTRATION_LEVELS,
    scope: str = "all",
) -> DataFrame:
    """Revenue held by the N largest companies, per requested N.

    Only the largest ``max(top_levels)`` values are ordered; the total comes
    from one aggregation. Levels keep their order and may repeat.
    """
    levels = [positive_int(n, "Concentration level") for n in top_levels]
    revenue = filter_analytical_scope(df, scope).select(REVENUE).dropna()
    top = revenue.orderBy(F.desc(REVENUE)).limit(max(levels))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(REVENUE))))
    largest = ranked.agg(
        *[
            F.sum(F.when(F.col("rank") <= n, F.col(REVENUE))).alias(f"top_{n}")
            for n in sorted(set(levels))
        ]
    )
    totals = revenue.agg(
        F.count(F.lit(1)).alias("available"), F.sum(REVENUE).alias("total_revenue")
    )
    row = merge_single_rows(largest, totals)
    checked = (
        F.when(
            F.col("available") == 0,
            F.raise_error(F.lit("Concentration needs a company with revenue.")),
        )
        .when(
            F.col("total_revenue") == 0,
            F.raise_error(F.lit("Concentration is undefined: revenue adds up to zero.")),
        )
        .otherwise(F.col("total_revenue"))
    )
    return row.select(
        checked.alias("checked_total"),
        "available",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).cast("long").alias("top_n"),
                        F.col(f"top_{n}").alias("revenue_k_eur"),
                    )
                    for n in levels
                ]
            )
        ),
    ).select(
        F.lit(scope).alias("scope"),
        "top_n",
        F.least("top_n", "available").alias("companies_included"),
        "revenue_k_eur",
        (F.col("revenue_k_eur") / F.col("checked_total")).alias("concentration_rate"),
    )


def column_percentiles(
    df: DataFrame, column: str, percentiles: Sequence[float], value_name: str
) -> DataFrame:
    """Exact percentiles of one numeric column as ``percentile, value`` rows."""
    levels = [probability(p, "Percentile") for p in percentiles]
    # At most one row; the aggregate also notices when there is none.
    found = exact_quantiles(df, [column], levels).agg(F.first("quantiles").alias("quantiles"))
    checked = F.when(
        F.col("quantiles").isNull(),
        F.raise_error(F.lit(f"Cannot calculate percentiles without values of {column}.")).cast(
            "array<double>"
        ),
    ).otherwise(F.col("quantiles"))
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in levels]), checked)
    return found.select(F.inline(pairs)).toDF("percentile", value_name)


def calculate_revenue_percentiles(
    df: DataFrame,
    percentiles: Sequence[float] = REVENUE_PERCENTILES,
    scope: str = "all",
) -> DataFrame:
    """Exact, linearly interpolated revenue percentiles of a scope."""
    scoped = filter_analytical_scope(df, scope)
    rows = column_percentiles(scoped, REVENUE, percentiles, "revenue_k_eur")
    return rows.select(F.lit(scope).alias("scope"), "percentile", "revenue_k_eur")


PLACE_MEDIANS = {"median_revenue_k_eur": REVENUE, "median_ebitda_margin": "ebitda_margin"}


def _place_sums(df: DataFrame, place: str) -> DataFrame:
    return df.groupBy(place).agg(
        F.count(F.lit(1)).alias("company_count"),
        total(F.col(EMPLOYEES)).alias("employee_count"),
        total(F.col(REVENUE)).alias("revenue_total_k_eur"),
        total(F.col(EBITDA)).alias("ebitda_total_k_eur"),
        F.count_if(F.col("has_adverse_legal_status")).alias("adverse_status_count"),
        F.count_if(F.col("has_negative_latest_ebitda")).alias("negative_ebitda_count"),
    )


def _with_medians(sums: DataFrame, medians: DataFrame, place: str) -> DataFrame:
    medians = medians.withColumnRenamed(place, "__place")
    companies = F.col("company_count")
    return sums.join(medians, sums[place].eqNullSafe(medians["__place"]), "left").select(
        place,
        "company_count",
        "employee_count",
        "revenue_total_k_eur",
        "ebitda_total_k_eur",
        *PLACE_MEDIANS,
        "adverse_status_count",
        "negative_ebitda_count",
        (F.col("adverse_status_count") / companies).alias("adverse_status_rate"),
        (F.col("negative_ebitda_count") / companies).alias("negative_ebitda_rate"),
    )


def summarize_places(df: DataFrame, place: str) -> DataFrame:
    """Companies, jobs, revenue and EBITDA per place label, missing label included."""
    table = _with_medians(_place_sums(df, place), exact_medians(df, PLACE_MEDIANS, [place]), place)
    return table.orderBy(F.desc("revenue_total_k_eur"), F.asc_nulls_last(place))


def summarize_top_places(df: DataFrame, place: str, top_n: int = 10) -> DataFrame:
    """The rows of ``summarize_places`` with a label and the largest revenue, largest first.

    Sums decide which they are; medians are then found for the records of these places only.
    """
    order = [F.desc("revenue_total_k_eur"), F.asc(place)]
    sums = _place_sums(df, place).dropna(subset=[place, "revenue_total_k_eur"])
    top = sums.orderBy(*order).limit(positive_int(top_n, "Number of places"))
    # At most ``top_n`` rows.
    inside = df.join(F.broadcast(top.select(place)), place, "left_semi")
    medians = exact_medians(inside, PLACE_MEDIANS, [place], few_groups=True)
    return _with_medians(top, F.broadcast(medians), place).orderBy(*order)


def create_municipality_summary(df: DataFrame, scope: str = "all") -> DataFrame:
    """Place summary by raw municipality label, largest revenue first."""
    return summarize_places(filter_analytical_scope(df, scope), "municipality")


def leading_municipality(df: DataFrame) -> DataFrame:
    """Most frequent municipality and its share of all records; one row."""
    leader = (
        df.where("municipality is not null")
        .groupBy("municipality")
        .agg(F.count(F.lit(1)).alias("leading_count"))
        .orderBy(F.desc("leading_count"), "municipality")
        .limit(1)
    )
    row = merge_single_rows(leader, df.agg(F.count(F.lit(1)).alias("companies")))
    return row.select(
        F.coalesce("municipality", F.lit("N/A")).alias("leading_municipality"),
        F.coalesce(safe_divide(F.col("leading_count"), F.col("companies")), F.lit(0.0)).alias(
            "leading_share"
        ),
    )


def compute_kpi_metrics(df: DataFrame) -> DataFrame:
    """One row of headline measures; missing values and empty input give zeros."""
    flags = [
        c if c in df.columns else None
        for c in ("has_data_quality_issue", "has_business_risk_signal")
    ]
    issues, signals = [
        F.count_if(F.col(c)) if c else F.lit(0).cast("long") for c in flags
    ]
    eligible = (
        F.count_if(F.col("analytical_eligibility") == "eligible")
        if "analytical_eligibility" in df.columns
        else F.lit(0).cast("long")
    )
    sums = df.agg(
        F.count(F.lit(1)).alias("total_companies"),
        F.sum(REVENUE).alias("total_revenue_k_eur"),
        F.sum(EBITDA).alias("total_ebitda_k_eur"),
        total(F.col(EMPLOYEES)).alias("total_employees"),
        issues.alias("issues"),
        signals.alias("signals"),
        eligible.alias("eligible_companies"),
    )
    medians = exact_medians(
        df, {"median_revenue_k_eur": REVENUE, "median_ebitda_margin": "ebitda_margin"}
    )
    row = merge_single_rows(sums, medians)

    def or_zero(name: str):
        return F.coalesce(F.col(name), F.lit(0.0)).alias(name)

    def rate(counter: str):
        return F.coalesce(
            safe_divide(F.col(counter), F.col("total_companies")), F.lit(0.0)
        )

    return row.select(
        "total_companies",
        or_zero("total_revenue_k_eur"),
        or_zero("median_revenue_k_eur"),
        or_zero("total_ebitda_k_eur"),
        or_zero("median_ebitda_margin"),
        "total_employees",
        rate("issues").alias("data_quality_issue_rate"),
        rate("signals").alias("business_risk_signal_rate"),
        "eligible_companies",
    )
