"""Analytical tables against plain pandas over the same company rows."""

import numpy as np
import pandas as pd
import pytest

from companylens.operators import filters, rankings, summaries
from companylens.schema import COVERAGE_COLUMNS, EBITDA, EMPLOYEES, REVENUE
from companylens.sources.contracts import ContractError

MASKS = {
    "all": lambda d: d.index == d.index,
    "eligible": lambda d: d.analytical_eligibility == "eligible",
    "no_adverse_marker": lambda d: ~d.has_adverse_legal_status,
    "no_adverse_eligible": lambda d: ~d.has_adverse_legal_status
    & (d.analytical_eligibility == "eligible"),
}


def same(actual, expected):
    if actual is None:
        assert pd.isna(expected)
    else:
        assert actual == pytest.approx(expected, rel=1e-12)


@pytest.mark.parametrize("scope", sorted(MASKS))
def test_scopes(quality, quality_pandas, scope):
    kept = {r.record_order for r in filters.filter_analytical_scope(quality, scope).collect()}
    assert kept == set(quality_pandas[MASKS[scope](quality_pandas)].record_order)


def test_unknown_scope(quality):
    with pytest.raises(ContractError, match="Unknown scope"):
        filters.filter_analytical_scope(quality, "active")


def check_overview(row, data):
    assert row.company_count == len(data)
    assert row.employee_count == data[EMPLOYEES].sum()
    assert row.revenue_available_count == data[REVENUE].notna().sum()
    same(row.revenue_total_k_eur, data[REVENUE].sum(min_count=1))
    same(row.ebitda_total_k_eur, data[EBITDA].sum(min_count=1))
    same(row.median_employees, data[EMPLOYEES].median())
    same(row.median_revenue_k_eur, data[REVENUE].median())
    same(row.median_revenue_growth, data["revenue_growth"].median())
    same(row.median_ebitda_margin, data["ebitda_margin"].median())
    assert row.negative_ebitda_count == data.has_negative_latest_ebitda.sum()
    assert row.revenue_decline_count == data.has_revenue_decline.sum()


def test_scope_comparison(quality, quality_pandas):
    rows = summaries.create_scope_comparison(quality).collect()
    assert [r.scope for r in rows] == sorted(MASKS)
    for row in rows:
        check_overview(row, quality_pandas[MASKS[row.scope](quality_pandas)])


def test_overview_totals_are_missing_not_zero(quality):
    row = summaries.create_overview_summary(quality.where("record_order = 4")).first()
    assert (row.revenue_total_k_eur, row.median_revenue_k_eur, row.employee_count) == (None, None, 4)


def test_empty_scope_fails(quality):
    with pytest.raises(Exception, match="Analytical scope without records: eligible"):
        summaries.create_overview_summary(quality.where("record_order = 4"), "eligible").collect()


def test_coverage(quality, quality_pandas):
    columns = COVERAGE_COLUMNS + ["website", "website"]
    rows = summaries.calculate_coverage(quality, columns).collect()
    assert [r.variable for r in rows] == columns
    for r in rows:
        available = quality_pandas[r.variable].notna().sum()
        assert (r.available_records, r.missing_records) == (available, 10 - available)
        assert r.coverage_rate == available / 10
    with pytest.raises(ContractError, match="nowhere"):
        summaries.calculate_coverage(quality, ["nowhere"])
    with pytest.raises(Exception, match="without records"):
        summaries.calculate_coverage(quality.where("false"), columns).collect()


def test_concentration(quality, quality_pandas):
    levels = [5, 1, 100, 5]
    rows = summaries.calculate_revenue_concentration(quality, levels).collect()
    revenue = quality_pandas[REVENUE].dropna().sort_values(ascending=False)
    assert [r.top_n for r in rows] == levels
    for r in rows:
        assert r.companies_included == min(r.top_n, len(revenue))
        same(r.revenue_k_eur, revenue.iloc[: r.top_n].sum())
        same(r.concentration_rate, revenue.iloc[: r.top_n].sum() / revenue.sum())


def test_concentration_errors(quality):
    for levels in ([0], [True], [1.5]):
        with pytest.raises(ContractError):
            summaries.calculate_revenue_concentration(quality, levels)
    with pytest.raises(Exception, match="needs a company with revenue"):
        summaries.calculate_revenue_concentration(quality.where("record_order = 4")).collect()
    with pytest.raises(Exception, match="adds up to zero"):
        summaries.calculate_revenue_concentration(quality.where("record_order = 3")).collect()


def test_percentiles(quality, quality_pandas):
    levels = [0.9, 0, 0.25, 1, 0.25]
    rows = summaries.calculate_revenue_percentiles(quality, levels).collect()
    assert [r.percentile for r in rows] == levels
    expected = np.quantile(quality_pandas[REVENUE].dropna(), levels)
    assert [r.revenue_k_eur for r in rows] == pytest.approx(expected)
    with pytest.raises(ContractError):
        summaries.calculate_revenue_percentiles(quality, [1.2])
    with pytest.raises(Exception, match="without values"):
        summaries.calculate_revenue_percentiles(quality.where("record_order = 4")).collect()


def test_municipality_summary(quality, quality_pandas):
    rows = {r.municipality: r for r in summaries.create_municipality_summary(quality).collect()}
    groups = quality_pandas.groupby("municipality", dropna=False)
    assert len(rows) == groups.ngroups
    for place, data in groups:
        row = rows[None if pd.isna(place) else place]
        assert row.company_count == len(data)
        assert row.employee_count == data[EMPLOYEES].sum()
        same(row.revenue_total_k_eur, data[REVENUE].sum())
        same(row.ebitda_total_k_eur, data[EBITDA].sum())
        same(row.median_revenue_k_eur, data[REVENUE].median())
        same(row.median_ebitda_margin, data["ebitda_margin"].median())
        assert row.adverse_status_rate == data.has_adverse_legal_status.mean()
        assert row.negative_ebitda_rate == data.has_negative_latest_ebitda.mean()
    totals = [r.revenue_total_k_eur for r in summaries.create_municipality_summary(quality).collect()]
    assert totals == sorted(totals, reverse=True)


def test_kpis(quality, quality_pandas):
    row = summaries.compute_kpi_metrics(quality).first()
    assert row.total_companies == 10
    same(row.total_revenue_k_eur, quality_pandas[REVENUE].sum())
    same(row.median_revenue_k_eur, quality_pandas[REVENUE].median())
    same(row.median_ebitda_margin, quality_pandas["ebitda_margin"].median())
    assert row.data_quality_issue_rate == quality_pandas.has_data_quality_issue.mean()
    assert row.eligible_companies == (quality_pandas.analytical_eligibility == "eligible").sum()
    assert list(summaries.compute_kpi_metrics(quality.where("false")).first()) == [0] * 9


def test_leading_municipality(quality):
    # "Onda" and "ONDA" are different raw labels; "ONDA" and "Nules" tie.
    row = summaries.leading_municipality(quality).first()
    assert tuple(row) == ("Nules", 0.2)
    assert tuple(summaries.leading_municipality(quality.where("false")).first()) == ("N/A", 0.0)


def test_ranking_keeps_source_order_of_ties(spark, quality):
    rows = [(1, 5.0), (2, 7.0), (3, 7.0), (4, 5.0), (5, None)]
    df = quality.drop(REVENUE).join(
        spark.createDataFrame(rows, f"record_order long, {REVENUE} double"), "record_order"
    )
    names = {r.record_order: r.company_name for r in df.collect()}
    down = [r.company_name for r in rankings.create_company_ranking(df).collect()]
    up = [r.company_name for r in rankings.create_company_ranking(df, ascending=True).collect()]
    assert down == [names[i] for i in (2, 3, 1, 4)]
    assert up == [names[i] for i in (1, 4, 2, 3)]
    top = rankings.create_company_ranking(df, top_n=2).collect()
    assert [r["rank"] for r in top] == [1, 2]


def test_ranking_by_flag_and_errors(quality):
    ranking = rankings.create_company_ranking(quality, "has_revenue_decline", 3)
    assert ranking.count() == 3 and "has_revenue_decline" not in ranking.columns
    with pytest.raises(ContractError, match="No such column"):
        rankings.create_company_ranking(quality, "nowhere")
    with pytest.raises(ContractError, match="Only numbers"):
        rankings.create_company_ranking(quality, "company_name")
    with pytest.raises(ContractError, match="positive"):
        rankings.create_company_ranking(quality, top_n=0)


def test_leaderboard_and_top_places(quality):
    ranking = rankings.create_company_ranking(quality)
    board = rankings.leaderboard(ranking, 3).collect()
    assert [r["rank"] for r in board] == [3, 2, 1]
    summary = summaries.create_municipality_summary(quality)
    top = rankings.municipality_top_n(summary, 2).collect()
    assert [r.municipality for r in top] == ["Peñíscola/Peniscola", "ONDA"]


def test_faceted_filter(quality, quality_pandas):
    def kept(**options):
        return {r.record_order for r in filters.filter_companies(quality, **options).collect()}

    everyone = set(quality_pandas.record_order)
    assert kept() == kept(municipalities=[], quality_statuses=[]) == everyone
    assert kept(min_revenue=100) == {1, 4, 6, 7, 8}
    assert kept(max_revenue=0) == {3, 4, 5}
    assert kept(min_employees=10) == {1, 6, 7}
    assert kept(max_employees=2) == {3, 5, 6}
    assert kept(municipalities=["ONDA", "Nules"]) == {2, 3, 8, 9}
    assert kept(quality_statuses=["clean"]) == set(
        quality_pandas[quality_pandas.data_quality_status == "clean"].record_order
    )
    risky = kept(risk_filter="Risk Signals Only")
    assert risky | kept(risk_filter="No Risk Signals") == everyone
    assert risky == set(quality_pandas[quality_pandas.has_business_risk_signal].record_order)


def test_lookups_and_projections(quality):
    assert filters.find_company(quality, "Zeta SL").first().record_order == 8
    places = [r.municipality for r in filters.distinct_values(quality, "municipality").collect()]
    assert places == sorted(places) and None not in places
    assert filters.explorer_view(quality).columns[0] == "record_order"
    assert filters.explorer_view(quality.drop("revenue_growth")).columns.count("revenue_growth") == 0
