"""Geography, stress, scoring and presentation."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from companylens.operators import geography, presentation, scoring, stress, summaries
from companylens.schema import EBITDA, EMPLOYEES, MAPPING_COLUMNS, REVENUE
from companylens.sources.contracts import ContractError, mapping_report, uncovered_labels


def test_inventory(quality):
    rows = geography.create_municipality_inventory(quality).collect()
    assert [r.inventory_id for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.municipality_original, r.company_count) for r in rows] == [
        ("ONDA", 3), ("CASTELLÓ DE LA PLANA", 2), (None, 2), ("NULES", 2), ("PEÑÍSCOLA/PENISCOLA", 1),
    ]
    assert rows[1].municipality_match_key == "CASTELLO DE LA PLANA"
    assert sum(r.company_count for r in rows) == 10
    with pytest.raises(ContractError):
        geography.create_municipality_inventory(quality.where("false"))


def test_mapping_template(quality):
    template = geography.create_mapping_template(geography.inventory_labels(quality))
    assert template.columns == MAPPING_COLUMNS
    rows = template.collect()
    labels = [r.municipality_original for r in rows]
    assert labels[-1] is None and labels[:-1] == sorted(labels[:-1])
    assert {(r.review_status, r.normalization_rule, r.notes) for r in rows} == {
        ("pending", "identity_pending_review", "")
    }
    assert all(r.municipality_canonical == r.municipality_original for r in rows)


def test_reviewed_mapping(spark, quality):
    rows = [
        ("ONDA", "ONDA", "Onda", "reviewed", "case", ""),
        ("CASTELLÓ DE LA PLANA", "CASTELLO DE LA PLANA", "Castelló", "reviewed", "case", ""),
        ("UNUSED", "UNUSED", "Unused", "not_applicable", "", ""),
        ("NULES", "NULES", "Nules", "pending", "", ""),
        (None, None, "UNKNOWN", "reviewed", "", ""),
    ]
    mapping = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in MAPPING_COLUMNS))
    mapped = geography.apply_mapping(quality, mapping)
    assert mapped.count() == 10
    assert mapped.columns == quality.columns + ["municipality_canonical", "municipality_review_status"]
    found = {r.record_order: r.municipality_canonical for r in mapped.collect()}
    assert found[1] == found[2] == found[8] == "Onda"
    assert found[5] == found[6] == "Castelló" and found[7] is None and found[4] == "UNKNOWN"
    status = {r.record_order: r.municipality_review_status for r in mapped.collect()}
    assert (status[1], status[3], status[4], status[7]) == ("reviewed", "pending", "reviewed", None)
    summary = {
        r.municipality_canonical: r.company_count
        for r in geography.create_canonical_summary(quality, mapping).collect()
    }
    assert summary == {"Onda": 3, "Castelló": 2, "Nules": 2, "UNKNOWN": 2, None: 1}
    left = {r[0] for r in uncovered_labels(geography.inventory_labels(quality), mapping).collect()}
    assert left == {"PEÑÍSCOLA/PENISCOLA"}
    bad = mapping.unionByName(mapping.limit(1)).withColumn("review_status", F.lit("done"))
    assert {r["check"]: r["failures"] for r in mapping_report(bad).collect()} == {
        "unknown_review_status": 6, "repeated_label": 1,
    }
    with pytest.raises(ContractError, match="repeated_label"):
        geography.apply_mapping(quality, bad)


def test_zero_stress_and_clipped_cost(quality):
    rows = {r.record_order: r for r in stress.apply_macroeconomic_stress(quality).collect()}
    for r in rows.values():
        assert r.stressed_revenue_k_eur == r[REVENUE]
        assert not r.is_newly_distressed
    # EBITDA above revenue leaves no cost to inflate.
    assert (rows[6].stressed_opex_k_eur, rows[6].stressed_ebitda_k_eur) == (0.0, 100.0)
    assert rows[4].stressed_ebitda_k_eur is None and rows[4].stressed_has_negative_ebitda is False


def test_total_revenue_loss_has_no_margin(quality):
    rows = stress.apply_macroeconomic_stress(quality, -100, 0).collect()
    assert all(r.stressed_ebitda_margin is None for r in rows)


def expected_impact(data, shock, inflation):
    revenue, ebitda = data[REVENUE], data[EBITDA]
    stressed_revenue = revenue * (1 + shock / 100)
    opex = (revenue - ebitda).clip(lower=0) * (1 + inflation / 100)
    stressed = stressed_revenue - opex
    negative = stressed < 0
    valid = revenue.notna().sum()
    delta = stressed.sum() - ebitda.sum()
    return {
        "base_total_revenue_k_eur": revenue.sum(),
        "stressed_total_revenue_k_eur": stressed_revenue.sum(),
        "ebitda_delta_k_eur": delta,
        "ebitda_contraction_pct": delta / abs(ebitda.sum()),
        "base_negative_ebitda_count": (ebitda < 0).sum(),
        "stressed_negative_ebitda_count": negative.sum(),
        "newly_distressed_count": ((ebitda >= 0) & negative).sum(),
        "jobs_in_distressed_entities": data.loc[negative, EMPLOYEES].sum(),
        "resilience_rate": max(0, min(1, (valid - negative.sum()) / valid)),
    }


def test_stress_summary_and_grid(quality, quality_pandas):
    scenarios = [(-15.0, 8.0), (0.0, 0.0), (10.0, 2.5), (-40.0, 25.0), (-15.0, 8.0)]
    grid = {
        (r.revenue_shock_pct, r.cost_inflation_pct): r
        for r in stress.stress_grid(quality, scenarios).collect()
    }
    assert len(grid) == 4
    for (shock, inflation), row in grid.items():
        single = stress.stress_impact_summary(
            stress.apply_macroeconomic_stress(quality, shock, inflation)
        ).first()
        expected = expected_impact(quality_pandas, shock, inflation)
        for name, value in expected.items():
            assert single[name] == pytest.approx(value), name
            assert row[name] == pytest.approx(value), name


def test_stress_grid_on_the_edge(spark):
    """Counts equal the products of doubles for every slider position, ties included."""
    rng = random.Random(4)
    grid = [(float(s), c / 2) for s in range(-40, 21) for c in range(51)]
    rows = [(1, 0.0, 0.0), (2, -5.0, -5.0), (3, -5.0, 2.0), (4, 0.0, -3.0), (5, 7.0, 9.0), (None, 3.3, 0.0)]
    rows += [(1, None, 1.0), (1, 1.0, None), (8, 1e-200, 1e-201), (9, 1e200, -1e200), (2, 1e160, 1e-160)]
    for _ in range(300):
        revenue = round(rng.uniform(1, 5000), rng.randrange(4))
        s, c = rng.choice(grid)
        # A cost that the scenario just eats up, one unit in the last place more or less.
        cost = revenue * (1 + s / 100) / (1 + c / 100)
        cost = rng.choice([cost, math.nextafter(cost, 0), math.nextafter(cost, math.inf)])
        rows.append((rng.randrange(50), revenue, revenue - cost))
        rows.append((1, revenue, rng.choice([0.0, revenue * rng.uniform(-0.3, 0.4)])))
    df = spark.createDataFrame(rows, f"{EMPLOYEES} long, {REVENUE} double, {EBITDA} double")
    outside = [(-100.0, 5.0), (5.0, -100.0), (-250.0, 0.0), (1e6, 0.0)]
    found = stress.stress_grid(df, grid + outside).collect()
    assert len(found) == len(grid) + len(outside)
    both = [r for r in rows if None not in r[1:]]
    for r in found:
        a, b = 1 + r.revenue_shock_pct / 100, 1 + r.cost_inflation_pct / 100
        losses = [(n, e) for n, v, e in both if v * a - max(v - e, 0.0) * b < 0]
        assert r.stressed_negative_ebitda_count == len(losses)
        assert r.newly_distressed_count == sum(e >= 0 for _, e in losses)
        assert r.jobs_in_distressed_entities == sum(n or 0 for n, _ in losses)
        assert r.resilience_rate == pytest.approx((len(rows) - 1 - len(losses)) / (len(rows) - 1))
    assert stress.stress_grid(df.limit(0), grid[:3]).select("resilience_rate").distinct().collect() == [(1.0,)]
    with pytest.raises(ValueError):
        stress.stress_grid(df, [])


def test_stress_of_nothing(quality):
    empty = stress.apply_macroeconomic_stress(quality.where("false"), -10, 5)
    row = stress.stress_impact_summary(empty).first()
    assert list(row) == [0.0] * 11 + [1.0]


def test_stress_views(quality, quality_pandas):
    stressed = stress.apply_macroeconomic_stress(quality, -20, 10)
    distressed = stress.newly_distressed(stressed)
    assert distressed.columns == stress.DISTRESSED_COLUMNS
    assert distressed.count() == stressed.where("is_newly_distressed").count() > 0
    table = {r.measure: r for r in stress.baseline_comparison(stressed).collect()}
    assert table["revenue"].baseline_k_eur == pytest.approx(quality_pandas[REVENUE].sum())
    assert table["revenue"].stressed_k_eur == pytest.approx(quality_pandas[REVENUE].sum() * 0.8)


def test_health_of_prime_and_distressed(spark):
    flags = [name for name, _, _ in scoring.DEDUCTIONS]
    bad = {"has_incomplete_financial_data", "has_extreme_ebitda_margin", "has_adverse_legal_status",
           "has_negative_latest_ebitda", "has_revenue_decline"}
    rows = [
        ("prime", *[False] * 8, 500.0, 0.12, 0.18),
        ("poor", *[f in bad for f in flags], -300.0, -0.3, -1.5),
        ("thin", *[False] * 8, 0.0, 0.0, 0.05),
        ("stable", *[f == "has_revenue_decline" for f in flags], 1.0, None, 0.051),
    ]
    df = spark.createDataFrame(
        rows,
        "name string, " + ", ".join(f"{f} boolean" for f in flags)
        + f", {EBITDA} double, revenue_growth double, ebitda_margin double",
    )
    scored = {r.name: r for r in scoring.add_health_scores(df).collect()}
    prime, poor = scored["prime"], scored["poor"]
    assert (prime.health_score, prime.grade, prime.deductions) == (100, "AAA", [])
    assert prime.positives == [
        "Complete Financial Reporting", "No Adverse Legal Marker", "Positive Operating EBITDA",
        "Positive YoY Growth (+12.0%)", "Strong EBITDA Margin (18.0%)",
    ]
    assert (poor.health_score, poor.grade, poor.positives) == (0, "CCC / Distressed", [])
    assert [(d.factor, d.points) for d in poor.deductions][0] == ("Incomplete Financial Reporting", -25)
    assert [d.points for d in poor.deductions] == [-25, -20, -35, -20, -10]
    assert scored["thin"].positives == ["Complete Financial Reporting", "No Adverse Legal Marker"]
    assert (scored["stable"].health_score, scored["stable"].grade) == (90, "AAA")
    assert scored["stable"].positives[-1] == "Stable EBITDA Margin (5.1%)"


def test_grade_bands(spark):
    points = {0: "AAA", 10: "AAA", 20: "AA", 25: "A", 30: "A", 35: "BBB", 45: "BB", 55: "B", 65: "CCC / Distressed"}
    flags = [(name, lost) for name, _, lost in scoring.DEDUCTIONS]

    def chosen(total):
        for mask in range(256):
            picked = [i for i in range(8) if mask >> i & 1]
            if sum(flags[i][1] for i in picked) == total:
                return [i in picked for i in range(8)]

    rows = [(total, *chosen(total)) for total in points]
    df = spark.createDataFrame(rows, "lost int, " + ", ".join(f"{f} boolean" for f, _ in flags))
    result = {r.lost: (r.health_score, r.grade) for r in scoring.add_health_scores(df).collect()}
    assert result == {lost: (100 - lost, grade) for lost, grade in points.items()}


def test_percentile_benchmark(quality, quality_pandas):
    rows = {r.record_order: r for r in scoring.percentile_benchmark(quality).collect()}
    assert len(rows) == 10
    for axis, metric in scoring.BENCHMARK_METRICS.items():
        column = quality_pandas[metric].astype(float)
        compared = len(column) if axis == "revenue_scale" else column.notna().sum()
        for key, own in zip(quality_pandas.record_order, column):
            expected = 0.0 if pd.isna(own) else (column <= own).sum() / compared * 100
            assert rows[key][f"{axis}_pct"] == pytest.approx(expected), (axis, key)


def test_concentration_curve(quality):
    table = summaries.calculate_revenue_concentration(quality, [1, 4])
    rows = presentation.concentration_curve(table).collect()
    assert [(r.series, r.top_n) for r in rows] == [
        ("cumulative_share", 1), ("cumulative_share", 4), ("equal_share", 1), ("equal_share", 4),
    ]
    assert [r.share_pct for r in rows[2:]] == [25.0, 100.0]


def test_positioning(quality):
    rows = {r.record_order: r for r in presentation.positioning(quality).collect()}
    assert set(rows) == {1, 2, 5, 6, 7, 8, 9, 10}
    assert (rows[6].display_margin, rows[6].size_scaled) == (50.0, 10)
    assert rows[5].size_scaled == 5
    assert rows[2].cohort == "Business Risk Signal"
    assert rows[1].cohort == "Data Quality Review"


def test_treemap(quality):
    rows = presentation.treemap(quality).collect()
    onda = [r for r in rows if r.municipality == "ONDA"]
    parent = next(r for r in onda if r.level == "municipality")
    leaves = [r for r in onda if r.level == "company"]
    assert parent.company_name is None and parent.area_k_eur == 750.0
    weighted = sum(r.area_k_eur * r.ebitda_margin_pct for r in leaves) / 750.0
    assert parent.ebitda_margin_pct == pytest.approx(weighted)


def test_chart_tables(quality):
    labels = presentation.percentile_chart(
        summaries.calculate_revenue_percentiles(quality, [0.95, 0.25])
    ).collect()
    assert [r.label for r in labels] == ["P25", "P95"]
    covered = presentation.coverage_chart(
        summaries.calculate_coverage(quality, [REVENUE, "website", EMPLOYEES])
    ).collect()
    assert covered[0].variable == "website"


def test_briefing(quality):
    row = presentation.executive_briefing(quality).first()
    lines = row.briefing.split("\n")
    assert lines[0] == "### 🏛️ Executive Intelligence Briefing" and len(lines) == 16
    assert "holds **10** companies" in lines[2] and "**73** employees" in lines[2]
    assert "in **Nules**: **20.0%** of all" in lines[12]
    empty = presentation.executive_briefing(quality.where("false")).first()
    assert empty.briefing == presentation.EMPTY_BRIEFING
