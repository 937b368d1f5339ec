import numpy as np
import pytest
from pyspark.sql import functions as F

from companylens.functions.numeric import safe_divide
from companylens.operators.clean import add_duplicate_flags
from companylens.operators.finance import add_financial_features
from companylens.operators.quality import (
    add_quality_controls,
    create_quality_summary,
    distribution,
)
from companylens.schema import (
    CLEAN_COLUMNS,
    EBITDA,
    EBITDA_PREVIOUS,
    EMPLOYEES,
    FINANCIAL_COLUMNS,
    QUALITY_COLUMNS,
    REVENUE,
    REVENUE_PREVIOUS,
    SOURCE_COLUMNS,
)
from companylens.sources.contracts import ContractError

MONEY = f"name string, {REVENUE} double, {REVENUE_PREVIOUS} double, {EBITDA} double, {EBITDA_PREVIOUS} double, {EMPLOYEES} long"


def by_key(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_layer_widths(source, cleaned, quality):
    assert cleaned.columns == SOURCE_COLUMNS + CLEAN_COLUMNS
    assert quality.columns == SOURCE_COLUMNS + CLEAN_COLUMNS + FINANCIAL_COLUMNS + QUALITY_COLUMNS
    assert (len(source.columns), len(cleaned.columns), len(quality.columns)) == (10, 16, 36)
    assert source.count() == cleaned.count() == quality.count() == 10


def test_clean_layer(cleaned):
    rows = by_key(
        cleaned, "record_order", "company_name", "legal_status", "has_adverse_legal_status",
        "company_match_key", "potential_duplicate", "potential_duplicate_count",
    )
    assert rows[1] == ("Cerámica Álvarez, S.L.", "no_adverse_marker", False, "CERAMICA ALVAREZ S L", True, 2)
    assert rows[2][1:] == ("extinct", True, "CERAMICA ALVAREZ SL", False, 1)
    assert rows[3][4:] == (True, 2)
    assert rows[4][1:3] == ("in_liquidation", True)
    assert rows[7][1:3] == ("in_dissolution", True)
    # Names without letters share the empty key.
    assert rows[9][3:] == ("", True, 2) and rows[10][3:] == ("", True, 2)
    holders = by_key(cleaned, "record_order", "shareholder_name")
    assert holders[1] == ("HOLDING A",) and holders[3] == (None,)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_duplicates_with_missing_and_hot_keys(spark, broadcast_bytes):
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 == 0 else f"k{i % 400}") for i in range(3000)]
    df = spark.createDataFrame(rows, "record_order long, company_match_key string")
    flagged = add_duplicate_flags(df, broadcast_bytes=broadcast_bytes)
    sizes = {}
    for _, key in rows:
        sizes[key] = sizes.get(key, 0) + 1
    result = flagged.collect()
    assert len(result) == len(rows)
    for r in result:
        size = sizes[r.company_match_key]
        assert (r.potential_duplicate, r.potential_duplicate_count) == (size > 1, size)


def test_safe_divide(spark):
    df = spark.createDataFrame(
        [(10.0, 2.0), (20.0, 0.0), (30.0, None), (None, 5.0), (1.0, -2.0)], "a double, b double"
    )
    result = [r[0] for r in df.select(safe_divide(F.col("a"), F.col("b"))).collect()]
    assert result == [5.0, None, None, None, -0.5]


def test_financial_fixture(spark):
    rows = [
        ("normal_growth", 120.0, 100.0, 24.0, 20.0, 10),
        ("zero_previous_revenue", 50.0, 0.0, -5.0, -10.0, 5),
        ("zero_latest_revenue", 0.0, 50.0, 10.0, 5.0, 2),
        ("missing_latest_revenue", None, 80.0, 5.0, None, 4),
        ("negative_revenue", -10.0, 10.0, -2.0, -1.0, 1),
    ]
    expected = {
        "normal_growth": (0.20, 0.20, 12.0, 2.4, 20.0, 4.0),
        "zero_previous_revenue": (None, -0.10, 10.0, -1.0, 50.0, 5.0),
        "zero_latest_revenue": (-1.0, None, 0.0, 5.0, -50.0, 5.0),
        "missing_latest_revenue": (None, None, None, 1.25, None, None),
        "negative_revenue": (-2.0, 0.20, -10.0, -2.0, -20.0, -1.0),
    }
    featured = add_financial_features(spark.createDataFrame(rows, MONEY))
    ratios = by_key(
        featured, "name", "revenue_growth", "ebitda_margin", "revenue_per_employee_k_eur",
        "ebitda_per_employee_k_eur", "revenue_change_k_eur", "ebitda_change_k_eur",
    )
    for name, values in expected.items():
        assert ratios[name] == pytest.approx(values)
    flags = by_key(featured, "name", *FINANCIAL_COLUMNS[6:])
    assert flags == {
        "normal_growth": (False,) * 6,
        "zero_previous_revenue": (False, False, True, False, False, False),
        "zero_latest_revenue": (False, True, False, True, False, False),
        "missing_latest_revenue": (False, False, False, False, False, True),
        "negative_revenue": (True, False, True, True, False, False),
    }


def test_extreme_margin_is_strict(spark):
    rows = [("a", 100.0, 1.0, 50.0, 1.0, 1), ("b", 100.0, 1.0, 100.0, 1.0, 1),
            ("c", 100.0, 1.0, 150.0, 1.0, 1), ("d", -100.0, 1.0, 150.0, 1.0, 1)]
    featured = add_financial_features(spark.createDataFrame(rows, MONEY))
    assert by_key(featured, "name", "has_extreme_ebitda_margin") == {
        "a": (False,), "b": (False,), "c": (True,), "d": (True,),
    }


FLAGS = [
    "has_incomplete_financial_data", "has_negative_latest_revenue", "has_zero_latest_revenue",
    "has_extreme_ebitda_margin", "potential_duplicate", "has_adverse_legal_status",
    "has_negative_latest_ebitda", "has_revenue_decline",
]


@pytest.mark.parametrize("kind", ["boolean", "int"])
def test_quality_fixture(spark, kind):
    cases = {
        "clean": [],
        "incomplete": [0, 6],
        "negative_revenue": [1, 5, 7],
        "zero_revenue": [2, 7],
        "multiple": [0, 3, 4, 5, 6, 7],
    }
    value = bool if kind == "boolean" else int
    rows = [(n, *[value(i in on) for i in range(8)]) for n, on in cases.items()]
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{f} {kind}" for f in FLAGS))
    result = by_key(add_quality_controls(df), "name", *QUALITY_COLUMNS)
    assert result == {
        "clean": (0, 0, False, False, "clean", "eligible", "", ""),
        "incomplete": (1, 1, True, True, "review", "not_eligible", "incomplete_financial_data", "negative_latest_ebitda"),
        "negative_revenue": (1, 2, True, True, "review", "eligible_with_review", "negative_latest_revenue",
                             "adverse_legal_status|revenue_decline"),
        "zero_revenue": (1, 1, True, True, "review", "not_eligible", "zero_latest_revenue", "revenue_decline"),
        "multiple": (3, 3, True, True, "high_priority_review", "not_eligible",
                     "incomplete_financial_data|extreme_ebitda_margin|potential_duplicate",
                     "adverse_legal_status|negative_latest_ebitda|revenue_decline"),
    }


def test_quality_summary_and_distribution(quality, quality_pandas):
    summary = [tuple(r) for r in create_quality_summary(quality).collect()]
    assert [s[0] for s in summary] == FLAGS + ["has_data_quality_issue", "has_business_risk_signal"]
    for indicator, count, share in summary:
        assert count == quality_pandas[indicator].sum()
        assert share == pytest.approx(count / len(quality_pandas))
    counts = {r.legal_status: r.record_count for r in distribution(quality, "legal_status").collect()}
    assert counts == quality_pandas["legal_status"].value_counts().to_dict()


def test_summary_of_nothing_fails(quality):
    with pytest.raises(Exception, match="without records"):
        create_quality_summary(quality.where("false")).collect()


def test_no_infinite_ratio(quality_pandas):
    numbers = quality_pandas[FINANCIAL_COLUMNS[:6]].to_numpy(dtype=float)
    assert not np.isinf(numbers).any()


def test_missing_columns_are_named(source):
    with pytest.raises(ContractError, match=EMPLOYEES):
        add_financial_features(source.drop(EMPLOYEES))
