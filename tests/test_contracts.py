import pytest
from pyspark.sql import functions as F

from companylens.schema import SOURCE_COLUMNS
from companylens.sources import contracts
from companylens.sources.contracts import ContractError


def test_exact_columns():
    contracts.require_exact_columns(SOURCE_COLUMNS, SOURCE_COLUMNS)
    with pytest.raises(ContractError, match="Missing columns: \\['website'\\]"):
        contracts.require_exact_columns([c for c in SOURCE_COLUMNS if c != "website"], SOURCE_COLUMNS)
    with pytest.raises(ContractError, match="Unexpected columns: \\['extra'\\]"):
        contracts.require_exact_columns(SOURCE_COLUMNS + ["extra"], SOURCE_COLUMNS)
    with pytest.raises(ContractError, match="order"):
        contracts.require_exact_columns(SOURCE_COLUMNS[::-1], SOURCE_COLUMNS)
    contracts.require_exact_columns(SOURCE_COLUMNS[::-1], SOURCE_COLUMNS, ordered=False)


def report(df):
    return {r["check"]: r["failures"] for r in contracts.source_report(df).collect()}


def test_source_report(source):
    assert set(report(source).values()) == {0}
    contracts.validate_source(source)
    twice = source.unionByName(source.where("record_order <= 3"))
    assert report(twice)["repeated_record_order"] == 3
    assert report(source.where("false"))["empty_source"] == 1
    blank = source.withColumn(
        "company_name",
        F.when(F.col("record_order") == 1, "   ")
        .when(F.col("record_order") == 2, F.lit(None))
        .otherwise(F.col("company_name")),
    )
    assert report(blank)["blank_company_name"] == 1
    assert report(blank)["missing_company_name"] == 1


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda d: d.where("false"), "empty_source"),
        (lambda d: d.unionByName(d), "repeated_record_order"),
        (lambda d: d.withColumn("company_name", F.lit(" ")), "blank_company_name"),
        (lambda d: d.withColumn("ebitda_latest_k_eur", F.lit("a")), "not numeric"),
        (lambda d: d.drop("website"), "website"),
        (lambda d: d.withColumn("record_order", F.nullif("record_order", F.lit(4))), "missing_record_order"),
    ],
)
def test_source_rejections(source, change, message):
    with pytest.raises(ContractError, match=message):
        contracts.validate_source(change(source))


def test_flags(spark):
    df = spark.createDataFrame(
        [(True, True, 1, "x", 2), (False, None, 0, "y", 1)],
        "ok boolean, gap boolean, number int, word string, wide int",
    )
    contracts.validate_flags(df, ["ok", "number"])
    with pytest.raises(ContractError) as error:
        contracts.validate_flags(df, ["ok", "gap", "word", "wide"])
    assert "{'gap': 1, 'word': 2, 'wide': 1}" in str(error.value)


def test_stage_integrity(source, quality):
    contracts.validate_stages({"source": source, "quality": quality})
    with pytest.raises(ContractError, match="Row counts differ"):
        contracts.validate_stages({"source": source, "quality": quality.where("record_order > 1")})
    changed = quality.withColumn("record_order", F.col("record_order") + 1)
    with pytest.raises(ContractError, match="lost \\[1\\], gained \\[11\\]"):
        contracts.validate_stages({"source": source, "quality": changed})


def test_parameters():
    assert contracts.positive_int(3, "n") == 3
    for bad in (0, -1, True, 2.0, "3"):
        with pytest.raises(ContractError):
            contracts.positive_int(bad, "n")
    assert contracts.probability(1, "p") == 1.0
    for bad in (-0.1, 1.1, True, "0.5"):
        with pytest.raises(ContractError):
            contracts.probability(bad, "p")
