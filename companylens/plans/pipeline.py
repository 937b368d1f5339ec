"""Batch pipeline: source -> clean -> financial -> quality -> seven tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.operators.clean import clean_companies
from companylens.operators.distributed import materialize
from companylens.operators.finance import add_financial_features
from companylens.operators.quality import add_quality_controls, create_quality_summary
from companylens.operators.rankings import create_company_ranking
from companylens.operators.summaries import (
    calculate_coverage,
    calculate_revenue_concentration,
    calculate_revenue_percentiles,
    create_municipality_summary,
    create_scope_comparison,
)
from companylens.schema import (
    CLEAN_COLUMNS,
    COVERAGE_COLUMNS,
    DEFAULT_RANKING_SIZE,
    FINANCIAL_COLUMNS,
    REVENUE,
    SOURCE_COLUMNS,
    STAGE_NAMES,
    TABLE_NAMES,
)
from companylens.sources.companies import load_source, normalize_source_name
from companylens.sources.contracts import (
    ContractError,
    positive_int,
    validate_source,
    validate_stages,
)


def quality_layer(source: DataFrame) -> DataFrame:
    """All 36 company-level columns from the ten source columns."""
    return (
        source.transform(clean_companies)
        .transform(add_financial_features)
        .transform(add_quality_controls)
    )


def create_analytical_tables(
    quality: DataFrame, ranking_size: int = DEFAULT_RANKING_SIZE
) -> dict[str, DataFrame]:
    """The seven standard tables, in their fixed order."""
    positive_int(ranking_size, "ranking_size")
    tables = {
        "scope_comparison": create_scope_comparison(quality),
        "coverage": calculate_coverage(quality, COVERAGE_COLUMNS),
        "quality_summary": create_quality_summary(quality),
        "revenue_concentration": calculate_revenue_concentration(quality),
        "revenue_percentiles": calculate_revenue_percentiles(quality),
        "company_ranking": create_company_ranking(quality, REVENUE, ranking_size),
        "municipality_summary": create_municipality_summary(quality),
    }
    return {name: tables[name] for name in TABLE_NAMES}


def run_counters(quality: DataFrame) -> DataFrame:
    """Rows, records with issues and records with risk signals; one row."""
    return quality.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("has_data_quality_issue")).alias("data_quality_issue_count"),
        F.count_if(F.col("has_business_risk_signal")).alias("business_risk_signal_count"),
    )


@dataclass(frozen=True)
class PipelineResult:
    """Stages and tables of one run. DataFrames are immutable plans."""

    source_name: str
    stages: dict[str, DataFrame]
    tables: dict[str, DataFrame]
    _counts: dict[str, int] = field(default_factory=dict, repr=False, compare=False)

    @property
    def quality(self) -> DataFrame:
        return self.stages["quality"]

    @property
    def row_count(self) -> int:
        """Number of company records (counted once)."""
        if "rows" not in self._counts:
            self._counts["rows"] = self.quality.count()
        return self._counts["rows"]

    @property
    def final_column_count(self) -> int:
        return len(self.quality.columns)

    def get_stage(self, name: str) -> DataFrame:
        if name not in self.stages:
            raise ContractError(f"No stage is called {name!r}; there are {STAGE_NAMES}.")
        return self.stages[name]

    def get_table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ContractError(f"No table is called {name!r}; there are {TABLE_NAMES}.")
        return self.tables[name]


def run_stages(
    source: DataFrame, source_name: str = "synthetic", ranking_size: int = DEFAULT_RANKING_SIZE
) -> PipelineResult:
    """Pipeline over an already loaded source.

    The typed source and the quality layer are written once to the shared
    folder: checks and key counts then read single columns, the clean and
    financial layers are projections of the quality layer, and every table
    scans only the columns it needs.
    """
    positive_int(ranking_size, "ranking_size")
    source = validate_source(materialize(source, "source"))
    quality = materialize(quality_layer(source), "quality")
    clean_width = len(SOURCE_COLUMNS) + len(CLEAN_COLUMNS)
    stages = {
        "source": source,
        "clean": quality.select(quality.columns[:clean_width]),
        "financial": quality.select(quality.columns[: clean_width + len(FINANCIAL_COLUMNS)]),
        "quality": quality,
    }
    validate_stages(stages)
    return PipelineResult(source_name, stages, create_analytical_tables(quality, ranking_size))


def run_pipeline(
    spark: SparkSession,
    source: str,
    path: str,
    file_format: str = "csv",
    ranking_size: int = DEFAULT_RANKING_SIZE,
) -> PipelineResult:
    """Load a named source and run every stage."""
    name = normalize_source_name(source)
    source_rows = load_source(spark, name, path, file_format, validate=False)
    return run_stages(source_rows, name, ranking_size)
