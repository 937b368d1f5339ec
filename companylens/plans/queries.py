"""Named queries over the driver tables, one per operator or operator group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from companylens.functions import text
from companylens.operators import (
    clean,
    filters,
    finance,
    geography,
    presentation,
    quality,
    rankings,
    scoring,
    stress,
    summaries,
)
from companylens.operators.distributed import fresh_path, materialize, spread_small_input
from companylens.operators.quantiles import exact_quantiles
from companylens.plans.company_view import company_layer, source_layer
from companylens.plans.pipeline import PipelineResult, create_analytical_tables, run_pipeline
from companylens.schema import (
    CLEAN_COLUMNS,
    COVERAGE_COLUMNS,
    EMPLOYEES,
    FINANCIAL_COLUMNS,
    QUALITY_COLUMNS,
    QUALITY_REASONS,
    REVENUE,
    RISK_REASONS,
    SOURCE_COLUMNS,
    TABLE_NAMES,
)
from companylens.sinks import export
from companylens.sources import companies, contracts

Query = Callable[[SparkSession, str], DataFrame]

# Scenario used by the single-scenario stress queries: revenue -20 %, cost +10 %.
SHOCK, INFLATION = -20.0, 10.0
# Every position of both sliders: -40 to 20 % in steps of 1, 0 to 25 % in steps of a half.
GRID = [(float(s), c / 2) for s in range(-40, 21) for c in range(51)]


def rounded(df: DataFrame) -> DataFrame:
    """Amounts to whole euros, ratios to 8 digits: double sums depend on their order."""
    return df.select(
        *[
            F.round(f.name, 3 if f.name.endswith("_k_eur") else 8).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spread_small_input(texts)


def clean_companies(spark, sf):
    columns = ["record_order", "company_name", "website", "municipality", "shareholder_name"]
    return company_layer(spark, sf).select(*columns, *CLEAN_COLUMNS)


def text_normalize_documents(spark, sf):
    """Every text operator over whole documents; each step feeds the next projection."""
    spaced = documents(spark, sf).select(
        "doc_id", text.normalize_whitespace(F.col("text")).alias("single_spaced")
    )
    staged = spaced.withColumns(
        {
            "plain": F.upper(text.remove_accents(F.col("single_spaced"))),
            "geographic_text": F.upper(F.nullif("single_spaced", F.lit(""))),
        }
    ).withColumn("name_normalized", text.name_key(F.col("plain")))
    return staged.select(
        "doc_id",
        "single_spaced",
        "name_normalized",
        text.legal_status(F.col("plain")).alias("legal_status"),
        text.strip_legal_markers(F.col("name_normalized")).alias("match_key"),
        "geographic_text",
        text.municipality_key(F.col("geographic_text")).alias("geographic_key"),
    )


def duplicate_groups(spark, sf):
    return clean.duplicate_groups(company_layer(spark, sf))


def duplicate_documents(spark, sf):
    """Whole document texts as match keys; repeated texts found and flagged.

    Texts are long, so their digests are shuffled and compared.
    """
    key = text.create_company_match_key(F.col("text"))
    keyed = materialize(
        documents(spark, sf).select("doc_id", F.sha2(key, 256).alias("match_key")), "document-keys"
    )
    flagged = clean.add_duplicate_flags(keyed, "match_key", "doc_id")
    return flagged.select("doc_id", "potential_duplicate", "potential_duplicate_count")


def financial_features(spark, sf):
    return company_layer(spark, sf).select("record_order", *FINANCIAL_COLUMNS)


def quality_controls(spark, sf):
    return company_layer(spark, sf).select("record_order", *QUALITY_COLUMNS)


def quality_summary(spark, sf):
    return rounded(quality.create_quality_summary(company_layer(spark, sf)))


def category_distribution(spark, sf):
    columns = [
        "data_quality_status",
        "analytical_eligibility",
        "legal_status",
        "business_risk_signal_count",
    ]
    return quality.distributions(company_layer(spark, sf), columns)


def contract_report(spark, sf):
    flags = [*QUALITY_REASONS, *RISK_REASONS]
    source = contracts.source_report(source_layer(spark, sf))
    flagged = contracts.flag_report(company_layer(spark, sf), flags)
    return source.unionByName(flagged)


def stage_integrity(spark, sf):
    """All four stages, each made from the one before."""
    source = source_layer(spark, sf)
    cleaned = clean.clean_companies(source)
    stages = {
        "source": source,
        "clean": cleaned,
        "financial": finance.add_financial_features(cleaned),
        "quality": company_layer(spark, sf),
    }
    report = contracts.stage_report(stages)
    source_digest = F.first("key_digest").alias("first_digest")
    digests = report.agg(source_digest, F.count_distinct("key_digest").alias("distinct_digests"))
    return report.select("stage", "row_count").unionByName(
        digests.select(
            F.lit("distinct_key_digests").alias("stage"),
            F.col("distinct_digests").alias("row_count"),
        )
    )


def scope_filter(spark, sf):
    layer = company_layer(spark, sf)
    return layer.select(
        "record_order",
        *[filters.scope_condition(s).alias(f"in_{s}") for s in filters.SCOPES],
    )


def eligible_companies(spark, sf):
    scoped = filters.filter_analytical_scope(company_layer(spark, sf), "no_adverse_eligible")
    return scoped.select("record_order", "company_name", "legal_status", "analytical_eligibility")


def overview_summary(spark, sf):
    return rounded(summaries.create_overview_summary(company_layer(spark, sf), "eligible"))


def scope_comparison(spark, sf):
    return rounded(summaries.create_scope_comparison(company_layer(spark, sf)))


def faceted_filter(spark, sf):
    filtered = filters.filter_companies(
        company_layer(spark, sf),
        scope="no_adverse_marker",
        municipalities=["NATION_3", "nation_1", "nation_5", "NÁTION_2", "NATION_7", "NATION_11"],
        min_revenue=50.0,
        max_revenue=5_000.0,
        min_employees=1,
        max_employees=9,
        quality_statuses=["clean", "review"],
        risk_filter="No Risk Signals",
    )
    return filters.explorer_view(filtered)


def explorer_projection(spark, sf):
    return filters.explorer_view(company_layer(spark, sf))


def distinct_values(spark, sf):
    return filters.distinct_values(company_layer(spark, sf), "municipality")


def company_lookup(spark, sf):
    layer = company_layer(spark, sf)
    return filters.find_company(layer, "Customer 148").select(*SOURCE_COLUMNS)


def coverage(spark, sf):
    return rounded(summaries.calculate_coverage(company_layer(spark, sf), COVERAGE_COLUMNS))


def coverage_ordered(spark, sf):
    table = summaries.calculate_coverage(company_layer(spark, sf), SOURCE_COLUMNS)
    return rounded(presentation.coverage_chart(table))


def revenue_concentration(spark, sf):
    return rounded(summaries.calculate_revenue_concentration(company_layer(spark, sf)))


def concentration_curve(spark, sf):
    table = summaries.calculate_revenue_concentration(company_layer(spark, sf), scope="eligible")
    return rounded(presentation.concentration_curve(table))


def revenue_percentiles(spark, sf):
    return rounded(summaries.calculate_revenue_percentiles(company_layer(spark, sf)))


def percentile_chart(spark, sf):
    table = summaries.calculate_revenue_percentiles(
        company_layer(spark, sf), [0.29, 0.1, 0.5, 0.999], "no_adverse_marker"
    )
    return rounded(presentation.percentile_chart(table))


def order_price_percentiles(spark, sf):
    """Quantiles per order status; three groups that hold all rows."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    values = exact_quantiles(
        orders,
        ["o_totalprice"],
        [0.25, 0.5, 0.75, 0.99],
        ["o_orderstatus"],
    )
    names = ["p25", "p50", "p75", "p99"]
    return rounded(
        values.select(
            "o_orderstatus",
            "available",
            *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)],
        )
    )


def company_ranking(spark, sf):
    return rankings.create_company_ranking(company_layer(spark, sf))


def company_ranking_asc(spark, sf):
    return rankings.create_company_ranking(
        company_layer(spark, sf), EMPLOYEES, 50, "no_adverse_eligible", ascending=True
    )


def leaderboard(spark, sf):
    ranking = rankings.create_company_ranking(company_layer(spark, sf))
    return rankings.leaderboard(ranking, 15)


def municipality_summary(spark, sf):
    return rounded(summaries.create_municipality_summary(company_layer(spark, sf)))


def municipality_top_n(spark, sf):
    table = summaries.summarize_top_places(company_layer(spark, sf), "municipality", 10)
    return rounded(rankings.municipality_top_n(table, 10))


def kpi_metrics(spark, sf):
    return rounded(summaries.compute_kpi_metrics(company_layer(spark, sf)))


def leading_municipality(spark, sf):
    return rounded(summaries.leading_municipality(company_layer(spark, sf)))


def executive_briefing(spark, sf):
    """The measures, and what the written text says about them, read back from it."""
    row = presentation.executive_briefing(company_layer(spark, sf))
    bold = F.regexp_extract_all("briefing", F.lit(r"\*\*([^*]*)\*\*"))

    def stated(position: int):
        plain = F.regexp_replace(F.get(F.col("stated"), F.lit(position)), "[€,k%]", "")
        return plain.cast("double")

    shown = [
        "companies", "revenue_k", "ebitda_k", "employees", "median_revenue_k", "median_margin",
        "eligible", "of_companies", "eligible_share", "issue_rate", "risk_rate",
    ]
    read_back = row.withColumn("stated", bold).select(
        *[c for c in row.columns if c != "briefing"],
        *[stated(i).alias(f"stated_{name}") for i, name in enumerate(shown)],
        F.get("stated", F.lit(11)).alias("stated_place"),
        stated(12).alias("stated_place_share"),
    )
    return rounded(read_back)


def municipality_inventory(spark, sf):
    return rounded(geography.create_municipality_inventory(company_layer(spark, sf)))


def mapping_template(spark, sf):
    return geography.create_mapping_template(geography.inventory_labels(company_layer(spark, sf)))


def region_mapping(spark, sf):
    """Every label of a nation gets its region, a missing one UNKNOWN; one is not reviewed yet."""
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    region = spark.read.parquet(f"{sf}/region.parquet")
    template = geography.create_mapping_template(
        geography.inventory_labels(company_layer(spark, sf))
    )
    regions = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        text.create_municipality_match_key(F.col("n_name")).alias("municipality_match_key"),
        F.col("r_name").alias("region_name"),
    )
    return template.join(regions, "municipality_match_key", "left").select(
        "municipality_original",
        "municipality_match_key",
        F.when(F.col("municipality_original").isNull(), "UNKNOWN")
        .otherwise(F.col("region_name"))
        .alias("municipality_canonical"),
        F.when(F.col("municipality_original") == "NATION_7", "pending")
        .otherwise("reviewed")
        .alias("review_status"),
        F.lit("nation_to_region").alias("normalization_rule"),
        "notes",
    )


def mapped_companies(spark, sf):
    mapped = geography.apply_mapping(company_layer(spark, sf), region_mapping(spark, sf))
    return mapped.select(
        "record_order", "municipality", "municipality_canonical", "municipality_review_status"
    )


def mapped_summary(spark, sf):
    return rounded(
        geography.create_canonical_summary(company_layer(spark, sf), region_mapping(spark, sf))
    )


def mapping_contract(spark, sf):
    mapping = region_mapping(spark, sf)
    labels = geography.inventory_labels(company_layer(spark, sf))
    uncovered = contracts.uncovered_labels(labels, mapping).agg(
        F.lit("uncovered_label").alias("check"), F.count(F.lit(1)).alias("failures")
    )
    return contracts.mapping_report(mapping).unionByName(uncovered)


def _stressed(spark, sf):
    return stress.apply_macroeconomic_stress(company_layer(spark, sf), SHOCK, INFLATION)


def stress_companies(spark, sf):
    return _stressed(spark, sf).select("record_order", *stress.STRESS_COLUMNS)


def stress_summary(spark, sf):
    return rounded(stress.stress_impact_summary(_stressed(spark, sf)))


def stress_newly_distressed(spark, sf):
    return stress.newly_distressed(_stressed(spark, sf))


def stress_comparison(spark, sf):
    return rounded(stress.baseline_comparison(_stressed(spark, sf)))


def stress_grid(spark, sf):
    return rounded(stress.stress_grid(company_layer(spark, sf), GRID))


def health_scores(spark, sf):
    scored = scoring.add_health_scores(company_layer(spark, sf))
    return scored.select(
        "record_order",
        "health_score",
        "grade",
        "grade_color",
        "assessment",
        F.array_join(
            F.transform("deductions", lambda d: F.concat(d.factor, F.lit(" "), d.points)), "; "
        ).alias("deductions"),
        F.array_join("positives", "; ").alias("positives"),
    )


def grade_distribution(spark, sf):
    return quality.distribution(scoring.add_health_scores(company_layer(spark, sf)), "grade")


def percentile_benchmark(spark, sf):
    return rounded(scoring.percentile_benchmark(company_layer(spark, sf)))


def positioning(spark, sf):
    return presentation.positioning(company_layer(spark, sf))


def treemap_rollup(spark, sf):
    return rounded(presentation.treemap(company_layer(spark, sf)))


def raw_register_roundtrip(spark, sf):
    path = fresh_path(spark, "register")
    companies.write_register(source_layer(spark, sf), path)
    return companies.load_source(spark, " Register ", path)


def standard_csv_roundtrip(spark, sf):
    path = fresh_path(spark, "companies")
    export.write_download(company_layer(spark, sf).select(*SOURCE_COLUMNS), path)
    return companies.load_source(spark, "synthetic", path)


def long_keys_roundtrip(spark, sf):
    """Keys beyond 2**53 through a CSV file."""
    path = fresh_path(spark, "long-keys")
    shifted = source_layer(spark, sf).withColumn(
        "record_order", F.col("record_order") + F.lit(9007199254740992)
    )
    export.write_download(shifted.select(*SOURCE_COLUMNS), path)
    return companies.read_companies(spark, path).select("record_order", "company_name")


def mapping_roundtrip(spark, sf):
    """Review template through its file."""
    path = fresh_path(spark, "mapping")
    export.write_download(mapping_template(spark, sf), path)
    return companies.read_mapping(spark, path)


def label_texts(spark, sf):
    """Percentages and amounts as the reports write them."""

    def label(column: str, digits: int, write) -> Column:
        # Adding zero turns a negative zero into a plain one.
        value = F.round(column, digits) + F.lit(0.0)
        return F.when(value.isNotNull(), write(value))

    return company_layer(spark, sf).select(
        "record_order",
        label(REVENUE, 1, text.thousands_label).alias("revenue_label"),
        label("ebitda_margin", 3, text.percent_label).alias("margin_label"),
        label("revenue_growth", 3, lambda c: text.percent_label(c, signed=True)).alias("growth_label"),
    )


def geographic_audit(spark, sf):
    """Inventory and template as written, read back."""
    inventory, template = fresh_path(spark, "inventory"), fresh_path(spark, "template")
    export.export_geographic_audit(company_layer(spark, sf), inventory, template)
    rows = spark.read.option("header", True).csv(inventory)
    mapping = companies.read_mapping(spark, template).select(
        F.col("municipality_original").alias("__label"), "review_status"
    )
    return rows.join(mapping, F.col("municipality_original").eqNullSafe(F.col("__label"))).select(
        "municipality_original",
        F.col("inventory_id").cast("long"),
        F.col("company_count").cast("long"),
        F.col("employee_count").cast("long"),
        "review_status",
    )


def pipeline_run(spark, sf):
    """Rows of every stage and table of a run over files."""
    path = fresh_path(spark, "run-input")
    source_layer(spark, sf).write.parquet(path)
    result = run_pipeline(spark, "synthetic", path, "parquet")
    frames = {**result.stages, **result.tables}
    counts = [
        df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def _result(spark, sf) -> PipelineResult:
    layer = company_layer(spark, sf)
    width = len(SOURCE_COLUMNS) + len(CLEAN_COLUMNS)
    stages = {
        "source": source_layer(spark, sf),
        "clean": layer.select(layer.columns[:width]),
        "financial": layer.select(layer.columns[: width + len(FINANCIAL_COLUMNS)]),
        "quality": layer,
    }
    return PipelineResult("synthetic", stages, create_analytical_tables(layer))


def run_metadata(spark, sf):
    described = export.run_metadata(_result(spark, sf)).drop("generated_at_utc")
    return described.withColumn("limitations", F.array_join("limitations", " "))


def export_manifest(spark, sf):
    """Each exported table read back, and whether its files are what the manifest says."""
    exported = export.export_result(_result(spark, sf), fresh_path(spark, "export"))
    stored = exported.manifest.withColumn("artifact", F.split("filename", "/")[0])
    tables = [*TABLE_NAMES, export.COMPANY_LEVEL]
    recounted = export.create_manifest(spark, exported.directory, tables).select(
        "filename", F.col("size_bytes").alias("size_again"), F.col("sha256").alias("sha256_again")
    )
    same = (F.col("size_bytes") == F.col("size_again")) & (F.col("sha256") == F.col("sha256_again"))
    agreed = (
        stored.where(F.col("artifact").isin(tables))
        .join(recounted, "filename", "full")
        .groupBy("artifact")
        .agg(F.every(F.coalesce(same, F.lit(False))).alias("files_agree"))
    )
    sizes = []
    for name in tables:
        table = spark.read.option("header", True).csv(exported.get_artifact(name))
        sizes.append(
            table.agg(
                F.lit(name).alias("artifact"),
                F.count(F.lit(1)).alias("row_count"),
                F.lit(len(table.columns)).cast("long").alias("column_count"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), sizes).join(agreed, "artifact")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        municipality_summary,
        clean_companies,
        text_normalize_documents,
        duplicate_groups,
        duplicate_documents,
        financial_features,
        quality_controls,
        quality_summary,
        category_distribution,
        contract_report,
        stage_integrity,
        scope_filter,
        eligible_companies,
        overview_summary,
        scope_comparison,
        faceted_filter,
        explorer_projection,
        distinct_values,
        company_lookup,
        coverage,
        coverage_ordered,
        revenue_concentration,
        concentration_curve,
        revenue_percentiles,
        percentile_chart,
        order_price_percentiles,
        company_ranking,
        company_ranking_asc,
        leaderboard,
        municipality_top_n,
        kpi_metrics,
        leading_municipality,
        executive_briefing,
        municipality_inventory,
        mapping_template,
        mapped_companies,
        mapped_summary,
        mapping_contract,
        stress_companies,
        stress_summary,
        stress_newly_distressed,
        stress_comparison,
        stress_grid,
        health_scores,
        grade_distribution,
        percentile_benchmark,
        positioning,
        treemap_rollup,
        raw_register_roundtrip,
        standard_csv_roundtrip,
        long_keys_roundtrip,
        mapping_roundtrip,
        label_texts,
        geographic_audit,
        pipeline_run,
        run_metadata,
        export_manifest,
    )
}
